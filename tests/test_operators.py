import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import (
    conversations, graph, grouping, keyword_search, linking, mutations, profiles, ranking,
    triggers, vector_search, versions)


def ts(day):
    return f"2024-01-{day:02d} 00:00:00"


def test_traversal_matches_breadth_first_search_with_a_hub(spark):
    rng = random.Random(5)
    pairs = {(0, i) for i in range(1, 400)}  # node 0 touches everything
    pairs |= {(rng.randrange(400, 900), rng.randrange(1, 900)) for _ in range(900)}
    edges = spark.createDataFrame(
        [(f"n{a:03d}", f"n{b:03d}", "t", None, None) for a, b in pairs if a != b],
        "source_id string, target_id string, tenant_id string, valid_from timestamp, "
        "valid_until timestamp")
    starts = {"q1": ["n401"], "q2": ["n450", "n001"], "q3": ["n000"]}
    seeds = spark.createDataFrame([(q, "t", n) for q, ns in starts.items() for n in ns],
                                  "query_id string, tenant_id string, entity_id string")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(f"n{a:03d}", set()).add(f"n{b:03d}")
            near.setdefault(f"n{b:03d}", set()).add(f"n{a:03d}")
    for cap, depth in ((500, 3), (60, 3), (10, 2)):
        want = set()
        for q, ns in starts.items():
            level = {n: 0 for n in ns}
            todo = deque(ns)
            while todo:
                node = todo.popleft()
                if level[node] < depth:
                    for other in near.get(node, ()):
                        if other not in level:
                            level[other] = level[node] + 1
                            todo.append(other)
            for n, d in sorted(level.items(), key=lambda x: (x[1], x[0]))[:cap]:
                want.add((q, n, d))
        got = {(r.query_id, r.entity_id, r.depth)
               for r in graph.traverse(seeds, edges, depth, cap).collect()}
        assert got == want


def test_traversal_from_many_seeds_takes_hubs_cut_to_twice_the_cap(spark, monkeypatch):
    rng = random.Random(6)
    pairs = {(0, i) for i in range(1, 300)} | {(1, i) for i in range(2, 300, 2)}
    pairs |= {(rng.randrange(300, 400), rng.randrange(1, 400)) for _ in range(300)}
    edges = spark.createDataFrame(
        [(f"n{a:03d}", f"n{b:03d}", t, None, None) for a, b in pairs for t in ("t", "u", "t")],
        "source_id string, target_id string, tenant_id string, valid_from timestamp, valid_until timestamp")
    seeds = spark.createDataFrame([(n, "tu"[n % 2], f"n{n:03d}") for n in range(0, 400, 7)] + [(7, "u", "n001")],
                                  "query_id int, tenant_id string, entity_id string")
    lists = []
    monkeypatch.setattr(graph, "stored", lambda df, name: lists.append(df) or df)
    for cap, depth in ((5, 2), (40, 3), (500, 2)):
        want = sorted(tuple(r) for r in graph.traverse(seeds, edges, depth, cap).collect())
        assert sorted(tuple(r) for r in graph.traverse(seeds, edges, depth, cap, many_seeds=True).collect()) == want
        assert lists.pop().groupBy("tenant_id", "node").count().agg(F.max("count")).first()[0] <= 2 * cap


def test_two_hops_start_from_nodes_of_every_type(spark, monkeypatch):
    from types import SimpleNamespace

    from workload import registry, retrieval  # noqa: F401

    kinds = {"a": "organization", "b": "person", "c": "product", "d": None, "e": "location"}
    tables = SimpleNamespace(
        entities=spark.createDataFrame([(n, "t", kind) for n, kind in kinds.items()], "entity_id string, tenant_id string, entity_type string"),
        edges=spark.createDataFrame([(a, b, "t", None, None) for a, b in ("ab", "bc", "cd")],
                                    "source_id string, target_id string, tenant_id string, valid_from timestamp, valid_until timestamp"))
    monkeypatch.setattr(registry, "tables", lambda *_: tables)
    got = registry.QUERIES["graph_all_nodes_two_hops"](spark, "")
    assert {tuple(r) for r in got.collect()} == {("a", 3, 3), ("b", 4, 4), ("c", 4, 4), ("d", 3, 3), ("e", 1, 0)}


def test_numbering_and_closing_of_a_hot_lineage(spark):
    rows = [(1, i, ts(1 + i % 28)) for i in range(300)] + [(2, 1000, ts(3)), (3, 1001, ts(3))]
    df = spark.createDataFrame(rows, "k long, id long, at string").withColumn(
        "at", F.col("at").cast("timestamp"))
    want = {}
    for k in (1, 2, 3):
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])), 1):
            want[r[1]] = n
    got = grouping.numbered(df, ["k"], "at", ["id"], "n").collect()
    assert {r.id: r.n for r in got} == want
    closed = versions.close_versions(df, ["k"], "at", "id").collect()
    order = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[2], r[1]))
    following = {a[1]: b[2] for a, b in zip(order, order[1:])}
    assert {r.id: str(r.valid_until) if r.valid_until else None for r in closed if r.k == 1} == {
        r[1]: following.get(r[1]) for r in order}


def test_a_lineage_with_one_time_spreads_over_ranges(spark):
    df = spark.range(8000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1).alias("k"), "id", F.lit("2024-01-01").cast("timestamp").alias("at"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = grouping.in_ranges(df, ["k"], ["at", "id"], "part")
        sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
        assert max(sizes) < 8000 / 3 and len(sizes) == 12
        got = {r.id: r.n for r in grouping.numbered(df, ["k"], "at", ["id"], "n").collect()}
        assert [got[i] for i in range(8000) if i % 10] == list(range(1, 7201))
        probes = df.where("id % 10 = 3").select("k", F.col("id").alias("p"), "at")
        versions_ = df.where("id % 10 = 5").select("k", F.col("id").alias("fact_id"), F.col("at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
        found = versions.as_of_join(probes, versions_, ["k"], "at").collect()
        assert len(found) == 800 and {r.fact_id for r in found} == {7995}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_as_of_join_is_half_open(spark):
    v = spark.createDataFrame([(1, 10, ts(1), ts(5)), (1, 11, ts(5), ts(9)), (1, 12, ts(20), None)],
                              "k long, fact_id long, f string, u string").select(
        "k", "fact_id", F.col("f").cast("timestamp").alias("valid_from"),
        F.col("u").cast("timestamp").alias("valid_until"))
    p = spark.createDataFrame([(1, d, ts(d)) for d in (1, 4, 5, 8, 9, 19, 20, 28)],
                              "k long, p long, at string").withColumn(
        "at", F.col("at").cast("timestamp"))
    got = {r.p: r.fact_id for r in versions.as_of_join(p, v, ["k"], "at").collect()}
    assert got == {1: 10, 4: 10, 5: 11, 8: 11, 20: 12, 28: 12}


def test_keyset_pages_cover_all_rows_once_with_equal_times(spark):
    rows = spark.createDataFrame([("t", i, ts(1 + i // 7)) for i in range(45)],
                                 "tenant_id string, fact_id long, at string").withColumn(
        "created_at", F.col("at").cast("timestamp"))
    seen, cursor, more = [], (None, None), True
    while more:
        req = spark.createDataFrame([("p", "t", 10, *cursor)],
                                    "page_id string, tenant_id string, page_limit int, "
                                    "cursor_ts timestamp, cursor_id long")
        page = grouping.keyset_page(rows, req, ("tenant_id",), "created_at", "fact_id").orderBy(
            "position").collect()
        seen += [r.fact_id for r in page]
        cursor, more = (page[-1].created_at, page[-1].fact_id), page[-1].has_more
    assert seen == [r.fact_id for r in rows.orderBy(
        F.col("created_at").desc(), F.col("fact_id").desc()).collect()]


def test_top_k_plans_a_map_side_limit(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = grouping.top_k(df, ["k"], [F.col("id").desc()], 5)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 15


def plain_holds(c, query, types, near):
    if not isinstance(c, dict):
        return False
    parts_all, parts_any = (c.get(k) if isinstance(c.get(k), list) else None for k in ("AND", "OR"))
    if parts_all:
        return all(plain_holds(p, query, types, near) for p in parts_all)
    if parts_any:
        return any(plain_holds(p, query, types, near) for p in parts_any)
    words = [w for k in ("topic_match", "keyword_any") for w in c.get(k) or [] if w is not None]
    test = c.get("semantic_similarity") or {}
    return (any(w.lower() in query.lower() for w in words) or any(t.lower() in types for t in c.get("entity_present") or [])
            or ("threshold" in test and near.get(test.get("text"), 0.0) >= test["threshold"]))


def test_conditions_of_any_depth(spark):
    rnd = random.Random(3)
    leaves = [{"topic_match": ["Billing"]}, {"keyword_any": ["refund", "a"]}, {"entity_present": ["Person"]}, {"entity_present": ["robot"]},
              {"semantic_similarity": {"text": "x", "threshold": 0.9}}, {"semantic_similarity": {"text": "} {", "threshold": 0.9}},
              {"semantic_similarity": {"text": "none", "threshold": 0.0}}, {}, {"topic_match": ["ill", "\u00fcber"], "keyword_any": None},
              {"topic_match": [""]}, {"keyword_any": ["zz", "q"]}, 7, {"AND": [], "topic_match": ["b"]}]

    def made(depth):
        if depth == 0:
            return rnd.choice(leaves)
        parts = [made(rnd.randrange(depth)) for _ in range(rnd.choice([0, 1, 2, 3]))] + [made(depth - 1)]
        rnd.shuffle(parts)
        return {rnd.choice(["AND", "OR", "OR"]): parts, **rnd.choice([{}, {"topic_match": ["a"]}])}

    conditions = [made(depth) for depth in (0, 0, 0, 1, 1, 2, 3, 4, 6, 6, 12) for _ in range(12)] + [{"OR": [leaves[0], leaves[0]]}]
    texts = [json.dumps(c) for c in conditions]
    broken = ['{"AND":[', "not json", None]
    rows = [(f"g{i}", "t", "user", "s" if i % 5 else "other", i != 3, i % 3, c) for i, c in enumerate(texts + broken)]
    stored = spark.createDataFrame(rows, "trigger_id string, tenant_id string, scope string, scope_id string, active boolean, priority int, condition string").withColumn(
        "text_vectors", F.create_map(F.lit("x"), F.array(F.lit(1.0), F.lit(0.0)), F.lit("} {"), F.array(F.lit(0.0), F.lit(1.0))))
    asked = [("q1", "a billing question", [1.0, 0.0]), ("q2", "\u00dcBER all", [0.0, 1.0]), ("q3", "", [0.0, 0.0]), ("q4", "refund", None), ("q5", "zz top", [0.5, 0.5])]
    near = {"q1": {"x": 1.0}, "q2": {"} {": 1.0}}
    queries = spark.createDataFrame([(i, "t", "user", "s", q, v) for i, q, v in asked],
                                    "query_id string, tenant_id string, scope string, scope_id string, query string, embedding array<double>")
    entities = spark.createDataFrame([("t", "PERSON"), ("t", None), ("u", "robot")], "tenant_id string, entity_type string")
    got = {(r.query_id, r.trigger_id) for r in triggers.matched_triggers(queries, stored, entities).collect()}
    want = {(q, f"g{n}") for q, text, _ in asked for n, c in enumerate(conditions)
            if n != 3 and n % 5 and plain_holds(c, text, {"person"}, near.get(q, {}))}
    assert got == want and len(want) > 50
    assert {r.condition for r in triggers.condition_errors(stored).collect()} == set(broken[:2])
    assert triggers.matched_triggers(queries, stored.limit(0), entities).count() == 0


def test_merge_keeps_best_scores_first_source_last_trigger(spark):
    rows = [(1, 7, "vector", 0, 2, .4, .0, .0, None), (1, 7, "keyword", 1, 1, .0, .9, .0, None),
            (1, 7, "trigger", 3, 1, .0, .0, .0, "g1"), (1, 7, "trigger", 3, 5, .8, .0, .0, "g2")]
    df = spark.createDataFrame(rows, "query_id long, fact_id long, source string, stream int, "
                               "position long, vector_score double, keyword_score double, "
                               "graph_score double, triggered_by string")
    r = ranking.merge_candidates(df).first()
    assert (r.vector_score, r.keyword_score, r.source, r.triggered_by) == (.8, .9, "vector", "g2")


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((400, 4000, 4))],
                               "query_id long, rank int, content string").withColumn(
        "source_chunk", F.lit(None).cast("string"))
    assert [r.rank for r in ranking.token_budget(df, 150).collect()] == [0]
    assert ranking.token_budget(df, 50).count() == 0
    assert ranking.token_budget(df, 50, keep_first=True).count() == 1


def test_newest_version_and_update_suppression(spark):
    df = spark.createDataFrame(
        [(1, 10, 5, ts(1), 1, "{}"), (1, 11, 5, ts(2), 2, "{}"), (1, 12, None, ts(1), 3, "{}"),
         (1, 13, 6, ts(1), 4, '{"relationType":"updates","relatedFactId":12}')],
        "query_id long, fact_id long, lineage_id long, c string, rank int, metadata string"
    ).withColumn("created_at", F.col("c").cast("timestamp"))
    kept = ranking.drop_updated(ranking.newest_per_lineage(df))
    assert sorted(r.fact_id for r in kept.collect()) == [11, 13]


def test_mentions_equal_substring_search(spark):
    rng = random.Random(3)
    words = ["ann", "annual", "red", "redo", "big plan", "plan", "user", "ed", "box 12", "x"]
    entities = spark.createDataFrame(
        [("t", f"e{i}", w) for i, w in enumerate(words)] + [("u", "other", "red")],
        "tenant_id string, entity_id string, canonical_name string")
    texts = [" ".join(rng.choice(["Annual", "redone", "the big", "plan,", "big plan.", "box 123",
                                  "user", "xx", "a user b", "User says"]) for _ in range(6))
             for _ in range(40)]
    facts = spark.createDataFrame([("t", i, s) for i, s in enumerate(texts)],
                                  "tenant_id string, fact_id long, content string")
    want = set()
    for i, s in enumerate(texts):
        low = s.lower()
        for j, w in enumerate(words):
            hit = (low.startswith("user ") or " user " in low) if w == "user" else (
                len(w) >= 3 and w in low)
            if hit:
                want.add((i, f"e{j}"))
    got = {(r.fact_id, r.entity_id) for r in linking.mentioned_entities(facts, entities).collect()}
    assert got == want


def test_bm25_all_terms_mode_and_normalisation(spark):
    scope = ("t", "user", "s")
    facts = spark.createDataFrame(
        [(*scope, 1, "red apple pie"), (*scope, 2, "red red car"), (*scope, 3, "blue car"),
         ("t", "user", "elsewhere", 4, "red apple")],
        "tenant_id string, scope string, scope_id string, fact_id long, content string"
    ).withColumn("valid_until", F.lit(None).cast("timestamp"))
    queries = spark.createDataFrame([(*scope, 1, "the red apple?")],
                                    "tenant_id string, scope string, scope_id string, "
                                    "query_id long, query string")
    some = keyword_search.keyword_search(queries, facts).orderBy("position").collect()
    assert [r.fact_id for r in some] == [1, 2] and some[0].keyword_score == 1.0
    every = keyword_search.keyword_search(queries, facts, match_all=True).collect()
    assert [r.fact_id for r in every] == [1]


def test_exact_search_against_brute_force_in_one_hot_scope(spark):
    rng = random.Random(1)
    vecs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(600)]
    facts = spark.createDataFrame(
        [("t", "user", "s", i, v) for i, v in enumerate(vecs)],
        "tenant_id string, scope string, scope_id string, fact_id long, embedding array<float>"
    ).withColumn("valid_until", F.lit(None).cast("timestamp"))
    queries = spark.createDataFrame([("t", "user", "s", q, vecs[q]) for q in range(5)],
                                    "tenant_id string, scope string, scope_id string, "
                                    "query_id long, embedding array<float>")
    got = vector_search.vector_search(queries, facts, 7).orderBy("query_id", "position").collect()

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n

    for q in range(5):
        order = sorted(range(600), key=lambda i: (-round(cos(vecs[q], vecs[i]), 6), i))[:7]
        assert [r.fact_id for r in got if r.query_id == q] == order


def test_purge_cascades(spark):
    facts = spark.createDataFrame([("t", "user", "a", 1, 9), ("t", "user", "b", 2, 8)],
                                  "tenant_id string, scope string, scope_id string, fact_id long, "
                                  "extraction_id long")
    links = spark.createDataFrame([(1, "e"), (2, "e")], "fact_id long, entity_id string")
    edges = spark.createDataFrame([("x", 1), ("y", None), ("z", 2)], "edge_id string, fact_id long")
    jobs = facts.select("tenant_id", "scope", "scope_id", "extraction_id")
    left = mutations.purge_scope({"facts": facts, "fact_entities": links, "edges": edges,
                                  "extractions": jobs}, facts.where("scope_id = 'a'"))
    assert {n: df.count() for n, df in left.items()} == {
        "facts": 1, "fact_entities": 1, "edges": 2, "extractions": 1}


def test_deadlines_cascade_once(spark):
    def edge(relation, s, t=None, due=None):
        body = f'"sourceFactId":{s}' + (f',"targetFactId":{t}' if t else "") + (
            f',"deadline":"{due}"' if due else "")
        return ("t", relation, "{" + body + "}")
    edges = spark.createDataFrame(
        [edge("precedes", 1, 2), edge("precedes", 2, 3), edge("deadline", 3, None, "May"),
         edge("depends_on", 3, 4)], "tenant_id string, relation string, metadata string")
    labels = spark.createDataFrame([("t", i, i, f"P{i}") for i in (1, 2, 3, 4)],
                                   "tenant_id string, fact_id long, priority_order int, label string")
    got = {(r.fact_id, r.kind, r.value) for r in profiles.dependencies(edges, labels).collect()}
    assert got == {
        (1, "blocks", "P2"), (2, "blocked_by", "P1"), (2, "blocks", "P3"), (3, "blocked_by", "P2"),
        (3, "blocked_by", "P4"), (4, "blocks", "P3"), (3, "deadline", "May"),
        (2, "deadline", "May (cascaded)"),
        (4, "deadline", "May (implicit — blocks deadline item)")}


def test_signal_turns_and_fallback(spark):
    rows = [("a", i, t) for i, t in enumerate(["hi", "ok", "please remember", "bye"])] + [
        ("b", i, t) for i, t in enumerate(["one", "two", "three"])]
    df = spark.createDataFrame(rows, "session_id string, turn_number long, content string")
    got = sorted((r.session_id, r.turn_number) for r in conversations.signal_turns(df).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_pages_hold_as_many_rows_as_asked_for(spark):
    rows = spark.range(300).select(F.lit("t").alias("tenant_id"), F.col("id"), F.timestamp_seconds("id").alias("ts"))
    asked = spark.createDataFrame([("big", "t", 200, None, None), ("all", "t", 300, None, None)],
                                  "page_id string, tenant_id string, page_limit int, cursor_ts timestamp, cursor_id long")
    got = grouping.keyset_page(rows, asked, ["tenant_id"], "ts", "id").groupBy("page_id", "has_more").count().collect()
    assert sorted((r.page_id, r["count"], r.has_more) for r in got) == [("all", 300, False), ("big", 200, True)]


def test_first_wins_keeps_what_follows_a_dropped_one(spark):
    rnd = random.Random(6)
    pairs = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(110)) if a < b} | {(n, n + 1) for n in range(100, 130)}
    stays = {}
    for later in range(131):
        stays[later] = not any(stays[a] for a, b in pairs if b == later)
    got = {r.later for r in vector_search.first_wins(spark.createDataFrame(sorted(pairs), "earlier long, later long")).collect()}
    assert got == {n for n, keeps in stays.items() if not keeps}
    assert vector_search.first_wins(spark.createDataFrame([], "earlier long, later long")).count() == 0


def test_equal_text_is_a_duplicate_however_many_are_near(spark):
    stored = spark.createDataFrame(
        [("t", "user", "s", n, f"Fact {n} ", [1.0, n / 1000], None, None) for n in range(20)] + [("t", "user", "s", 99, "No vector", None, None, None),
                                                                                               ("t", "user", "s", 98, "Closed", [1.0, 0.0], "2024-01-02", None)],
        "tenant_id string, scope string, scope_id string, fact_id long, content string, embedding array<double>, valid_until string, valid_from string")
    rows = [(5, "fact 19", [1.0, 0.0], None), (1, "New one", [0.0, 1.0], "add"), (2, " new ONE", [0.0, -1.0], "add"), (3, "no vector", None, "add"),
            (4, "closed", None, "add"), (6, "fact 19", None, "update"), (7, None, None, "add"), (8, None, [0.0, 1.0], "add"), (0, "Near", [0.0, 1.0], "add")]
    batch = spark.createDataFrame([("t", "user", "s", *r) for r in rows], "tenant_id string, scope string, scope_id string, query_id long, content string, embedding array<double>, operation string")
    got = {r.query_id: r.operation for r in vector_search.deduplicate(batch, stored).collect()}
    assert got == {5: "noop", 1: "add", 2: "noop", 3: "noop", 4: "add", 6: "update", 7: "add", 8: "add", 0: "add"}
    near = {r.query_id: r.operation for r in vector_search.deduplicate(batch, stored, same_similarity=0.99).collect()}
    assert near == {**got, 1: "noop", 8: "noop"}


def test_keyword_pairs_of_an_entity_equal_brute_force(spark):
    rnd = random.Random(9)
    words = ["train", "rain", "plan", "nation", "order", "window", "seven", "eight", "the", "and"]
    rows = [("t", n, f"2024-01-{1 + n % 4:02d}", ["scratchpad"] if n % 11 == 0 else ["note"], " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 8])))) for n in range(150)]
    facts = spark.createDataFrame(rows, "tenant_id string, fact_id long, created_at string, tags array<string>, content string")
    entities = spark.createDataFrame([("t", "e1", "hub"), ("t", "e2", "side"), ("t", "e3", "user")], "tenant_id string, entity_id string, canonical_name string")
    of = {"e1": range(0, 150), "e2": range(0, 150, 7), "e3": range(150)}
    links = spark.createDataFrame([(n, e) for e, ns in of.items() for n in ns] * 2, "fact_id long, entity_id string")
    sets = {r[1]: {w for w in r[4].split() if len(w) >= 3 and w not in ("the", "and")} for r in rows}

    def near(a, b):
        return min(len(sets[a]), len(sets[b])) > 0 and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.4

    want = {}
    for e in ("e2", "e1"):
        for a in of[e]:
            for b in of[e]:
                if len(sets[a]) >= 2 and b % 11 and (rows[b][2], b) < (rows[a][2], a) and near(a, b):
                    want[a, b] = e
    for size in (512, 20):
        whole = linking.keyword_pairs
        try:
            linking.keyword_pairs = lambda *a, **k: whole(*a, **k, rows_at_once=size)
            got = {(r.source_fact_id, r.target_fact_id): r.source_id for r in linking.all_cross_links(facts, links, entities, min_overlap=0.4).collect()}
        finally:
            linking.keyword_pairs = whole
        assert got == want and len(want) > 1000
    new = facts.where("fact_id >= 120")
    some = linking.cross_links(new, facts, links, entities, page=60, per_entity=3, min_overlap=0.4).collect()
    newest = sorted(range(150), key=lambda n: (rows[n][2], n), reverse=True)[:60]
    for a in range(120, 150):
        hub = [b for b in newest if b < 120 and b % 11 and near(a, b)][:3] if len(sets[a]) >= 2 else []
        assert {r.target_fact_id for r in some if r.source_fact_id == a and r.source_id == "e1"} == set(hub)

"""Steps whose work or traffic must not grow faster than their input or output."""

import random

from pyspark.sql import functions as F

from mnemoframe.operators import keyword_search, linking, ranking, vector_blocks, vector_search
from mnemoframe.operators.lookups import SCOPE

WORDS = ["train", "rain", "plan", "nation", "order", "window", "seven", "eight"]


def _memory(spark, n, seed=3):
    rnd = random.Random(seed)
    rows = [("t", i, f"2024-01-{1 + i % 5:02d}", ["note"], " ".join(rnd.choices(WORDS, k=rnd.choice([1, 2, 5])))) for i in range(n)]
    facts = spark.createDataFrame(rows, "tenant_id string, fact_id long, created_at string, tags array<string>, content string")
    entities = spark.createDataFrame([("t", "e1", "hub"), ("t", "e2", "side")], "tenant_id string, entity_id string, canonical_name string")
    links = spark.createDataFrame([(i, "e2") for i in range(n)] + [(i, "e1") for i in range(0, n, 3)], "fact_id long, entity_id string")
    return facts, links, entities


def test_pairs_of_facts_are_not_shuffled_for_one_edge_each(spark):
    facts, links, entities = _memory(spark, 60)
    got = linking.all_cross_links(facts, links, entities, min_overlap=0.4)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert 0 <= plan.index("MapInArrow") < plan.index("Exchange")
    twice = linking.all_cross_links(facts.unionByName(facts.where("fact_id = 7")), links, entities, min_overlap=0.4)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, twice.collect())) and {r[1] for r in rows} == {"e1", "e2"} and len({r[-2:] for r in rows}) == len(rows)


def test_a_fact_moves_a_few_times_with_its_words_in_little_room(spark, monkeypatch):
    facts, links, entities = _memory(spark, 90)
    want = sorted((r.source_fact_id, r.target_fact_id) for r in linking.all_cross_links(facts, links, entities, min_overlap=0.4).collect())
    monkeypatch.setattr(linking, "BLOCK_FACTS", 8)  # in this process: for the blocks, and for the pieces below
    kind, moved = type(facts), []
    whole = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *a: (moved.append(df) if "_left" in df.columns else None, whole(df, *a))[1])
    pairs = linking.all_cross_links(facts, links, entities, min_overlap=0.4)
    assert sorted((r.source_fact_id, r.target_fact_id) for r in pairs.collect()) == want and len(want) > 500
    copies = moved[0].groupBy("entity_id", "fact_id").count()
    assert copies.agg(F.max("count")).first()[0] == 2 and "words" not in moved[0].columns
    words = linking.PackedWords(facts)
    known, hashes = words.known.value, {r.fact_id: r.h for r in facts.select("fact_id", F.transform(
        linking.keyword_set(F.col("content")), lambda w: F.xxhash64(w)).alias("h")).collect()}
    words.known = spark.sparkContext.broadcast(known[::2])  # the others stay whole
    for rows, table in ((words.rows.collect(), known), (words._rows(facts.select("tenant_id", "fact_id", "created_at", F.lit(True).alias("target"), F.transform(
            linking.keyword_set(F.col("content")), lambda w: F.xxhash64(w)).alias("words"))).collect(), known[::2])):
        assert {r.fact_id: sorted([int(table[c + (1 << 15)]) for c in r.common] + r.rare) for r in rows} == {n: sorted(h) for n, h in hashes.items()}
        assert all(r.source == (len(hashes[r.fact_id]) >= 2) for r in rows)
    held = linking.PackedWords(facts).known
    cells = moved[0].orderBy("tenant_id", "entity_id", "_left", "_right", "_side", F.desc("created_at"), F.desc("fact_id")).toArrow().to_batches()
    names = [f"c{n}" for n in range(7)]
    found = [pair for b in linking._cells(iter(cells), names, 0.4, held, None) for pair in zip(b.column("c3").to_pylist(), b.column("c4").to_pylist())]
    assert sorted(found) == want


def test_newest_pairs_meet_older_windows_only_where_they_lack_some(spark, monkeypatch):
    facts, links, entities = _memory(spark, 200)
    rows = linking._with_words(facts.join(linking._named_links(links, entities, ("user",)), ["tenant_id", "fact_id"]))
    new, old = rows.where("fact_id >= 150 AND size(words) >= 2"), rows.where("fact_id < 150")
    key = ["tenant_id", "entity_id", "source_fact_id"]
    every = linking.keyword_pairs(new, old, 0.5)
    want = {tuple(r) for r in linking.top_k(every, key, linking._newest(), 3).collect()}
    met, whole = [], linking.keyword_pairs
    monkeypatch.setattr(linking, "keyword_pairs", lambda a, b, *c, **d: (met.append((a.count(), b.count())), whole(a, b, *c, **d))[1])
    assert {tuple(r) for r in linking.newest_pairs(new, old, 0.5, 3, first=4).collect()} == want and len(want) > 50
    assert sum(b for _, b in met) <= old.count() and met[-1][0] < new.count() and len(met) > 1


def _vectors(spark, n, seed=5):
    rnd = random.Random(seed)
    rows = [("t", "user", "s" if i % 3 else "z", i, None if i % 17 == 0 else [rnd.gauss(0, 1) for _ in range(2 if i % 13 == 0 else 4)]) for i in range(n)]
    return spark.createDataFrame(rows, "tenant_id string, scope string, scope_id string, query_id long, embedding array<double>").withColumn(
        "_place", F.struct(F.col("query_id").alias("order"), F.col("query_id").alias("id")))


def test_more_queries_than_travel_meet_the_vectors_in_blocks(spark, monkeypatch):
    asked = _vectors(spark, 120)
    stored = _vectors(spark, 150, seed=6).withColumnRenamed("query_id", "fact_id")
    monkeypatch.setattr(vector_blocks, "QUERY_ROWS", 5)
    monkeypatch.setattr(vector_blocks, "CELL_ROWS", 16)
    monkeypatch.setattr(vector_blocks, "CELL_ROWS_OF_PAIRS", 16)
    monkeypatch.setattr(vector_search, "salted_join", None)  # the join of all vectors is not used
    got = vector_search.nearest(asked, stored, SCOPE, "fact_id", 4, 0.2)
    pairs = vector_search.similar_pairs(asked, stored, SCOPE, "fact_id", 0.2)
    monkeypatch.undo()
    want = vector_search.joined_pairs(asked, stored, SCOPE, "fact_id", 0.2)
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in want.select("query_id", "fact_id", "similarity").collect()}
    best = linking.top_k(want, ["query_id"], [F.col("similarity").desc(), F.col("fact_id")], 4, rank="position")
    columns = ["query_id", "fact_id", "similarity", "position"]
    assert {tuple(r) for r in got.select(*columns).collect()} == {tuple(r) for r in best.select(*columns).collect()}


def test_rows_near_an_earlier_one_go_without_a_table_of_pairs(spark, monkeypatch):
    rows = _vectors(spark, 150)
    for least in (0.9, 0.3, 0.0):
        want = {r.later for r in vector_search.first_wins(vector_search._earlier_neighbours(rows, least)).collect()}
        with monkeypatch.context() as patched:
            patched.setattr(vector_search, "first_wins", None)
            patched.setattr(vector_search, "CELL_ROWS", 16)
            got = [r.query_id for r in vector_search.near_earlier(rows, least, heads=20).collect()]
        assert set(got) == want and len(got) == len(want) and want
    both = rows.unionByName(rows.where("query_id = 4").withColumn("scope_id", F.lit("z")))
    want = {r.later for r in vector_search.first_wins(vector_search._earlier_neighbours(both, 0.9)).collect()}
    assert {r.query_id for r in vector_search.near_earlier(both, 0.9).collect()} == want


def test_names_are_found_anywhere_without_pieces_of_every_word(spark, monkeypatch):
    rnd = random.Random(8)
    names = ["anna lee", "lee", "large ring 7", "large ring 71", " été ", "a  b", "x" * 40, "nation"]
    texts = ["", None, "LARGE RING 71 here", "banna leeds", "un ÉTÉ 🙂 long", "a  b", "y" + "X" * 41] + [
        " ".join(rnd.choices(["large", "ring", "7", "71", "lee", "anna", "internationale"], k=9)) for _ in range(30)]
    facts = spark.createDataFrame([(f"t{n % 2}", n, text) for n, text in enumerate(texts + texts)], "tenant_id string, fact_id long, content string")
    entities = spark.createDataFrame([(f"t{k}", f"e{k}-{n}", name) for k in (0, 1) for n, name in enumerate(names)], "tenant_id string, entity_id string, canonical_name string")
    want = {(n, f"e{n % 2}-{m}") for n, text in enumerate(texts + texts) for m, name in enumerate(names) if text and name in text.lower()}
    found = linking.mentioned_entities(facts, entities)
    got = [(r.fact_id, r.entity_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and {m for _, m in want} >= {"e0-4", "e0-5", "e0-7"}
    assert "array_distinct" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_where_the_texts_lie(spark):
    facts = spark.createDataFrame([("t", "user", "s", n, text) for n, text in enumerate(["red red blue", "", None, "blue the x", "red"])],
                                  "tenant_id string, scope string, scope_id string, fact_id long, content string")
    counts = keyword_search.term_counts(facts)
    columns = [*SCOPE, "fact_id", "term", "tf", "dl"]
    assert {tuple(r) for r in counts.select(*columns).collect()} == {tuple(r) for r in keyword_search.postings(facts).select(*columns).collect()}
    assert "Exchange" not in counts._jdf.queryExecution().toString()


def test_other_facts_go_before_their_texts_are_moved(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 99)], "query_id long, fact_id long")
    facts = spark.createDataFrame([(n, f"text {n}") for n in (7, 7, 8, 9)], "fact_id long, content string")
    got = ranking.with_fact_fields(rows, facts, ("content",))
    assert sorted(map(tuple, got.collect())) == [(7, 1, "text 7")] * 2 + [(7, 2, "text 7")] * 2 + [(8, 2, "text 8")]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_facts_without_a_text_or_tags_are_no_error(spark):
    facts, links, entities = _memory(spark, 30)
    odd = facts.withColumns({"content": F.when(F.col("fact_id") != 4, F.col("content")), "tags": F.when(F.col("fact_id") != 5, F.col("tags"))})
    got = linking.all_cross_links(odd, links, entities, min_overlap=0.4).collect()
    whole = linking.all_cross_links(facts, links, entities, min_overlap=0.4).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in whole if 4 not in r[-2:] and r.target_fact_id != 5}

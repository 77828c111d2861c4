"""Vector, keyword, graph, trigger and fused search over all requests."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from mnemoframe.functions import dates, fixed_values as fv, scoring
from mnemoframe.operators import (
    graph, keyword_index, keyword_search as kw, lookups, ranking, triggers, vector_index, vector_search as vs)
from mnemoframe.plans.search import Memory, SearchOptions, access_records, candidates, search
from mnemoframe.session import shared_folder
from workload import fragments as fr
from workload.registry import query
from workload.views import AS_OF, NOW, Tables

SIX = [f"round({s}_score, 6) AS {s}_score" for s in fv.SIGNALS]


def request_triggers(t: Tables):
    """The triggers view in the layout the operators read."""
    return t.triggers.select(
        "trigger_id", "tenant_id", "scope", "scope_id", "active", "priority", "condition",
        F.array("fact_a", "fact_b").alias("fact_ids"),
        F.array("watched_entity").alias("entity_ids"),
        F.create_map("vector_text", "vector").alias("text_vectors"),
        F.when(F.col("priority") > 0, F.col("vector")).alias("template_embedding"),
        "times_fired")


def memory(t: Tables) -> Memory:
    return Memory(t.facts, t.entities, t.edges, t.fact_entities, request_triggers(t))


@query("vec_topk", f"WITH {fr.vector_cte('v', 10, 0.0)} SELECT query_id, fact_id, round(similarity, 6) AS similarity, position FROM v")
def _(t):
    return vs.vector_search(t.requests, t.facts).withColumn("similarity", F.round("similarity", 6))


@query("vec_topk_as_of", f"WITH {fr.vector_cte('v', 10, 0.05, as_of=AS_OF)} SELECT query_id, fact_id, round(similarity, 6) AS similarity, position FROM v")
def _(t):
    return vs.vector_search(t.requests, t.facts, 10, 0.05, t.as_of).withColumn(
        "similarity", F.round("similarity", 6))


def stored_index(t: Tables) -> vector_index.Index:
    """The open facts in a new coarse index."""
    facts = t.facts.where(lookups.valid_at())
    return vector_index.write(facts, vector_index.fit(facts, "fact_id"), f"{shared_folder(t.spark)}/cells-{uuid.uuid4().hex}")


@query("vec_topk_probed")
def _(t):
    return vector_index.search(t.requests, stored_index(t)).withColumn("similarity", F.round("similarity", 6))


@query("vec_topk_all_cells", f"WITH {fr.vector_cte('v', 10, 0.0)} SELECT query_id, fact_id, round(similarity, 6) AS similarity, position FROM v")
def _(t):
    index = stored_index(t)
    return vector_index.search(t.requests, index, probes=index.cells).withColumn("similarity", F.round("similarity", 6))


@query("vec_probed_recall", f"WITH {fr.vector_cte('v', 10, 0.0)} SELECT CAST(count(DISTINCT query_id) AS BIGINT) AS queries, CAST(count(*) AS BIGINT) AS wanted, true AS nine_tenths FROM v")
def _(t):
    found = vector_index.search(t.requests, stored_index(t))
    return vector_index.recall(found, vs.vector_search(t.requests, t.facts)).agg(
        F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"),
        (F.sum("met") >= 0.9 * F.sum("wanted")).alias("nine_tenths"))


@query("vec_similarity_join", f"""SELECT r.query_id, f.fact_id, round({fr.cosine('f.embedding', 'r.embedding')}, 6) AS similarity
  FROM requests r JOIN facts f USING ({fr.S}) WHERE f.embedding IS NOT NULL AND round({fr.cosine('f.embedding', 'r.embedding')}, 9) >= 0.1""")
def _(t):
    return vs.similar_pairs(t.requests, t.facts, fr.S.split(", "), "fact_id", 0.1).withColumn(
        "similarity", F.round("similarity", 6))


@query("vec_match_entities", f"""WITH p AS (SELECT r.query_id, e.entity_id, round({fr.cosine('e.embedding', 'r.embedding')}, 9) AS similarity FROM requests r JOIN entity_vectors e USING (tenant_id))
  SELECT query_id, entity_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entity_id) AS position FROM p WHERE similarity >= 0.3
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entity_id) <= 10""")
def _(t):
    return vs.match_entities(t.requests, t.entity_vectors).withColumn(
        "similarity", F.round("similarity", 6))


@query("kw_bm25", f"WITH {fr.bm25_cte('b', 10)} SELECT query_id, fact_id, round(raw_score, 6) AS raw_score, round(keyword_score, 6) AS keyword_score, position FROM b")
def _(t):
    return kw.keyword_search(t.requests, t.facts).withColumns(
        {"raw_score": F.round("raw_score", 6), "keyword_score": F.round("keyword_score", 6)})


@query("kw_bm25_all_terms_as_of", f"WITH {fr.bm25_cte('b', 10, as_of=AS_OF, match_all=True).replace(fr.terms('query'), fr.terms(chr(39) + 'thing nation ' + chr(39) + ' || regexp_extract(query, ' + chr(39) + 'nation_.*' + chr(39) + ')'))} SELECT query_id, fact_id, round(raw_score, 6) AS raw_score, position FROM b")
def _(t):
    asked = t.requests.withColumn("query", F.concat(
        F.lit("thing nation "), F.regexp_extract("query", "nation_.*", 0)))
    return kw.keyword_search(asked, t.facts, 10, t.as_of, match_all=True).select(
        "query_id", "fact_id", F.round("raw_score", 6).alias("raw_score"), "position")


@query("kw_bm25_stored", f"WITH {fr.bm25_cte('b', 10)} SELECT query_id, fact_id, round(raw_score, 6) AS raw_score, round(keyword_score, 6) AS keyword_score, position FROM b")
def _(t):
    path = f"{shared_folder(t.spark)}/keywords-{uuid.uuid4().hex}"
    keyword_index.write(t.facts.where(lookups.valid_at()), path)
    return keyword_index.search(t.spark, t.requests, path).withColumns(
        {"raw_score": F.round("raw_score", 6), "keyword_score": F.round("keyword_score", 6)})


@query("kw_postings_stats", f"""WITH d AS (SELECT {fr.S}, fact_id, {fr.terms('content')} AS ts FROM facts),
  p AS (SELECT {fr.S}, fact_id, term, count(*) AS tf FROM (SELECT {fr.S}, fact_id, unnest(ts) AS term FROM d) GROUP BY ALL)
  SELECT {fr.S}, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY ALL""")
def _(t):
    return kw.postings(t.facts).groupBy("tenant_id", "scope", "scope_id", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("compound_search", f"""WITH {fr.vector_cte('v', 30, 0.25, fr.SEARCHABLE)}, {fr.bm25_cte('b', 30, fr.SEARCHABLE)}
  SELECT query_id, fact_id, 'vector' AS source, round(similarity, 6) AS score, position FROM v
  UNION ALL SELECT query_id, fact_id, 'keyword', round(keyword_score, 6), position FROM b""")
def _(t):
    return kw.compound_search(t.requests, t.facts, 30).withColumn("score", F.round("score", 6))


@query("graph_seeds", f"WITH {fr.seeds_cte()} SELECT * FROM seeds")
def _(t):
    return graph.seed_entities(t.requests, t.entities)


@query("graph_traverse", f"WITH RECURSIVE {fr.seeds_cte()}, {fr.reach_cte(depth=3, cap=150)} SELECT query_id, tenant_id, entity_id, CAST(depth AS BIGINT) AS depth FROM reached")
def _(t):
    return graph.traverse(graph.seed_entities(t.requests, t.entities), t.edges, 3, 150).withColumn(
        "depth", F.col("depth").cast("long"))


@query("graph_traverse_edges", f"""WITH RECURSIVE {fr.seeds_cte()}, {fr.reach_cte(as_of=AS_OF)}
  SELECT a.query_id, e.edge_id, e.relation, round(e.weight, 6) AS weight FROM edges e JOIN reached a ON a.tenant_id = e.tenant_id AND a.entity_id = e.source_id
  JOIN reached b ON b.query_id = a.query_id AND b.tenant_id = e.tenant_id AND b.entity_id = e.target_id
  WHERE {fr.valid(AS_OF, 'e')} AND least(a.depth, b.depth) < 2""")
def _(t):
    reached = graph.traverse(graph.seed_entities(t.requests, t.entities), t.edges, as_of=t.as_of)
    return graph.traversed_edges(reached, t.edges, as_of=t.as_of).select(
        "query_id", "edge_id", "relation", F.round("weight", 6).alias("weight"))


@query("graph_all_nodes_two_hops", f"""WITH RECURSIVE seeds AS (SELECT entity_id AS query_id, tenant_id, entity_id FROM entities),
  {fr.reach_cte(depth=2, cap=500)} SELECT query_id, CAST(count(*) AS BIGINT) AS reached, CAST(sum(depth) AS BIGINT) AS depth_sum FROM reached GROUP BY ALL""")
def _(t):
    seeds = t.entities.select(F.col("entity_id").alias("query_id"), "tenant_id", "entity_id")
    return graph.traverse(seeds, t.edges, 2, 500, many_seeds=True).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("reached"), F.sum("depth").alias("depth_sum"))


@query("graph_facts_per_entity", f"WITH {fr.per_entity_cte('p', 20)} SELECT tenant_id, entity_id, fact_id, rank FROM p")
def _(t):
    return graph.facts_per_entity(t.facts, t.fact_entities, 20).select(
        "tenant_id", "entity_id", "fact_id", "rank")


@query("graph_search", f"WITH RECURSIVE {fr.seeds_cte()}, {fr.reach_cte()}, {fr.graph_facts_cte('g', 30)} SELECT query_id, fact_id, round(graph_score, 6) AS graph_score, position FROM g")
def _(t):
    return graph.graph_search(t.requests, t.entities, t.edges, t.facts, t.fact_entities, 30).withColumn(
        "graph_score", F.round("graph_score", 6))


@query("graph_view_nodes", """SELECT e.entity_id, e.canonical_name, e.entity_type, CAST(count(l.fact_id) AS BIGINT) AS fact_count
  FROM entities e LEFT JOIN fact_entities l USING (entity_id) GROUP BY ALL""")
def _(t):
    nodes, _links = graph.graph_view(t.entities, t.edges, t.fact_entities)
    return nodes.select("entity_id", "canonical_name", "entity_type", "fact_count")


@query("graph_view_links_filtered", """WITH n AS (SELECT tenant_id, entity_id FROM entities WHERE entity_type IN ('person', 'location') AND contains(lower(canonical_name), 'o'))
  SELECT e.edge_id, e.relation, e.edge_type FROM edges e SEMI JOIN n a ON a.entity_id = e.source_id AND a.tenant_id = e.tenant_id SEMI JOIN n b ON b.entity_id = e.target_id AND b.tenant_id = e.tenant_id""")
def _(t):
    _nodes, links = graph.graph_view(t.entities, t.edges, t.fact_entities,
                                     ["person", "location"], "O")
    return links.select("edge_id", "relation", "edge_type")


@query("graph_view_links", """SELECT e.relation, e.edge_type, CAST(count(*) AS BIGINT) AS links FROM edges e SEMI JOIN (SELECT * FROM entities WHERE entity_type IN ('person', 'organization')) a ON a.entity_id = e.source_id
  SEMI JOIN (SELECT * FROM entities WHERE entity_type IN ('person', 'organization')) b ON b.entity_id = e.target_id GROUP BY ALL""")
def _(t):
    _nodes, links = graph.graph_view(t.entities, t.edges, t.fact_entities,
                                     ["person", "organization"])
    return links.groupBy("relation", "edge_type").agg(F.count(F.lit(1)).alias("links"))


@query("trigger_match", f"WITH {fr.fired_cte()} SELECT query_id, trigger_id, CAST(priority AS BIGINT) AS priority FROM fired")
def _(t):
    return triggers.matched_triggers(t.requests, request_triggers(t), t.entities).withColumn(
        "priority", F.col("priority").cast("long"))


def deep_triggers(t: Tables):
    """The triggers inside six more levels, beside a word of their own; one of four is no JSON."""
    nested = F.concat(*[F.lit('{"AND":[{"OR":[' )] * 3, F.col("condition"), F.lit(',{"keyword_any":["ZZ"]}]},{"keyword_any":["N"]}]}'),
                      *[F.lit(']},{"topic_match":["a"]}]}')] * 2)
    number = F.substring("trigger_id", 2, 9).cast("int")
    return request_triggers(t).withColumn("condition", F.when(number % 4 == 3, '{"AND":[{"OR":[').otherwise(nested))


@query("trigger_match_deep", f"""WITH {fr.fired_cte()} SELECT f.query_id, f.trigger_id, CAST(f.priority AS BIGINT) AS priority FROM fired f JOIN requests r USING (query_id)
  WHERE CAST(substr(f.trigger_id, 2) AS INT) % 4 <> 3 AND contains(lower(r.query), 'n') AND contains(lower(r.query), 'a')""")
def _(t):
    return triggers.matched_triggers(t.requests, deep_triggers(t), t.entities).withColumn(
        "priority", F.col("priority").cast("long"))


@query("trigger_condition_errors", "SELECT tenant_id, trigger_id FROM triggers WHERE active AND CAST(substr(trigger_id, 2) AS INT) % 4 = 3")
def _(t):
    return triggers.condition_errors(deep_triggers(t)).select("tenant_id", "trigger_id")


@query("trigger_surface", f"WITH {fr.fired_cte()}, {fr.surfaced_cte()} SELECT query_id, fact_id, trigger_id, CAST(part AS BIGINT) AS part, round(vector_score, 6) AS vector_score FROM surfaced")
def _(t):
    trig = request_triggers(t)
    fired = triggers.matched_triggers(t.requests, trig, t.entities)
    return triggers.surfaced_facts(fired, t.requests, trig, t.facts, t.fact_entities).select(
        "query_id", "fact_id", "trigger_id", F.col("part").cast("long").alias("part"),
        F.round("vector_score", 6).alias("vector_score"))


def _streams(k: int = 30, as_of_sql: str | None = None) -> str:
    """CTEs up to ``cand``: the four streams with their positions, before reranking."""
    return f"""{fr.vector_cte('v', k, 0.25, fr.SEARCHABLE, as_of=as_of_sql)}, {fr.bm25_cte('b', k, fr.SEARCHABLE, as_of=as_of_sql)},
{fr.seeds_cte()}, {fr.reach_cte(as_of=as_of_sql)}, {fr.graph_facts_cte('g', k)}, {fr.fired_cte()}, {fr.surfaced_cte()},
cand AS (SELECT query_id, fact_id, 'vector' AS source, 0 AS stream, position, similarity AS vs, 0.0::DOUBLE AS ks, 0.0::DOUBLE AS gs, CAST(NULL AS VARCHAR) AS trig FROM v
  UNION ALL SELECT query_id, fact_id, 'keyword', 1, position, 0.0, keyword_score, 0.0, NULL FROM b
  UNION ALL SELECT query_id, fact_id, 'graph', 2, position, 0.0, 0.0, graph_score, NULL FROM g
  UNION ALL SELECT query_id, fact_id, 'trigger', 3, (1000000 - priority) * 10 + part, vector_score, 0.0, 0.0, trigger_id FROM surfaced),
sized AS (SELECT c.*, round({fr.cosine('f.embedding', 'r.embedding')}, 9) AS sim FROM cand c JOIN facts f USING (fact_id) JOIN requests r USING (query_id)),
blend AS (SELECT query_id, fact_id, source, stream, position, trig, ks,
  CASE WHEN source = 'vector' AND sim IS NOT NULL THEN round(vs * 0.6::DOUBLE + sim * 0.4::DOUBLE, 9) ELSE vs END AS vs,
  CASE WHEN source = 'graph' AND sim IS NOT NULL THEN round(gs * 0.6::DOUBLE + sim * 0.4::DOUBLE, 9) ELSE gs END AS gs FROM sized),
placed AS (SELECT * EXCLUDE (position), CASE WHEN source IN ('vector', 'graph') THEN row_number() OVER (PARTITION BY query_id, source ORDER BY -greatest(vs, gs), position, fact_id) ELSE position END AS position FROM blend)"""


def _scored(now_sql: str = NOW) -> str:
    """CTEs up to ``scored``: merged candidates with all six signals."""
    day = "86400000000.0::DOUBLE"
    lam = f"{-math.log(2) / 30!r}::DOUBLE"

    def age(col):
        return f"(epoch_us({now_sql}) - epoch_us({col})) / {day}"

    return f"""
merged AS (SELECT query_id, fact_id, max(vs) AS vector_score, max(ks) AS keyword_score, max(gs) AS graph_score,
  arg_min(source, stream * 100000000 + position) AS source, arg_max(trig, (position, trig)) FILTER (trig IS NOT NULL) AS triggered_by,
  min(stream * 100000000 + position) AS first_seen FROM placed GROUP BY ALL),
{fr.time_ref_cte(now=now_sql)},
dated AS (SELECT m.*, f.* EXCLUDE (fact_id, tenant_id, scope, scope_id, embedding), r.y, r.m, r.d, r.ordering,
  CASE WHEN y IS NOT NULL OR m IS NOT NULL OR d IS NOT NULL THEN
    abs(epoch_us(coalesce(event_date, document_date)) - epoch_us(CAST(make_date(coalesce(y, year({now_sql})), coalesce(m, 1), 1) + (coalesce(d, 15) - 1) AS TIMESTAMP)))::DOUBLE END AS gap
  FROM merged m JOIN facts f USING (fact_id) JOIN refs r USING (query_id)),
timed AS (SELECT *, CASE WHEN ordering IS NOT NULL AND y IS NULL AND m IS NULL AND d IS NULL THEN
    CASE WHEN event_date IS NULL THEN 0.0 ELSE 1.0::DOUBLE - (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN event_date IS NULL THEN 1 ELSE 0 END, CASE WHEN ordering = 'first' THEN epoch_us(event_date) ELSE -epoch_us(event_date) END, fact_id) - 1)
      / (count(event_date) OVER (PARTITION BY query_id))::DOUBLE END
  WHEN max(gap) OVER (PARTITION BY query_id) > 0 AND gap IS NOT NULL THEN 1.0::DOUBLE - gap / max(gap) OVER (PARTITION BY query_id) ELSE 0.0 END AS temporal_score FROM dated),
scored AS (SELECT *, 0.5::DOUBLE * coalesce(exp({lam} * {age('last_accessed')}), 0) + 0.5::DOUBLE * coalesce(exp({lam} * {age('created_at')}), 0) AS recency_raw,
  importance * least(1.0::DOUBLE, ln(1 + frequency::DOUBLE) / ln(51::DOUBLE)) AS salience_raw FROM timed),
sixed AS (SELECT * EXCLUDE (recency_raw, salience_raw), greatest(0, least(1, recency_raw)) AS recency_score, greatest(0, least(1, salience_raw)) AS salience_score FROM scored)"""


def _fused(limit: int = 10, weights=None) -> str:
    w = scoring.normalized_weights(weights)
    total = " + ".join(f"{s}_score * {x!r}::DOUBLE" for s, x in w.items())
    return f"""
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen, fact_id) AS rank FROM (SELECT *, round({total}, 9) AS score FROM sixed)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen, fact_id) <= {limit})"""


_DEDUP = """
latest AS (SELECT * FROM fused QUALIFY lineage_id IS NULL OR row_number() OVER (PARTITION BY query_id, lineage_id ORDER BY created_at DESC, rank) = 1),
kept AS (SELECT l.* FROM latest l ANTI JOIN (SELECT query_id, CAST(json_extract_string(metadata, '$.relatedFactId') AS BIGINT) AS fact_id FROM latest WHERE json_extract_string(metadata, '$.relationType') = 'updates') u
  ON u.query_id = l.query_id AND u.fact_id = l.fact_id)"""


@query("search_candidates_reranked", f"WITH RECURSIVE {_streams()} SELECT query_id, fact_id, source, position, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, round(gs, 6) AS graph_score, trig AS triggered_by FROM placed")
def _(t):
    return candidates(t.requests, memory(t), SearchOptions()).selectExpr(
        "query_id", "fact_id", "source", "position", "triggered_by",
        *[f"round({s}_score, 6) AS {s}_score" for s in ranking.RETRIEVED])


_SIX_SQL = ", ".join(SIX)


@query("search_fused", f"WITH RECURSIVE {_streams()}, {_scored()}, {_fused()} SELECT query_id, fact_id, rank, source, triggered_by, round(score, 6) AS score, {_SIX_SQL} FROM fused")
def _(t):
    rows = ranking.merge_candidates(candidates(t.requests, memory(t), SearchOptions()),
                                    ranking.FACT_FIELDS)
    refs = t.requests.select("query_id", dates.time_reference(F.col("query"), t.now).alias("time_ref"))
    rows = ranking.fuse(ranking.score_memory(ranking.score_time(rows, refs, t.now), t.now), 10)
    return rows.selectExpr("query_id", "fact_id", "rank", "source", "triggered_by",
                           "round(score, 6) AS score", *SIX)


_TIMELINE = """CASE WHEN o.fact_id IS NULL THEN NULL ELSE (SELECT CASE WHEN dd = 0 THEN 'Superseded on the same day' WHEN dd = 1 THEN 'Updated after 1 day'
   WHEN dd < 7 THEN 'Updated after ' || dd || ' days' WHEN dd < 30 THEN 'Changed over ~' || CAST(floor(dd / 7.0 + 0.5) AS BIGINT) || ' week' || CASE WHEN floor(dd / 7.0 + 0.5) = 1 THEN '' ELSE 's' END
   WHEN dd < 365 THEN 'Changed over ~' || CAST(floor(dd / 30.0 + 0.5) AS BIGINT) || ' month' || CASE WHEN floor(dd / 30.0 + 0.5) = 1 THEN '' ELSE 's' END
   ELSE 'Changed over ~' || CAST(floor(dd / 365.0 + 0.5) AS BIGINT) || ' year' || CASE WHEN floor(dd / 365.0 + 0.5) = 1 THEN '' ELSE 's' END END
   FROM (SELECT abs(CAST(floor((epoch_us({new}) - epoch_us({old})) / 86400000000.0 + 0.5) AS BIGINT)) AS dd)) END"""
TIMELINE = _TIMELINE.format(new="k.valid_from", old="o.valid_from")


@query("full_search", f"""WITH RECURSIVE {_streams()}, {_scored()}, {_fused()}, {_DEDUP}
  SELECT k.query_id, k.fact_id, k.rank, k.source, k.triggered_by, round(k.score, 6) AS score, {_SIX_SQL}, CAST(o.fact_id AS STRING) AS contradicted_fact_id, {TIMELINE} AS timeline
  FROM kept k LEFT JOIN facts o ON o.fact_id = k.contradicts_id AND k.contradiction_status <> 'none'""")
def _(t):
    return search(t.requests, memory(t), t.now).selectExpr(
        "query_id", "fact_id", "rank", "source", "triggered_by", "round(score, 6) AS score", *SIX,
        "CAST(contradicted_fact_id AS STRING) AS contradicted_fact_id", "timeline")


_W = {"vector": 0.5, "keyword": 0.3, "graph": 0.2}


@query("full_search_weights_as_of_budget", f"""WITH RECURSIVE {_streams(15, AS_OF)}, {_scored()}, {_fused(5, _W)}, {_DEDUP},
  spent AS (SELECT *, sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + CASE WHEN source_chunk IS NULL THEN 0 ELSE CAST(ceil(length(source_chunk) / 4.0) AS BIGINT) END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM kept)
  SELECT query_id, fact_id, rank, round(score, 6) AS score, CAST(used AS BIGINT) AS tokens FROM spent WHERE used <= 1500""")
def _(t):
    options = SearchOptions(limit=5, weights=_W, as_of=t.as_of, token_budget=1500)
    return search(t.requests, memory(t), t.now, options).selectExpr(
        "query_id", "fact_id", "rank", "round(score, 6) AS score", "tokens")


@query("search_history", f"""WITH RECURSIVE {_streams()}, {_scored()}, {_fused()}
  SELECT k.query_id, k.fact_id, v.fact_id AS version_fact_id, CAST(v.version AS BIGINT) AS history_version FROM fused k JOIN facts v USING (lineage_id) WHERE v.fact_id <> k.fact_id
   AND NOT EXISTS (SELECT 1 FROM fused u WHERE u.query_id = k.query_id AND json_extract_string(u.metadata, '$.relationType') = 'updates' AND CAST(json_extract_string(u.metadata, '$.relatedFactId') AS BIGINT) = k.fact_id)""")
def _(t):
    rows = search(t.requests, memory(t), t.now, SearchOptions(include_history=True))
    return ranking.history(rows, t.facts).select(
        "query_id", "fact_id", "version_fact_id",
        F.col("history_version").cast("long").alias("history_version"))


@query("search_graph_context", f"""WITH RECURSIVE {_streams()}, {_scored()}, {_fused()}, {_DEDUP},
  touch AS (SELECT source_id AS entity_id, edge_id FROM edges UNION SELECT target_id, edge_id FROM edges)
  SELECT k.query_id, k.fact_id, l.entity_id, CAST(count(x.edge_id) AS BIGINT) AS edges FROM kept k JOIN fact_entities l USING (fact_id) JOIN entities e USING (entity_id) LEFT JOIN touch x USING (entity_id) GROUP BY ALL""")
def _(t):
    rows = search(t.requests, memory(t), t.now)
    return ranking.graph_context(rows, t.fact_entities, t.entities, t.edges).groupBy(
        "query_id", "fact_id", "entity_id").agg(F.count("edge_id").alias("edges"))


@query("search_access_records", f"""WITH RECURSIVE {_streams()}, {_scored()}, {_fused()}, {_DEDUP}
  SELECT r.tenant_id, r.query, k.fact_id, CASE WHEN triggered_by IS NULL THEN 'fusion' ELSE 'trigger' END AS retrieval_method, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS rank_position
  FROM kept k JOIN requests r USING (query_id)""")
def _(t):
    rows = search(t.requests, memory(t), t.now)
    return access_records(rows, t.requests, t.now).select(
        "tenant_id", "query", "fact_id", "retrieval_method", "rank_position")


@query("rerank_results", f"""WITH {fr.vector_cte('v', 20, 0.0)},
  s AS (SELECT v.query_id, v.fact_id, round((1.0::DOUBLE / v.position) * 0.6::DOUBLE + v.similarity * 0.4::DOUBLE, 9) AS reranked_score FROM v)
  SELECT query_id, fact_id, round(reranked_score, 6) AS reranked_score, row_number() OVER (PARTITION BY query_id ORDER BY reranked_score DESC, fact_id) AS position FROM s
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY reranked_score DESC, fact_id) <= 10""")
def _(t):
    rows = vs.vector_search(t.requests, t.facts, 20).select(
        "query_id", "fact_id", (1.0 / F.col("position")).alias("score"))
    return vs.rerank(rows, t.requests, t.facts).select(
        "query_id", "fact_id", F.round("reranked_score", 6).alias("reranked_score"), "position")


_NEW = f"SELECT {fr.S}, fact_id + 1000000 AS query_id, content, embedding, CASE WHEN fact_id % 10 = 0 THEN 'update' ELSE 'add' END AS operation FROM facts WHERE created_at >= TIMESTAMP '2024-01-25 00:00:00'"
_AGAIN = f"SELECT {fr.S}, fact_id + 2000000, ' ' || replace(content, 'User', 'USER'), embedding, 'add' FROM facts WHERE fact_id % 4 = 0"
_TOLD = f"""cands AS ({_NEW} UNION ALL {_AGAIN}), stored AS (SELECT * FROM facts WHERE created_at < TIMESTAMP '2024-01-25 00:00:00'),
  {fr.vector_cte('v', 5, 0.55, queries="(SELECT * FROM cands WHERE operation = 'add')").replace('JOIN facts f', 'JOIN stored f')},
  s AS (SELECT query_id, count(*) AS n, arg_min(fact_id, position) AS best FROM v GROUP BY ALL),
  texts AS (SELECT DISTINCT {fr.S}, lower(trim(content)) AS said FROM stored WHERE valid_until IS NULL),
  firsts AS (SELECT *, lower(trim(content)) AS said, row_number() OVER (PARTITION BY {fr.S}, lower(trim(content)) ORDER BY query_id) AS nth FROM cands WHERE operation = 'add'),
  same AS (SELECT f.query_id FROM firsts f WHERE nth > 1 UNION SELECT f.query_id FROM firsts f JOIN texts USING ({fr.S}, said))"""


def _new_candidates(t: Tables):
    """The newest facts, and a fourth of all facts once more, some letters as capitals."""
    columns = ["tenant_id", "scope", "scope_id", "query_id", "content", "embedding", "operation"]
    cut = F.expr("TIMESTAMP '2024-01-25 00:00:00'")
    new = t.facts.where(F.col("created_at") >= cut).withColumns({
        "query_id": F.col("fact_id") + 1000000, "operation": F.when(F.col("fact_id") % 10 == 0, "update").otherwise("add")})
    again = t.facts.where("fact_id % 4 = 0").withColumns({
        "query_id": F.col("fact_id") + 2000000, "content": F.concat(F.lit(" "), F.replace("content", F.lit("User"), F.lit("USER"))), "operation": F.lit("add")})
    return new.select(*columns).unionByName(again.select(*columns)), t.facts.where(F.col("created_at") < cut)


@query("dedup_against_store", f"""WITH {_TOLD}
  SELECT c.query_id, CASE WHEN c.operation <> 'add' THEN c.operation WHEN m.query_id IS NOT NULL THEN 'noop' ELSE 'add' END AS operation, coalesce(s.n, 0) AS match_count, CAST(s.best AS STRING) AS best_fact_id
  FROM cands c LEFT JOIN s USING (query_id) LEFT JOIN same m USING (query_id)""")
def _(t):
    return vs.deduplicate(*_new_candidates(t)).select(
        "query_id", "operation", "match_count", F.col("best_fact_id").cast("string").alias("best_fact_id"))


@query("dedup_within_batch", f"""WITH RECURSIVE {_TOLD},
  left_over AS (SELECT *, row_number() OVER (PARTITION BY {fr.S} ORDER BY query_id) AS i FROM cands WHERE operation = 'add' AND query_id NOT IN (SELECT query_id FROM same)),
  walk AS (SELECT {fr.S}, query_id, i, true AS stays, CASE WHEN embedding IS NULL THEN [] ELSE [embedding] END AS kept FROM left_over WHERE i = 1
    UNION ALL SELECT w.tenant_id, w.scope, w.scope_id, x.query_id, x.i, x.stays, CASE WHEN x.stays AND x.embedding IS NOT NULL THEN list_append(w.kept, x.embedding) ELSE w.kept END
    FROM walk w JOIN LATERAL (SELECT l.query_id, l.i, l.embedding, NOT coalesce(list_bool_or(list_transform(w.kept, lambda v: round({fr.cosine('v', 'l.embedding')}, 9) >= 0.3)), false) AS stays
      FROM left_over l WHERE l.tenant_id = w.tenant_id AND l.scope = w.scope AND l.scope_id = w.scope_id AND l.i = w.i + 1) x ON true)
  SELECT c.query_id, CASE WHEN c.operation <> 'add' THEN c.operation WHEN w.stays THEN 'add' ELSE 'noop' END AS operation FROM cands c LEFT JOIN walk w USING (query_id)""")
def _(t):
    return vs.deduplicate(*_new_candidates(t), same_similarity=0.3).select("query_id", "operation")

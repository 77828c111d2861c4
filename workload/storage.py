"""Lookups, pages, rewrites, predicates, joins, aggregates and windows over the memory tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemoframe.functions import fixed_values as fv, hashing
from mnemoframe.operators import (
    conversations as cv, grouping, lookups, mutations as mu, profiles)
from mnemoframe.operators.versions import as_of_join, close_versions
from mnemoframe.plans import tools
from mnemoframe.session import shared_folder
from mnemoframe.sources.catalog import MemoryCatalog
from workload.registry import query
from workload.retrieval import request_triggers
from workload.views import AS_OF, NOW

TS = "%Y-%m-%d %H:%M:%S"


def stamp(col: str, name: str | None = None):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name or col)


def text_ids(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


# --- lookups -----------------------------------------------------------------
@query("facts_by_id", "SELECT f.tenant_id, f.fact_id, f.content FROM facts f SEMI JOIN memory_accesses a USING (fact_id)")
def _(t):
    return lookups.by_ids(t.facts, t.memory_accesses, "fact_id").select("tenant_id", "fact_id", "content")


@query("facts_of_lineages", """SELECT f.tenant_id, f.lineage_id, f.fact_id, CAST(f.version AS BIGINT) AS version FROM facts f SEMI JOIN (SELECT * FROM facts WHERE contradicts_id IS NOT NULL) c ON c.tenant_id = f.tenant_id AND c.lineage_id = f.lineage_id""")
def _(t):
    return lookups.lineage_versions(t.facts, t.facts.where("contradicts_id IS NOT NULL")).select(
        "tenant_id", "lineage_id", "fact_id", F.col("version").cast("long").alias("version"))


def _page_sql(rows: str, keys: str, ts: str, rid: str, desc: bool) -> str:
    op, d = ("<", "DESC") if desc else (">", "ASC")
    return f"""pages_in AS (SELECT * FROM {rows}),
  hit AS (SELECT p.page_id, p.page_limit, r.{rid}, row_number() OVER (PARTITION BY p.page_id ORDER BY r.{ts} {d}, r.{rid} {d}) AS position
    FROM pages_in r JOIN req p USING ({keys}) WHERE p.cursor_ts IS NULL OR r.{ts} {op} p.cursor_ts OR (r.{ts} = p.cursor_ts AND r.{rid} {op} p.cursor_id))
  SELECT page_id, {rid}, position, (SELECT count(*) FROM hit h WHERE h.page_id = hit.page_id) > page_limit AS has_more FROM hit WHERE position <= page_limit"""


@query("scope_pages", f"""WITH req AS (SELECT tenant_id || '/' || scope_id AS page_id, tenant_id, scope, scope_id, 20 AS page_limit, CAST(NULL AS TIMESTAMP) AS cursor_ts, CAST(NULL AS BIGINT) AS cursor_id FROM requests GROUP BY ALL),
  {_page_sql('facts', 'tenant_id, scope, scope_id', 'created_at', 'fact_id', True)}""")
def _(t):
    req = t.requests.select(
        F.concat("tenant_id", F.lit("/"), "scope_id").alias("page_id"), "tenant_id", "scope", "scope_id",
        F.lit(20).alias("page_limit"), F.lit(None).cast("timestamp").alias("cursor_ts"),
        F.lit(None).cast("long").alias("cursor_id")).distinct()
    return lookups.scope_pages(t.facts, req).select("page_id", "fact_id", F.col("position").cast("long").alias("position"), "has_more")


@query("scope_pages_next", f"""WITH req AS (SELECT 'q' || query_id AS page_id, tenant_id, scope, scope_id, 5 AS page_limit, TIMESTAMP '2024-01-20 00:00:00' AS cursor_ts, query_id AS cursor_id FROM requests),
  {_page_sql('(SELECT * FROM facts WHERE valid_until IS NULL)', 'tenant_id, scope, scope_id', 'created_at', 'fact_id', True)}""")
def _(t):
    req = t.requests.select(
        F.concat(F.lit("q"), "query_id").alias("page_id"), "tenant_id", "scope", "scope_id",
        F.lit(5).alias("page_limit"), F.expr("TIMESTAMP '2024-01-20 00:00:00'").alias("cursor_ts"),
        F.col("query_id").alias("cursor_id"))
    return lookups.scope_pages(t.facts, req, include_invalid=False).select(
        "page_id", "fact_id", F.col("position").cast("long").alias("position"), "has_more")


@query("entity_pages_large", f"""WITH req AS (SELECT concat('t', CAST(r_regionkey AS STRING)) AS page_id, concat('t', CAST(r_regionkey AS STRING)) AS tenant_id, CAST(150 + 400 * r_regionkey AS INT) AS page_limit, CAST(NULL AS TIMESTAMP) AS cursor_ts, CAST(NULL AS STRING) AS cursor_id FROM region),
  {_page_sql('entities', 'tenant_id', 'created_at', 'entity_id', False)}""")
def _(t):
    req = t.region.select(
        F.concat(F.lit("t"), "r_regionkey").alias("page_id"), F.concat(F.lit("t"), "r_regionkey").alias("tenant_id"),
        (150 + 400 * F.col("r_regionkey")).cast("int").alias("page_limit"),
        F.lit(None).cast("timestamp").alias("cursor_ts"), F.lit(None).cast("string").alias("cursor_id"))
    return lookups.entity_pages(t.entities, req).select(
        "page_id", "entity_id", F.col("position").cast("long").alias("position"), "has_more")


@query("entity_pages", f"""WITH req AS (SELECT concat('t', CAST(r_regionkey AS STRING)) AS page_id, concat('t', CAST(r_regionkey AS STRING)) AS tenant_id, 50 AS page_limit, TIMESTAMP '2023-03-10 00:00:00' AS cursor_ts, 'c9' AS cursor_id FROM region),
  {_page_sql('entities', 'tenant_id', 'created_at', 'entity_id', False)}""")
def _(t):
    req = t.region.select(
        F.concat(F.lit("t"), "r_regionkey").alias("page_id"), F.concat(F.lit("t"), "r_regionkey").alias("tenant_id"),
        F.lit(50).alias("page_limit"), F.expr("TIMESTAMP '2023-03-10 00:00:00'").alias("cursor_ts"), F.lit("c9").alias("cursor_id"))
    return lookups.entity_pages(t.entities, req).select("page_id", "entity_id", F.col("position").cast("long").alias("position"), "has_more")


@query("entity_fact_pages", f"""WITH req AS (SELECT entity_id AS page_id, tenant_id, entity_id, 10 AS page_limit, CAST(NULL AS TIMESTAMP) AS cursor_ts, CAST(NULL AS BIGINT) AS cursor_id FROM entities WHERE entity_type IN ('location', 'person')),
  linked AS (SELECT l.entity_id, f.* FROM fact_entities l JOIN facts f USING (fact_id)), {_page_sql('linked', 'tenant_id, entity_id', 'created_at', 'fact_id', True)}""")
def _(t):
    req = t.entities.where("entity_type IN ('location', 'person')").select(
        F.col("entity_id").alias("page_id"), "tenant_id", "entity_id", F.lit(10).alias("page_limit"),
        F.lit(None).cast("timestamp").alias("cursor_ts"), F.lit(None).cast("long").alias("cursor_id"))
    return lookups.entity_fact_pages(t.facts, t.fact_entities, req).select(
        "page_id", "fact_id", F.col("position").cast("long").alias("position"), "has_more")


@query("session_pages", f"""WITH req AS (SELECT DISTINCT tenant_id || scope_id AS page_id, tenant_id, scope, scope_id, 3 AS page_limit, CAST(NULL AS TIMESTAMP) AS cursor_ts, CAST(NULL AS BIGINT) AS cursor_id FROM sessions),
  {_page_sql('sessions', 'tenant_id, scope, scope_id', 'started_at', 'session_id', True)}""")
def _(t):
    req = t.sessions.select(
        F.concat("tenant_id", "scope_id").alias("page_id"), *lookups.SCOPE, F.lit(3).alias("page_limit"),
        F.lit(None).cast("timestamp").alias("cursor_ts"), F.lit(None).cast("long").alias("cursor_id")).distinct()
    return grouping.keyset_page(t.sessions, req, lookups.SCOPE, "started_at", "session_id").select(
        "page_id", "session_id", F.col("position").cast("long").alias("position"), "has_more")


@query("extraction_pages", f"""WITH req AS (SELECT DISTINCT tenant_id AS page_id, tenant_id, 10 AS page_limit, TIMESTAMP '2024-01-20 00:00:00' AS cursor_ts, CAST(100 AS BIGINT) AS cursor_id FROM extractions),
  {_page_sql('extractions', 'tenant_id', 'created_at', 'extraction_id', True)}""")
def _(t):
    req = t.extractions.select(
        F.col("tenant_id").alias("page_id"), "tenant_id", F.lit(10).alias("page_limit"),
        F.expr("TIMESTAMP '2024-01-20 00:00:00'").alias("cursor_ts"), F.lit(100).cast("long").alias("cursor_id")).distinct()
    return grouping.keyset_page(t.extractions, req, ("tenant_id",), "created_at", "extraction_id").select(
        "page_id", "extraction_id", F.col("position").cast("long").alias("position"), "has_more")


@query("entities_of_facts", "SELECT l.fact_id, e.entity_id, e.canonical_name, l.role FROM fact_entities l JOIN entities e USING (entity_id) SEMI JOIN (SELECT * FROM facts WHERE contradicts_id IS NOT NULL) f ON f.fact_id = l.fact_id")
def _(t):
    keys = t.facts.where("contradicts_id IS NOT NULL")
    return lookups.entities_of_facts(t.fact_entities, t.entities, keys).select("fact_id", "entity_id", "canonical_name", "role")


@query("incident_edges", "SELECT n.entity_id, e.edge_id FROM edges e JOIN entities n ON n.tenant_id = e.tenant_id AND (n.entity_id = e.source_id OR n.entity_id = e.target_id) WHERE n.entity_type = 'location'")
def _(t):
    return lookups.incident_edges(t.edges, t.entities.where("entity_type = 'location'")).select("entity_id", "edge_id")


@query("entities_by_canonical_name", "SELECT n.n_nationkey, e.entity_id FROM nation n JOIN entities e ON e.canonical_name = lower(n.n_name) AND e.entity_type = 'location' AND e.tenant_id = 't' || (n.n_nationkey % 5)")
def _(t):
    keys = t.nation.select("n_nationkey", F.lower("n_name").alias("canonical_name"), F.lit("location").alias("entity_type"),
                           F.concat(F.lit("t"), F.col("n_nationkey") % 5).alias("tenant_id"))
    return t.entities.join(keys, ["tenant_id", "canonical_name", "entity_type"]).select("n_nationkey", "entity_id")


@query("extractions_by_hash", """SELECT e.extraction_id, sha256('{"type":"url","data":"' || p.url || '"}') AS input_hash FROM extractions e JOIN pages p ON p.page_id = e.extraction_id""")
def _(t):
    hashed = t.extractions.withColumn("input_hash", hashing.input_hash(F.col("input_type"), F.col("data")))
    asked = t.pages.select(hashing.input_hash(F.lit("url"), F.col("url")).alias("input_hash"), "page_id")
    return hashed.join(asked, "input_hash").where("page_id = extraction_id").select("extraction_id", "input_hash")


@query("messages_unextracted", "SELECT session_id, turn_number, role FROM session_messages WHERE extraction_id IS NULL")
def _(t):
    return lookups.unextracted(t.session_messages).select("session_id", "turn_number", "role").orderBy("session_id", "turn_number")


@query("active_triggers", "SELECT trigger_id, tenant_id, CAST(priority AS BIGINT) AS priority FROM triggers WHERE active")
def _(t):
    return lookups.active_triggers(request_triggers(t)).select("trigger_id", "tenant_id", F.col("priority").cast("long").alias("priority"))


@query("webhooks_by_event", "SELECT webhook_id, tenant_id FROM webhooks WHERE active AND list_contains(events, 'extraction.failed')")
def _(t):
    return lookups.subscribed(t.webhooks, F.lit("extraction.failed")).select("webhook_id", "tenant_id")


@query("api_keys_allowed", f"SELECT key_id, key_prefix FROM api_keys WHERE active AND (expires_at IS NULL OR expires_at > {NOW}) AND (list_contains(scopes, 'write') OR list_contains(scopes, 'admin'))")
def _(t):
    return lookups.keys_allowing(t.api_keys, "write", t.now).select("key_id", "key_prefix")


@query("cursor_codec", """SELECT fact_id, to_base64(CAST('{"ts":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') || '","id":"' || fact_id || '"}' AS BLOB)) AS cursor,
  CAST(fact_id AS STRING) AS decoded_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS decoded_ts FROM facts""")
def _(t):
    coded = t.facts.select("fact_id", hashing.encode_cursor(F.col("created_at"), F.col("fact_id")).alias("cursor"))
    back = hashing.decode_cursor(F.col("cursor"))
    return coded.select("fact_id", "cursor", back["id"].alias("decoded_id"),
                        F.date_format(back["ts"], "yyyy-MM-dd HH:mm:ss").alias("decoded_ts"))


@query("active_sessions", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, scope, scope_id ORDER BY started_at DESC, session_id DESC) AS rn FROM sessions)
  SELECT tenant_id, scope_id, session_id FROM r WHERE ended_at IS NULL QUALIFY row_number() OVER (PARTITION BY tenant_id, scope, scope_id ORDER BY rn) = 1""")
def _(t):
    return lookups.active_sessions(t.sessions).select("tenant_id", "scope_id", "session_id")


# --- predicates --------------------------------------------------------------
@query("facts_valid_as_of", f"SELECT fact_id, tenant_id, scope FROM facts WHERE valid_from <= {AS_OF} AND (valid_until IS NULL OR valid_until > {AS_OF})")
def _(t):
    return t.facts.where(lookups.valid_at(t.as_of)).select("fact_id", "tenant_id", "scope")


@query("facts_in_scope", "SELECT fact_id FROM facts WHERE tenant_id = 't1' AND scope = 'user' AND valid_until IS NULL")
def _(t):
    return lookups.in_scope(t.facts, "t1", "user", "*").where(lookups.valid_at()).select("fact_id")


@query("facts_searchable", "SELECT fact_id FROM facts WHERE valid_until IS NULL AND source_type <> 'api' AND NOT list_contains(tags, 'raw_chunk')")
def _(t):
    return t.facts.where(lookups.valid_at() & lookups.searchable()).select("fact_id")


@query("facts_with_priority", "SELECT fact_id, CAST(json_extract_string(metadata, '$.priority_order') AS BIGINT) AS priority_order FROM facts WHERE json_extract_string(metadata, '$.priority_order') IS NOT NULL AND coalesce(json_extract_string(metadata, '$.dismissed'), 'false') <> 'true'")
def _(t):
    return lookups.with_priority(t.facts).where(lookups.not_dismissed()).select(
        "fact_id", lookups.json_field("metadata", "priority_order").cast("long").alias("priority_order"))


@query("facts_event_or_document_date", f"SELECT fact_id, strftime(coalesce(event_date, document_date), '{TS}') AS fact_date FROM facts")
def _(t):
    return t.facts.select("fact_id", F.date_format(F.coalesce("event_date", "document_date"), "yyyy-MM-dd HH:mm:ss").alias("fact_date"))


_GREETING = """WITH d AS (SELECT * FROM facts WHERE valid_until IS NULL AND scope = 'user' AND {where} AND length(content) <= {chars}
    QUALIFY row_number() OVER (PARTITION BY tenant_id, scope, scope_id, lower(trim(content)) ORDER BY importance DESC, created_at DESC, fact_id) = 1)
  SELECT tenant_id, scope_id, fact_id, row_number() OVER (PARTITION BY tenant_id, scope, scope_id ORDER BY importance DESC, created_at DESC, fact_id) AS rank FROM d QUALIFY rank <= {n}"""


@query("greeting_facts", _GREETING.format(where="importance >= 0.6", n=15, chars=600))
def _(t):
    return profiles.greeting_facts(t.facts, 15, 600).select("tenant_id", "scope_id", "fact_id", F.col("rank").cast("long").alias("rank"))


@query("greeting_facts_about_project", _GREETING.format(where="content ILIKE '%NATION_1%'", n=8, chars=3000))
def _(t):
    return profiles.greeting_facts(t.facts, 8, 3000, about="NATION_1").select("tenant_id", "scope_id", "fact_id", F.col("rank").cast("long").alias("rank"))


# --- rewrites ----------------------------------------------------------------
@query("insert_facts_defaults", f"SELECT doc_id AS fact_id, 1 AS version, 1 AS frequency, 1.0::DOUBLE AS decay_score, 0.5::DOUBLE AS importance, 'none' AS contradiction_status, strftime({NOW}, '{TS}') AS valid_from FROM documents")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("fact_id"), F.lit(None).cast("double").alias("importance"))
    return mu.new_facts(rows, t.now).select("fact_id", "version", "frequency", "decay_score", "importance",
                                            "contradiction_status", stamp("valid_from"))


@query("insert_edges_defaults", "SELECT edge_id, weight, 0.8::DOUBLE AS confidence FROM edges")
def _(t):
    return mu.new_edges(t.edges).select("edge_id", "weight", "confidence")


@query("invalidate_facts", f"SELECT fact_id, strftime(CASE WHEN valid_until IS NULL AND fact_id IN (SELECT fact_id FROM memory_accesses WHERE feedback_type = 'correction') THEN {NOW} ELSE valid_until END, '{TS}') AS valid_until FROM facts")
def _(t):
    gone = t.memory_accesses.where("feedback_type = 'correction'")
    return mu.invalidate(t.facts, gone, t.now).select("fact_id", stamp("valid_until"))


@query("edit_facts_versions", f"""WITH e AS (SELECT fact_id, fact_id + 5000000 AS new_fact_id, 'edited ' || fact_id AS new_content FROM facts WHERE contradicts_id IS NOT NULL)
  SELECT f.fact_id, CAST(f.version AS BIGINT) AS version, f.lineage_id, strftime(CASE WHEN e.fact_id IS NOT NULL AND valid_until IS NULL THEN {NOW} ELSE valid_until END, '{TS}') AS valid_until, content FROM facts f LEFT JOIN e USING (fact_id)
  UNION ALL SELECT e.new_fact_id, f.version + 1, f.lineage_id, NULL, e.new_content FROM facts f JOIN e USING (fact_id)""")
def _(t):
    edits = t.facts.where("contradicts_id IS NOT NULL").select(
        "fact_id", (F.col("fact_id") + 5000000).alias("new_fact_id"), F.concat(F.lit("edited "), "fact_id").alias("new_content"))
    return mu.edit_facts(t.facts, edits, t.now).select(
        "fact_id", F.col("version").cast("long").alias("version"), "lineage_id", stamp("valid_until"), "content")


@query("edit_facts_partitions", """WITH touched AS (SELECT DISTINCT tenant_id, scope FROM facts WHERE fact_id < 5)
  SELECT f.tenant_id, f.scope, CAST(CASE WHEN t.scope IS NULL THEN 1 ELSE 2 END AS BIGINT) AS written_by, CAST(count(*) + count(*) FILTER (fact_id < 5) AS BIGINT) AS facts, CAST(max(version) FILTER (fact_id < 5) + 1 AS BIGINT) AS edited_version
  FROM facts f LEFT JOIN touched t USING (tenant_id, scope) GROUP BY ALL""")
def _(t):
    # the facts as a partitioned table, and the first five of them edited
    catalog = MemoryCatalog(t.spark, "facts", f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    catalog.create()
    columns = ["fact_id", "tenant_id", "scope", "scope_id", "content", "version", "valid_from", "valid_until", "created_at"]
    catalog.append("facts", text_ids(t.facts.select(*columns), "fact_id"))
    first = t.facts.where("fact_id < 5").select(F.col("fact_id").cast("string").alias("fact_id"))
    tools.edit(catalog, first.select("fact_id", F.concat(F.lit("new"), "fact_id").alias("new_fact_id"), F.lit("edited").alias("new_content")), t.now)
    rows = catalog.table("facts").groupBy("tenant_id", "scope").agg(
        F.count(F.lit(1)).alias("facts"), F.max(F.when(F.col("content") == "edited", F.col("version"))).cast("long").alias("edited_version"))
    places = catalog.commits("facts").groupBy("tenant_id", "scope").agg(F.max("_place").alias("written_by"))
    return rows.join(places, ["tenant_id", "scope"])


_PURGED = "(SELECT * FROM facts WHERE tenant_id || scope || scope_id IN (SELECT tenant_id || scope || scope_id FROM requests))"


@query("purge_scope_cascade", f"""SELECT 'facts' AS tbl, count(*) AS rows_left FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM {_PURGED})
  UNION ALL SELECT 'fact_entities', count(*) FROM fact_entities WHERE fact_id NOT IN (SELECT fact_id FROM {_PURGED})
  UNION ALL SELECT 'edges', count(*) FROM edges WHERE fact_id IS NULL OR fact_id NOT IN (SELECT fact_id FROM {_PURGED})
  UNION ALL SELECT 'extractions', count(*) FROM extractions WHERE tenant_id || scope || scope_id NOT IN (SELECT tenant_id || scope || scope_id FROM requests)""")
def _(t):
    left = mu.purge_scope({"facts": t.facts, "fact_entities": t.fact_entities, "edges": t.edges,
                           "extractions": t.extractions}, t.requests)
    return mu.union_all([df.groupBy().agg(F.lit(n).alias("tbl"), F.count(F.lit(1)).alias("rows_left"))
                         .select("tbl", "rows_left") for n, df in left.items()])


@query("update_decay_scores", """WITH u AS (SELECT fact_id, count(*) AS hits, max(value) AS top FROM memory_accesses GROUP BY ALL)
  SELECT f.fact_id, CAST(coalesce(u.hits, f.frequency) AS BIGINT) AS frequency, coalesce(CASE WHEN u.top > 100 THEN 0.9::DOUBLE END, f.importance) AS importance FROM facts f LEFT JOIN u USING (fact_id)""")
def _(t):
    up = t.memory_accesses.groupBy("fact_id").agg(F.count(F.lit(1)).alias("frequency"), F.max("value").alias("top")).withColumn(
        "importance", F.when(F.col("top") > 100, 0.9))
    return mu.update_fields(t.facts.select("fact_id", "frequency", "importance"), up, "fact_id", "frequency", "importance").withColumn(
        "frequency", F.col("frequency").cast("long"))


@query("link_insert_ignore", """SELECT fact_id, entity_id FROM fact_entities UNION SELECT user_id, 'n' || (user_id % 30) FROM events""")
def _(t):
    have = t.fact_entities.select("fact_id", "entity_id")
    new = t.events.select(F.col("user_id").alias("fact_id"), F.concat(F.lit("n"), F.col("user_id") % 30).alias("entity_id"))
    return mu.insert_ignore(have, new, "fact_id", "entity_id")


_USAGE = "SELECT tenant_id, date_trunc('month', ts) AS period_start, sum(queries) AS queries, sum(tokens) AS tokens, sum(extractions) AS extractions, sum(cost_usd) AS cost_usd FROM usage_events GROUP BY ALL"


@query("usage_upsert", f"""WITH d AS ({_USAGE}), base AS (SELECT tenant_id, TIMESTAMP '2024-01-01 00:00:00' AS period_start, 100 AS queries FROM usage_events WHERE tenant_id < 't15' GROUP BY ALL)
  SELECT tenant_id, strftime(period_start, '{TS}') AS period_start, CAST(sum(queries) AS BIGINT) AS queries, CAST(sum(tokens) AS BIGINT) AS tokens FROM
  (SELECT tenant_id, period_start, queries, tokens FROM d UNION ALL SELECT tenant_id, period_start, queries, 0 FROM base) GROUP BY ALL""")
def _(t):
    base = t.usage_events.where("tenant_id < 't15'").select(
        "tenant_id", F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("period_start"), F.lit(100).cast("long").alias("queries"),
        F.lit(0).cast("long").alias("tokens")).distinct()
    return mu.month_counters(base, t.usage_events, "ts", ("queries", "tokens")).select(
        "tenant_id", stamp("period_start"), "queries", "tokens")


@query("usage_monthly", f"SELECT tenant_id, strftime(period_start, '{TS}') AS period_start, CAST(queries AS BIGINT) AS queries, CAST(tokens AS BIGINT) AS tokens, CAST(extractions AS BIGINT) AS extractions, round(cost_usd, 2) AS cost_usd FROM ({_USAGE})")
def _(t):
    return t.usage_events.groupBy("tenant_id", F.date_trunc("month", "ts").alias("period_start")).agg(
        *[F.sum(c).alias(c) for c in ("queries", "tokens", "extractions", "cost_usd")]).select(
        "tenant_id", stamp("period_start"), "queries", "tokens", "extractions", F.round("cost_usd", 2).alias("cost_usd"))


@query("usage_read_or_zero", f"""WITH k AS (SELECT DISTINCT tenant_id, date_trunc('month', created_at) AS period_start FROM facts UNION SELECT DISTINCT 't' || (c_custkey % 25), TIMESTAMP '2024-01-01 00:00:00' FROM customer)
  SELECT k.tenant_id, strftime(k.period_start, '{TS}') AS period_start, CAST(coalesce(u.queries, 0) AS BIGINT) AS queries, CAST(coalesce(u.tokens, 0) AS BIGINT) AS tokens FROM k LEFT JOIN ({_USAGE}) u USING (tenant_id, period_start)""")
def _(t):
    keys = t.facts.select("tenant_id", F.date_trunc("month", "created_at").alias("period_start")).union(
        t.customer.select(F.concat(F.lit("t"), F.col("c_custkey") % 25), F.expr("TIMESTAMP '2024-01-01 00:00:00'"))).distinct()
    month = t.usage_events.groupBy("tenant_id", F.date_trunc("month", "ts").alias("period_start")).agg(
        F.sum("queries").alias("queries"), F.sum("tokens").alias("tokens"))
    return keys.join(month, ["tenant_id", "period_start"], "left").select(
        "tenant_id", stamp("period_start"), F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query("trigger_fire_counts", """WITH m AS (SELECT 'g' || (user_id % 25) AS trigger_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL)
  SELECT trigger_id, times_fired + coalesce(n, 0) AS times_fired FROM triggers LEFT JOIN m USING (trigger_id)""")
def _(t):
    fired = t.events.where("event_type = 'purchase'").select(F.concat(F.lit("g"), F.col("user_id") % 25).alias("trigger_id"))
    return mu.count_fired(request_triggers(t), fired).select("trigger_id", "times_fired")


@query("feedback_on_latest_access", """WITH last AS (SELECT access_id, fact_id FROM memory_accesses QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY accessed_at DESC, access_id DESC) = 1)
  SELECT a.access_id, a.fact_id, CASE WHEN l.access_id IS NULL THEN a.feedback_type ELSE CASE WHEN a.fact_id % 2 = 0 THEN 'correction' ELSE 'explicit_positive' END END AS feedback_type,
   l.access_id IS NOT NULL AND a.fact_id % 2 = 0 AS was_corrected FROM memory_accesses a LEFT JOIN last l USING (access_id)""")
def _(t):
    log = t.memory_accesses.withColumn("was_useful", F.lit(None).cast("boolean"))
    given = t.memory_accesses.select("fact_id").distinct().withColumns({
        "was_useful": F.col("fact_id") % 2 == 1,
        "feedback_type": F.when(F.col("fact_id") % 2 == 0, "correction").otherwise("explicit_positive")})
    return mu.feedback_on_latest(log, given).select("access_id", "fact_id", "feedback_type", "was_corrected")


@query("messages_mark_extracted", """SELECT session_id, turn_number, CAST(coalesce(CASE WHEN extraction_id IS NULL AND role = 'user' THEN session_id + 1000 END, extraction_id) AS STRING) AS extraction_id FROM session_messages""")
def _(t):
    done = lookups.unextracted(t.session_messages).where("role = 'user'").select(
        "session_id", "turn_number", (F.col("session_id") + 1000).alias("extraction_id"))
    return text_ids(mu.mark_extracted(t.session_messages, done).select("session_id", "turn_number", "extraction_id"), "extraction_id")


@query("extraction_lifecycle", """WITH ev AS (SELECT page_id AS extraction_id, s AS status_order, CASE s WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, DATE '2024-01-01' + s::INT AS changed_at
   FROM pages, LATERAL (SELECT unnest(range(0, page_id % 4 + 1)) AS s))
  SELECT extraction_id, status FROM ev QUALIFY row_number() OVER (PARTITION BY extraction_id ORDER BY changed_at DESC, status_order DESC) = 1""")
def _(t):
    steps = F.element_at(F.array(*[F.lit(s) for s in ("queued", "processing", "completed", "failed")]), F.col("s") + 1)
    ev = t.pages.select(F.col("page_id").alias("extraction_id"),
                        F.explode(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int"))).alias("s")).select(
        "extraction_id", F.col("s").alias("status_order"), steps.alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("s")).alias("changed_at"))
    return mu.lifecycle(t.extractions, ev).select("extraction_id", "status")


@query("import_skip_duplicates", """SELECT n.doc_id FROM documents n ANTI JOIN labels l USING (doc_id)""")
def _(t):
    return mu.only_new(t.labels.select("doc_id"), t.documents.select("doc_id"), "doc_id")


# --- joins -------------------------------------------------------------------
@query("bridge_join", "SELECT f.fact_id, e.entity_id, e.entity_type, l.role FROM facts f JOIN fact_entities l USING (fact_id) JOIN entities e ON e.entity_id = l.entity_id AND e.tenant_id = f.tenant_id")
def _(t):
    return t.facts.select("fact_id", "tenant_id").join(t.fact_entities, "fact_id").join(
        t.entities, ["tenant_id", "entity_id"]).select("fact_id", "entity_id", "entity_type", "role")


@query("links_of_tenant", "SELECT l.fact_id, l.entity_id FROM fact_entities l SEMI JOIN (SELECT fact_id FROM facts WHERE tenant_id = 't2') f USING (fact_id)")
def _(t):
    return t.fact_entities.join(t.facts.where("tenant_id = 't2'"), "fact_id", "left_semi").select("fact_id", "entity_id")


@query("contradiction_self_join", f"""SELECT f.fact_id, CAST(o.fact_id AS STRING) AS contradicted, strftime(o.valid_from, '{TS}') AS old_from FROM facts f LEFT JOIN facts o ON o.tenant_id = f.tenant_id AND o.fact_id = f.contradicts_id WHERE f.contradiction_status <> 'none'""")
def _(t):
    old = t.facts.select("tenant_id", F.col("fact_id").alias("contradicts_id"), F.col("fact_id").cast("string").alias("contradicted"), stamp("valid_from", "old_from"))
    return t.facts.where("contradiction_status <> 'none'").join(old, ["tenant_id", "contradicts_id"], "left").select("fact_id", "contradicted", "old_from")


@query("versions_at_times", f"""SELECT o_orderkey AS probe_id, v.fact_id, strftime(v.valid_from, '{TS}') AS valid_from FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 45 DAY AS at FROM orders) p
  JOIN fact_versions v ON v.lineage_id = p.o_custkey AND v.valid_from <= p.at AND (v.valid_until IS NULL OR v.valid_until > p.at)""")
def _(t):
    probes = t.orders.select(F.col("o_orderkey").alias("probe_id"), F.col("o_custkey").alias("lineage_id"),
                             (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 45 DAYS")).alias("at"))
    return as_of_join(probes, t.fact_versions, ["lineage_id"], "at").select("probe_id", "fact_id", stamp("valid_from"))


@query("version_numbers", """SELECT o_orderkey AS fact_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("lineage_id"),
                           F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return grouping.numbered(rows, ["lineage_id"], "created_at", ["fact_id"], "version").select("fact_id", "version")


@query("close_versions", f"SELECT fact_id, strftime(valid_until, '{TS}') AS valid_until FROM fact_versions")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("lineage_id"),
                           F.col("o_orderdate").cast("timestamp").alias("valid_from"))
    return close_versions(rows, ["lineage_id"], "valid_from", "fact_id").select("fact_id", stamp("valid_until"))


# --- aggregates --------------------------------------------------------------
@query("entities_by_type", "SELECT entity_type, count(*) AS n FROM entities GROUP BY ALL")
def _(t):
    return t.entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "entity_type")


@query("edge_types", "SELECT DISTINCT edge_type, relation FROM edges")
def _(t):
    return t.edges.select("edge_type", "relation").distinct()


@query("memory_stats", """SELECT tenant_id, CAST(sum(f) AS BIGINT) AS facts, CAST(sum(e) AS BIGINT) AS entities, CAST(sum(g) AS BIGINT) AS edges FROM (SELECT tenant_id, 1 AS f, 0 AS e, 0 AS g FROM facts WHERE valid_until IS NULL UNION ALL SELECT tenant_id, 0, 1, 0 FROM entities UNION ALL SELECT tenant_id, 0, 0, 1 FROM edges) GROUP BY ALL""")
def _(t):
    parts = [t.facts.where(lookups.valid_at()), t.entities, t.edges]
    counts = [df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select(
        "tenant_id", *[(F.col("n") if i == j else F.lit(0).cast("long")).alias(c) for j, c in enumerate(("facts", "entities", "edges"))])
        for i, df in enumerate(parts)]
    return mu.union_all(counts).groupBy("tenant_id").agg(*[F.sum(c).alias(c) for c in ("facts", "entities", "edges")])


@query("scope_last_updated", f"SELECT tenant_id, scope, scope_id, strftime(max(created_at), '{TS}') AS last_updated, count(*) AS facts FROM facts WHERE valid_until IS NULL GROUP BY ALL")
def _(t):
    return t.facts.where(lookups.valid_at()).groupBy(*lookups.SCOPE).agg(
        F.max("created_at").alias("m"), F.count(F.lit(1)).alias("facts")).select(*lookups.SCOPE, stamp("m", "last_updated"), "facts")


@query("extraction_costs", "SELECT tenant_id, status, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM extractions GROUP BY ALL")
def _(t):
    return t.extractions.groupBy("tenant_id", "status").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@query("evaluation_accuracy", """WITH r AS (SELECT CASE WHEN d.source < 'src15' THEN 'single' ELSE 'multi' END AS question_type, l.quality = 1 AND l.toxic = 0 AS correct, CAST(d.n_chars AS DOUBLE) AS latency_ms FROM labels l JOIN documents d USING (doc_id))
  SELECT coalesce(question_type, 'overall') AS question_type, count(*) AS questions, round(avg(CASE WHEN correct THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(latency_ms), 4) AS mean_latency_ms FROM r GROUP BY ROLLUP (question_type)""")
def _(t):
    r = t.labels.join(t.documents, "doc_id").select(
        F.when(F.col("source") < "src15", "single").otherwise("multi").alias("question_type"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("correct"), F.col("n_chars").cast("double").alias("latency_ms"))
    return cv.accuracy(r).select(F.coalesce("question_type", F.lit("overall")).alias("question_type"), "questions",
                                 F.round("accuracy", 6).alias("accuracy"), F.round("mean_latency_ms", 4).alias("mean_latency_ms"))


@query("conditions_hold_per_entity", "SELECT tenant_id, entity_type, bool_and(length(canonical_name) >= 6) AS all_long, bool_or(contains(canonical_name, '7')) AS any_seven FROM entities GROUP BY ALL")
def _(t):
    return t.entities.groupBy("tenant_id", "entity_type").agg(
        F.bool_and(F.length("canonical_name") >= 6).alias("all_long"), F.bool_or(F.col("canonical_name").contains("7")).alias("any_seven"))


# --- conversations and windows -------------------------------------------------
@query("conversation_flush_text", """SELECT session_id, CAST(floor(turn_number / 5) AS BIGINT) AS batch, count(*) AS messages,
  string_agg('[' || role || ' @ ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || ']: ' || content, chr(10) || chr(10) ORDER BY turn_number) AS text FROM session_messages WHERE extraction_id IS NULL GROUP BY ALL""")
def _(t):
    return cv.flush_batches(lookups.unextracted(t.session_messages))


@query("conversation_text", """SELECT session_id, CAST(floor(turn_number / 5) AS BIGINT) AS batch, count(*) AS messages, string_agg(role || ': ' || content, chr(10) ORDER BY turn_number) AS text FROM session_messages GROUP BY ALL""")
def _(t):
    return cv.conversation_text(t.session_messages)


_HIT = " OR ".join("contains(lower(content), '%s')" % p.replace("'", "''") for p in fv.SIGNAL_PHRASES)


@query("signal_turns", f"""WITH m AS (SELECT *, ({_HIT}) AS hit FROM session_messages WHERE role <> 'system' OR turn_number > 0),
  w AS (SELECT *, coalesce(lead(hit) OVER (PARTITION BY session_id ORDER BY turn_number), false) AS nxt, lead(turn_number) OVER (PARTITION BY session_id ORDER BY turn_number) AS nt, bool_or(hit) OVER (PARTITION BY session_id) AS any_hit, max(turn_number) OVER (PARTITION BY session_id) AS last FROM m)
  SELECT session_id, turn_number, hit AS is_signal FROM w WHERE CASE WHEN any_hit THEN hit OR (nxt AND nt = turn_number + 1) ELSE turn_number > last - 2 END""")
def _(t):
    return cv.signal_turns(t.session_messages.where("role <> 'system' OR turn_number > 0")).select("session_id", "turn_number", "is_signal")


@query("session_windows", f"""WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
  g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_message_at, count(*) AS messages FROM g GROUP BY user_id, k""")
def _(t):
    ev = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return cv.session_windows(ev, ["user_id"]).select("user_id", stamp("started_at"), stamp("last_message_at"), "messages")


@query("session_turn_counts", "SELECT session_id, count(*) AS messages, max(turn_number) AS last_turn FROM session_messages GROUP BY ALL")
def _(t):
    return cv.turn_count(t.session_messages)


_RATE = """SELECT tenant_id, plan, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n AS requests, {cap} AS request_limit, CAST(greatest(0, {cap} - n) AS BIGINT) AS remaining, n > {cap} AS limited
  FROM (SELECT tenant_id, plan, w, count(*) AS n FROM (SELECT tenant_id, CASE user_id % 20 % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'scale' ELSE 'enterprise' END AS plan, {start} AS w FROM usage_events{more}) GROUP BY tenant_id, plan, w)"""


def _planned(t):
    p = F.element_at(F.array(*[F.lit(x) for x in ("free", "pro", "scale", "enterprise")]), (F.col("user_id") % 20 % 4 + 1).cast("int"))
    return t.usage_events.withColumn("plan", p)


@query("rate_limit_sliding_minute", _RATE.format(
    cap="CASE plan WHEN 'free' THEN 1 WHEN 'pro' THEN 2 ELSE 3 END", start="to_timestamp(floor(epoch(ts) / 20) * 20 - 20 * k)::TIMESTAMP", more=", LATERAL (SELECT unnest(range(0, 3)) AS k)"))
def _(t):
    return cv.sliding_rate(_planned(t), {"free": 1, "pro": 2, "scale": 3, "enterprise": 3}, "60 seconds", "20 seconds").select(
        "tenant_id", "plan", stamp("window_start"), "requests", "request_limit", F.col("remaining").cast("long").alias("remaining"), "limited")


@query("rate_limit_daily", _RATE.format(cap="CASE plan WHEN 'free' THEN 5000 WHEN 'pro' THEN 50000 WHEN 'scale' THEN 500000 ELSE 5000000 END", start="date_trunc('day', ts)::TIMESTAMP", more=""))
def _(t):
    return cv.sliding_rate(_planned(t), fv.PLAN_REQUESTS_PER_DAY, "1 day", None).select(
        "tenant_id", "plan", stamp("window_start"), "requests", "request_limit", F.col("remaining").cast("long").alias("remaining"), "limited")

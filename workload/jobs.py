"""Checks, export and import, ingest and maintenance jobs over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe import schemas
from mnemoframe.functions.hashing import input_hash
from mnemoframe.functions.text import strip_html
from mnemoframe.plans import ingest as ing, maintenance, tools
from mnemoframe.plans.search import Memory
from mnemoframe.sources import io
from workload.registry import query
from workload.texts import _EXTRACT, _event_date_sql
from workload.views import NOW


@query("fact_violations", """SELECT fact_id, 'content_length' AS rule FROM facts WHERE NOT (length(content) BETWEEN 1 AND 50000) UNION ALL SELECT fact_id, 'importance' FROM facts WHERE NOT (importance BETWEEN 0 AND 1)
  UNION ALL SELECT fact_id, 'embedding_dim' FROM facts WHERE embedding IS NOT NULL AND len(embedding) <> 64 UNION ALL SELECT fact_id, 'interval' FROM facts WHERE valid_until < valid_from UNION ALL SELECT fact_id, 'scope' FROM facts WHERE scope NOT IN ('user', 'agent', 'hive')""")
def _(t):
    rules = schemas.fact_rules(64)
    rules["scope"] = F.col("scope").isin("user", "agent", "hive")  # sessions are not allowed here
    return schemas.violations(t.facts, "fact_id", rules)


@query("edge_violations", "SELECT edge_id, 'edge_type' AS rule FROM edges WHERE edge_type = 'prefers' UNION ALL SELECT edge_id, 'weight' FROM edges WHERE weight < 0.6")
def _(t):
    rules = schemas.edge_rules()
    rules["weight"] = F.col("weight") >= 0.6
    return schemas.violations(t.edges, "edge_id", rules)


@query("duplicate_canonical_names", "SELECT canonical_name, entity_type, count(*) AS copies FROM entities GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return schemas.duplicate_keys(t.entities, "canonical_name", "entity_type")


@query("domain_properties", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL AS valid FROM events""")
def _(t):
    rows = t.events.select("event_id", F.col("props").alias("properties"))
    return schemas.domain_properties(rows, [("k", "number", True), ("note", "string", False)]).select("event_id", "k", "valid")


@query("export_scopes", """WITH s AS (SELECT DISTINCT tenant_id, scope, scope_id FROM requests)
  SELECT 'fact' AS kind, CAST(fact_id AS STRING) AS id FROM facts SEMI JOIN s USING (tenant_id, scope, scope_id) UNION ALL SELECT 'entity', entity_id FROM entities SEMI JOIN s USING (tenant_id)
  UNION ALL SELECT 'edge', edge_id FROM edges SEMI JOIN s USING (tenant_id) UNION ALL SELECT 'session', CAST(session_id AS STRING) FROM sessions SEMI JOIN s USING (tenant_id, scope, scope_id)""")
def _(t):
    return io.export_scope(t.facts, t.entities, t.edges, t.sessions, t.requests).select("kind", "id")


@query("import_exported_entities", """SELECT entity_id, canonical_name FROM entities SEMI JOIN (SELECT DISTINCT tenant_id FROM requests) s USING (tenant_id) WHERE entity_type <> 'person'""")
def _(t):
    out = io.export_scope(t.facts, t.entities, t.edges, t.sessions, t.requests)
    have = t.entities.where("entity_type = 'person'").select("entity_id", "tenant_id", "canonical_name")
    return io.import_rows(have, out, "entity", "entity_id string, tenant_id string, canonical_name string", "entity_id").select("entity_id", "canonical_name")


@query("sync_dry_run", """SELECT 'documents' AS tbl, 'to_remote' AS direction, count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'documents', 'to_local', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    return io.sync_counts({"documents": t.documents}, {"documents": t.labels}, {"documents": "doc_id"})


@query("event_dates_filled", f"SELECT fact_id, strftime(coalesce(event_date, try_strptime({_event_date_sql('content')}, '%Y-%m-%d')), '%Y-%m-%d') AS event_date FROM facts")
def _(t):
    return maintenance.backfill_event_dates(t.facts).select("fact_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@query("scratchpads", """WITH p AS (SELECT tenant_id, scope, scope_id, arg_max(content, (created_at, fact_id)) AS pad FROM facts WHERE valid_until IS NULL AND list_contains(tags, 'scratchpad') GROUP BY ALL),
  a AS (SELECT tenant_id, scope, scope_id, 'note ' || count(*) AS new_text FROM facts GROUP BY ALL)
  SELECT tenant_id, scope, scope_id, concat_ws(chr(10), pad, new_text) AS content, length(concat_ws(chr(10), pad, new_text)) > 5000 AS needs_compression FROM a LEFT JOIN p USING (tenant_id, scope, scope_id)""")
def _(t):
    notes = t.facts.groupBy("tenant_id", "scope", "scope_id").agg(F.concat(F.lit("note "), F.count(F.lit(1))).alias("new_text"))
    return maintenance.scratchpads(t.facts, notes).drop("new_text")


@query("session_summaries", """WITH m AS (SELECT session_id, count(*) AS facts, arg_max(fact_id, (importance, created_at, fact_id)) AS top FROM facts GROUP BY ALL)
  SELECT s.session_id, coalesce(m.facts, 0) AS facts, CAST(m.top AS STRING) AS top_fact_id FROM sessions s LEFT JOIN m USING (session_id) WHERE s.ended_at IS NOT NULL""")
def _(t):
    return maintenance.session_summaries(t.facts, t.sessions).select("session_id", "facts", F.col("top_fact_id").cast("string").alias("top_fact_id"))


@query("dismiss_facts", f"""SELECT fact_id, json_extract_string(metadata, '$.relationType') AS relation_type, CASE WHEN contradicts_id IS NOT NULL THEN 'true' ELSE json_extract_string(metadata, '$.dismissed') END AS dismissed FROM facts""")
def _(t):
    out = tools.set_metadata(t.facts, tools.dismissals(t.facts.where("contradicts_id IS NOT NULL"), t.now))
    return out.select("fact_id", F.get_json_object("metadata", "$.relationType").alias("relation_type"), F.get_json_object("metadata", "$.dismissed").alias("dismissed"))


@query("update_priority_status", """SELECT fact_id, CASE WHEN json_extract_string(metadata, '$.priority_order') = '2' THEN 'done' ELSE json_extract_string(metadata, '$.status') END AS status, CASE WHEN json_extract_string(metadata, '$.priority_order') = '2' THEN 0.75::DOUBLE END AS confidence
  FROM facts WHERE json_extract_string(metadata, '$.priority_order') IS NOT NULL""")
def _(t):
    updates = t.region.select(F.concat(F.lit("t"), "r_regionkey").alias("tenant_id"), F.lit(2).alias("priority"), F.lit("done").alias("status"), F.lit(0.75).alias("confidence"))
    out = tools.set_metadata(t.facts, tools.status_changes(t.facts, updates))
    return out.where(F.get_json_object("metadata", "$.priority_order").isNotNull()).select(
        "fact_id", F.get_json_object("metadata", "$.status").alias("status"), F.get_json_object("metadata", "$.confidence").cast("double").alias("confidence"))


def _inputs(t):
    return t.session_messages.select(
        F.concat(F.lit("t"), F.col("session_id") % 5).alias("tenant_id"), F.lit("user").alias("scope"), F.lit("en").alias("scope_id"),
        "session_id", F.struct("session_id", "turn_number").alias("input_order"), F.lit("conversation").alias("input_type"), F.col("content").alias("data"))


def _ingested(t, processed=None):
    """All messages as inputs; ``processed`` is the status of earlier inputs by session, null if there was none."""
    status = F.lit(None).cast("string") if processed is None else processed
    ledger = _inputs(t).select(
        "tenant_id", input_hash(F.col("input_type"), strip_html(F.col("data"))).alias("extraction_id"), status.alias("status")).where("status is not null")
    memory = Memory(t.facts, t.entities, t.edges, t.fact_entities)
    return ing.ingest(_inputs(t), memory, ledger, t.now)


def _kept_facts(inputs: str = "true") -> str:
    """The extracted facts; of equal statements of a tenant the first stays."""
    return f"""{_EXTRACT}, kept AS (SELECT * FROM extracted WHERE {inputs}
  QUALIFY row_number() OVER (PARTITION BY session_id % 5, lower(trim(content)) ORDER BY session_id, turn_number) = 1)"""


@query("ingest_facts", f"WITH {_kept_facts()} SELECT 't' || (session_id % 5) AS tenant_id, session_id, content, importance, 1 AS version, 'none' AS contradiction_status FROM kept")
def _(t):
    return _ingested(t).facts.select("tenant_id", "session_id", "content", "importance", "version", "contradiction_status")


@query("ingest_repeated_inputs", f"WITH {_kept_facts('session_id % 3 <> 0')} SELECT 't' || (session_id % 5) AS tenant_id, session_id, content, importance FROM kept")
def _(t):
    # a third of the inputs were processed before, and a third failed
    before = F.when(F.col("session_id") % 3 == 0, "completed").when(F.col("session_id") % 3 == 1, "failed")
    return _ingested(t, before).facts.select("tenant_id", "session_id", "content", "importance")


@query("ingest_ledger", f"""WITH {_kept_facts()}, n AS (SELECT session_id, turn_number, count(*) AS n FROM kept GROUP BY ALL)
  SELECT 't' || (m.session_id % 5) AS tenant_id, 'completed' AS status, count(*) AS inputs, CAST(sum(coalesce(n.n, 0)) AS BIGINT) AS facts_created FROM session_messages m LEFT JOIN n USING (session_id, turn_number) GROUP BY ALL""")
def _(t):
    return _ingested(t).extractions.groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("inputs"), F.sum("facts_created").alias("facts_created"))


@query("ingest_links")
def _(t):
    return _ingested(t).fact_entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("facts"))

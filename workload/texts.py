"""Scores, text functions, extraction, linking, profiles and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.functions import dates, fixed_values as fv, hashing, scoring, text as tx, vectors
from mnemoframe.operators.grouping import salted_join
from mnemoframe.operators import extraction as ex, linking, mutations as mu, profiles, ranking
from mnemoframe.operators.vector_search import vector_search
from workload import fragments as fr
from workload.registry import query
from workload.storage import stamp
from workload.views import NOW

DAY = "86400000000.0::DOUBLE"
PAIR_SALTS = 16  # a tenant's pages meet its webhooks in so many tasks
LAM = "(ln(2.0::DOUBLE) / 30)"


def _decay(importance: str, frequency: str, accessed: str) -> str:
    return (f"CASE WHEN {accessed} IS NULL THEN 0.0 ELSE greatest(0, least(1, {importance} * exp(-{LAM} * (epoch_us({NOW}) - epoch_us({accessed})) / {DAY})"
            f" * least(1.0::DOUBLE, ln(1 + ({frequency})::DOUBLE) / ln(51::DOUBLE)))) END")


def _r(name, places=6):
    return F.round(name, places).alias(name)


# --- scores --------------------------------------------------------------------
@query("score_recency_salience_decay", f"""SELECT fact_id,
  round(greatest(0, least(1, 0.5::DOUBLE * coalesce(exp(-{LAM} * (epoch_us({NOW}) - epoch_us(last_accessed)) / {DAY}), 0) + 0.5::DOUBLE * coalesce(exp(-{LAM} * (epoch_us({NOW}) - epoch_us(created_at)) / {DAY}), 0))), 6) AS recency_score,
  round(importance * least(1.0::DOUBLE, ln(1 + frequency::DOUBLE) / ln(51::DOUBLE)), 6) AS salience_score, round({_decay('importance', 'frequency', 'last_accessed')}, 6) AS decay_score FROM facts""")
def _(t):
    rows = ranking.score_memory(t.facts, t.now).withColumn("decay_score", scoring.decay(
        F.col("importance"), F.col("frequency"), F.col("last_accessed"), t.now))
    return rows.select("fact_id", _r("recency_score"), _r("salience_score"), _r("decay_score"))


@query("score_cosine_by_label", f"""WITH c AS (SELECT label, min(vec_id) AS head FROM embeddings GROUP BY ALL)
  SELECT e.vec_id, round({fr.cosine('e.embedding', 'h.embedding')}, 6) AS similarity FROM embeddings e JOIN c USING (label) JOIN embeddings h ON h.vec_id = c.head""")
def _(t):
    heads = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return t.embeddings.join(heads, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("head")), 6).alias("similarity"))


@query("score_normalized_by_group", "SELECT o_orderkey, round(CASE WHEN max(o_totalprice) OVER (PARTITION BY o_orderpriority) > 0 THEN o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderpriority) ELSE 0 END, 6) AS score FROM orders")
def _(t):
    # a group here may be any size: aggregate, then join the few maxima back
    tops = t.orders.groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("top"))
    return t.orders.join(tops, "o_orderpriority").select("o_orderkey", F.round(
        F.when(F.col("top") > 0, F.col("o_totalprice") / F.col("top")).otherwise(0.0), 6).alias("score"))


@query("feedback_importance", f"""WITH l AS (SELECT fact_id, feedback_type FROM memory_accesses QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY accessed_at DESC, access_id DESC) = 1),
  n AS (SELECT f.fact_id, f.frequency, coalesce(f.last_accessed, {NOW}) AS acc, l.feedback_type, CASE WHEN feedback_type LIKE '%positive' THEN least(1.0::DOUBLE, importance + 0.05::DOUBLE) WHEN feedback_type LIKE '%negative' THEN greatest(0.1::DOUBLE, importance - 0.05::DOUBLE) ELSE greatest(0.1::DOUBLE, importance - 0.1::DOUBLE) END AS ni FROM facts f JOIN l USING (fact_id))
  SELECT fact_id, feedback_type, round(ni, 6) AS new_importance, round({_decay('ni', 'frequency', 'acc')}, 6) AS new_decay_score FROM n""")
def _(t):
    return mu.apply_feedback(t.facts, mu.latest_access(t.memory_accesses), t.now).select(
        "fact_id", "feedback_type", _r("new_importance"), _r("new_decay_score"))


@query("access_decay_update", f"""WITH h AS (SELECT fact_id, count(*) AS n FROM memory_accesses GROUP BY ALL)
  SELECT fact_id, CAST(frequency + n AS BIGINT) AS new_frequency, round({_decay('importance', 'frequency + n', NOW)}, 6) AS new_decay_score FROM facts JOIN h USING (fact_id)""")
def _(t):
    return mu.access_decay(t.facts, t.memory_accesses, t.now).select(
        "fact_id", F.col("new_frequency").cast("long").alias("new_frequency"), _r("new_decay_score"))


# --- time ------------------------------------------------------------------------
@query("time_references", f"WITH {fr.time_ref_cte()} SELECT query_id, CAST(y AS STRING) AS y, CAST(m AS STRING) AS m, CAST(d AS STRING) AS d, ordering FROM refs")
def _(t):
    ref = t.requests.select("query_id", dates.time_reference(F.col("query"), t.now).alias("r"))
    return ref.select("query_id", *[F.col(f"r.point.{n}").cast("string").alias(n[0]) for n in ("year", "month", "day")], F.col("r.ordering").alias("ordering"))


@query("time_references_in_facts", f"WITH {fr.time_ref_cte('refs', '(SELECT fact_id AS query_id, content AS query FROM facts)')} SELECT query_id, CAST(y AS STRING) AS y, CAST(m AS STRING) AS m, CAST(d AS STRING) AS d, ordering FROM refs")
def _(t):
    ref = t.facts.select(F.col("fact_id").alias("query_id"), dates.time_reference(F.col("content"), t.now).alias("r"))
    return ref.select("query_id", *[F.col(f"r.point.{n}").cast("string").alias(n[0]) for n in ("year", "month", "day")], F.col("r.ordering").alias("ordering"))


def _event_date_sql(col: str) -> str:
    low = f"lower({col})"
    iso = r"(\d{4})-(\d{2})-(\d{2})"
    out = [f"WHEN regexp_matches({col}, '{iso}') THEN regexp_extract({col}, '{iso}', 0)"]
    words = list(enumerate(fv.MONTHS, 1)) + [(n, s) for n, s in enumerate(fv.MONTH_ABBREVIATIONS, 1) if s != "may"]
    for n, w in words:
        mdy = rf"{w}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?[,\s]+(\d{{4}})"
        dmy = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+{w}\.?[,\s]+(\d{{4}})"
        my = rf"(?:in|during|around|of)\s+{w}\.?\s+(\d{{4}})"
        md = rf"{w}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s|,|$)"
        out += [f"WHEN regexp_matches({low}, '{p}') THEN {y} || '-{n:02d}-' || {d}" for p, y, d in (
            (mdy, f"regexp_extract({low}, '{mdy}', 2)", f"lpad(regexp_extract({low}, '{mdy}', 1), 2, '0')"),
            (dmy, f"regexp_extract({low}, '{dmy}', 2)", f"lpad(regexp_extract({low}, '{dmy}', 1), 2, '0')"),
            (my, f"regexp_extract({low}, '{my}', 1)", "'15'"),
            (md, "'2026'", f"lpad(regexp_extract({low}, '{md}', 1), 2, '0')"))]
    q = r"q([1-4])\s+(\d{4})"
    out.append(f"WHEN regexp_matches({low}, '{q}') THEN regexp_extract({low}, '{q}', 2) || '-' || lpad(CAST((CAST(regexp_extract({low}, '{q}', 1) AS INT) - 1) * 3 + 2 AS STRING), 2, '0') || '-15'")
    return "CASE " + " ".join(out) + " END"


@query("event_dates_backfill", f"SELECT fact_id, {_event_date_sql('content')} AS event_date FROM facts WHERE event_date IS NULL")
def _(t):
    return t.facts.where("event_date IS NULL").select("fact_id", dates.event_date_text(F.col("content")).alias("event_date"))


@query("contradiction_timeline", """SELECT n.o_orderkey, CASE WHEN dd = 0 THEN 'Superseded on the same day' WHEN dd = 1 THEN 'Updated after 1 day' WHEN dd < 7 THEN 'Updated after ' || dd || ' days'
   WHEN dd < 30 THEN 'Changed over ~' || CAST(floor(dd / 7.0 + 0.5) AS BIGINT) || ' week' || CASE WHEN floor(dd / 7.0 + 0.5) = 1 THEN '' ELSE 's' END
   WHEN dd < 365 THEN 'Changed over ~' || CAST(floor(dd / 30.0 + 0.5) AS BIGINT) || ' month' || CASE WHEN floor(dd / 30.0 + 0.5) = 1 THEN '' ELSE 's' END
   ELSE 'Changed over ~' || CAST(floor(dd / 365.0 + 0.5) AS BIGINT) || ' year' || CASE WHEN floor(dd / 365.0 + 0.5) = 1 THEN '' ELSE 's' END END AS timeline
  FROM (SELECT o_orderkey, abs(date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(any_value(o_orderdate) AS DATE))) AS dd FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) n""")
def _(t):
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    return t.orders.join(first, "o_orderkey").select("o_orderkey", dates.timeline(
        F.col("ship").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).alias("timeline"))


# --- text ------------------------------------------------------------------------
@query("keyword_queries", f"SELECT doc_id, array_to_string({fr.terms('text')}, ' | ') AS keyword_query FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.keyword_query(F.col("text")).alias("keyword_query"))


@query("entity_name_candidates", f"WITH {fr.seeds_cte()} SELECT DISTINCT query_id, canonical_name FROM seeds_names WHERE length(canonical_name) >= 2")
def _(t):
    return t.requests.select("query_id", F.explode(tx.entity_name_candidates(F.col("query"))).alias("canonical_name"))


def _kwset(col: str) -> str:
    stops = ", ".join(f"'{w}'" for w in fv.KEYWORD_STOP_WORDS)
    return (f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({col}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), "
            f"lambda w: length(w) >= 3 AND NOT list_contains([{stops}], w)))")


@query("keyword_overlap_versions", f"""WITH k AS (SELECT fact_id, tenant_id, lineage_id, {_kwset('content')} AS w FROM facts)
  SELECT a.fact_id, b.fact_id AS earlier_id, round(CASE WHEN least(len(a.w), len(b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE ELSE 0 END, 6) AS overlap FROM k a JOIN k b ON b.fact_id = a.fact_id - 5 AND a.lineage_id = b.lineage_id""")
def _(t):
    k = t.facts.select("fact_id", "lineage_id", tx.keyword_set(F.col("content")).alias("w"))
    e = k.select((F.col("fact_id") + 5).alias("fact_id"), F.col("fact_id").alias("earlier_id"), "lineage_id", F.col("w").alias("w2"))
    return k.join(e, ["fact_id", "lineage_id"]).select("fact_id", "earlier_id", F.round(tx.overlap(F.col("w"), F.col("w2")), 6).alias("overlap"))


def _entity_sql(col: str) -> str:
    noise = "(?i)^(" + "|".join(fv.LEADING_NOISE_WORDS) + r")\s+"
    out = f"trim({col})"
    for p in (r"^[-–—*•#>]+\s*", "(?i)''s$", "(?i)’s$", r"^[^a-zA-Z0-9]+", r"[^a-zA-Z0-9]+$", noise, noise):
        out = f"regexp_replace({out}, '{p}', '')"
    return f"lower(trim(regexp_replace({out}, '\\s+', ' ', 'g')))"


RAW_NAME = "concat(CASE p_partkey % 5 WHEN 0 THEN '- The ' WHEN 1 THEN '**' WHEN 2 THEN 'when the  ' WHEN 3 THEN '(My ' ELSE '  ' END, upper(p_name), CASE p_partkey % 4 WHEN 0 THEN '''s' WHEN 1 THEN '!)' WHEN 2 THEN '  x' ELSE '' END)"


@query("entity_names_normalized", f"SELECT p_partkey, {_entity_sql(RAW_NAME)} AS name FROM part")
def _(t):
    return t.part.select("p_partkey", tx.normalized_entity_name(F.expr(RAW_NAME.replace("'''s'", "\"'s\""))).alias("name"))


_REL = "CASE event_type WHEN 'click' THEN ' Likes ' WHEN 'view' THEN 'knows_about' WHEN 'purchase' THEN 'Married_To' WHEN 'error' THEN 'refines' ELSE 'Signed_Up' END"


@query("relations_normalized", "SELECT event_id, CASE event_type WHEN 'click' THEN 'prefers' WHEN 'view' THEN 'knows' WHEN 'purchase' THEN 'partner_of' WHEN 'error' THEN 'extends' ELSE 'signed_up' END AS relation FROM events")
def _(t):
    return t.events.select("event_id", tx.normalized_relation(F.expr(_REL)).alias("relation"))


@query("role_prefix_stripped", r"SELECT conv_id, turn, regexp_replace(role || ': ' || text, '^[a-zA-Z_\-]+:\s*', '') AS line FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", tx.strip_role(F.concat("role", F.lit(": "), "text")).alias("line"))


@query("html_stripped", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def _(t):
    return t.pages.select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("token_estimates", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", scoring.token_estimate(F.col("text")).alias("tokens"))


_CATS = " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{n}')" for n in needles) + f" THEN '{c}'" for c, needles in fv.PROFILE_CATEGORIES)


@query("profile_categories", f"SELECT fact_id, CASE {_CATS} ELSE 'other' END AS category FROM facts")
def _(t):
    return t.facts.select("fact_id", tx.profile_category(F.col("content")).alias("category"))


@query("query_variants", r"""WITH q AS (SELECT query_id, concat(CASE query_id % 4 WHEN 0 THEN 'What is my ' WHEN 1 THEN 'Where does ' WHEN 2 THEN 'my ' ELSE '' END, query, '?') AS q FROM requests),
  s AS (SELECT *, lower(q) AS l, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(q), '^what (is|are|was|were) ', ''), '^who (is|are|was|were) ', ''), '^where (is|are|was|were|does|did) ', ''), '^when (did|does|was|were|is) ', ''), '\?$', '') AS st FROM q),
  v AS (SELECT query_id, list_filter([q, CASE WHEN NOT starts_with(l, 'user') AND NOT contains(l, 'my ') AND NOT contains(l, 'i ') THEN 'User ' || l END,
   CASE WHEN contains(l, 'my ') THEN regexp_replace(l, '\bmy\b', 'user''s', 'g') END, CASE WHEN regexp_matches(l, '^(what|who|where|when) ') AND st <> l THEN st END], lambda x: x IS NOT NULL)[1:4] AS vs FROM s)
  SELECT query_id, unnest(vs) AS variant FROM v""")
def _(t):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("What is my ", "Where does ", "my ", "")]), (F.col("query_id") % 4 + 1).cast("int"))
    q = t.requests.select("query_id", F.concat(lead, "query", F.lit("?")).alias("q"))
    return q.select("query_id", F.explode(tx.query_variants(F.col("q"))).alias("variant"))


@query("contextual_texts", """SELECT fact_id, 'Context: ' || trim(coalesce(source_chunk, content)) || ' | Fact: ' || content AS contextual,
  'Context: ' || coalesce(nullif(source_chunk, ''), content) || ' | Fact: ' || content AS reembedding FROM facts""")
def _(t):
    return t.facts.select("fact_id", tx.contextual_text(F.col("content"), F.col("source_chunk")).alias("contextual"),
                          tx.reembedding_text(F.col("content"), F.col("source_chunk")).alias("reembedding"))


@query("input_hashes", """SELECT event_id, sha256('{"type":"raw_text","data":' || CAST(to_json(props) AS STRING) || '}') AS h, 'emb:m:' || substr(sha256(props), 1, 16) AS cache_key FROM events""")
def _(t):
    return t.events.select("event_id", hashing.input_hash(F.lit("raw_text"), F.col("props")).alias("h"), hashing.embedding_cache_key("m", F.col("props")).alias("cache_key"))


def _pad(byte: int) -> str:
    return (f"unhex(array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(CASE WHEN i < length(secret) THEN ascii(substr(secret, CAST(i AS INT) + 1, 1)) ELSE 0 END, {byte}))), ''))")


@query("webhook_signatures", f"""SELECT webhook_id, url, sha256({_pad(0x5c)} || unhex(sha256({_pad(0x36)} || encode(url)))) AS signature FROM webhooks w JOIN (SELECT 't' || (page_id % 5) AS tenant_id, url FROM pages) p USING (tenant_id)""")
def _(t):
    sent = t.pages.select(F.concat(F.lit("t"), F.col("page_id") % 5).alias("tenant_id"), "url")
    hooks = t.webhooks.select("tenant_id", "webhook_id", hashing.hmac_pads(F.col("secret")).alias("pads"))
    return salted_join(sent, hooks, ["tenant_id"], "url", PAIR_SALTS).select("webhook_id", "url", hashing.hmac_sha256(F.col("url"), pads=F.col("pads")).alias("signature"))


@query("segments_of_documents")
def _(t):
    return ex.windows(t.documents.select("doc_id", "text"), "text").select("doc_id", "index", "total", F.length("segment").alias("chars"), F.sha2("context_window", 256).alias("window_hash"))


@query("int8_embeddings", "SELECT doc_id, octet_length(encode(text)) AS dims, 1.0::DOUBLE AS length FROM documents")
def _(t):
    return t.documents.select("doc_id", F.col("text")).select("doc_id", vectors.decode_int8(F.base64(F.encode("text", "UTF-8"))).alias("v")).select("doc_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("length"))


@query("hashing_embeddings")
def _(t):
    return t.documents.select("doc_id", vectors.hashing_embedding(tx.search_terms(F.col("text"))).alias("v")).select("doc_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("length"))


# --- extraction --------------------------------------------------------------------
def _contacts_sql(src: str) -> str:
    parts = []
    for i, (kind, prefix, tags, pattern) in enumerate(fv.CONTACT_PATTERNS):
        p = pattern.replace("'", "''")
        parts.append(f"SELECT session_id, turn_number, {i} AS kord, '{kind}' AS kind, '{prefix.replace(chr(39), chr(39) * 2)}' || m AS content, 0.8::DOUBLE AS importance, 0.9::DOUBLE AS confidence, '{tags}' AS tags FROM (SELECT session_id, turn_number, unnest(list_distinct(regexp_extract_all(content, '{p}', 0))) AS m FROM {src})")
    return " UNION ALL ".join(parts)


def _statement_sql(line: str) -> str:
    def q(s):
        return s.replace("'", "''")
    whens = " ".join(
        f"WHEN regexp_extract({line}, '{q(p)}', 1) <> '' THEN {{'content': '{q(pre)}' || trim(regexp_extract({line}, '{q(p)}', 1)), 'importance': {imp}::DOUBLE, 'tags': '{tags}'}}"
        for p, pre, imp, tags in fv.STATEMENT_RULES)
    return f"CASE {whens} END"


_EXTRACT = f"""contacts AS ({_contacts_sql('session_messages')}),
  lines AS (SELECT session_id, turn_number, i, trim(regexp_replace(ls[i], '^[a-zA-Z_\\-]+:\\s*', '')) AS line FROM (SELECT session_id, turn_number, string_split(content, chr(10)) AS ls FROM session_messages), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
  said AS (SELECT session_id, turn_number, i, {_statement_sql('line')} AS s FROM lines WHERE line <> ''),
  stated AS (SELECT session_id, turn_number, s.content AS content, s.importance AS importance, s.tags AS tags FROM said WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, turn_number, s.content ORDER BY i) = 1),
  extracted AS (SELECT session_id, turn_number, kind, content, importance, confidence, tags FROM contacts
    UNION ALL SELECT session_id, turn_number, 'statement', content, importance, 0.7::DOUBLE, tags FROM stated s WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE c.session_id = s.session_id AND c.turn_number = s.turn_number AND c.content = s.content))"""


@query("extract_facts", f"WITH {_EXTRACT} SELECT session_id, turn_number, kind, content, importance, confidence, tags FROM extracted")
def _(t):
    return ex.extract(t.session_messages.select("session_id", "turn_number", "content")).select(
        "session_id", "turn_number", "kind", "content", "importance", "confidence", "tags")


@query("extract_contacts_from_documents", "WITH src AS (SELECT doc_id AS session_id, 0 AS turn_number, text AS content FROM documents), c AS (" + _contacts_sql("src") + ") SELECT session_id, kind, content FROM c")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("session_id"), F.explode(ex.contact_facts(F.col("text"))).alias("f"))
    return rows.select("session_id", "f.kind", "f.content")


@query("extraction_confidence", f"WITH {_EXTRACT}, b AS (SELECT session_id, max(confidence) AS best FROM extracted GROUP BY ALL), k AS (SELECT DISTINCT session_id FROM session_messages) SELECT k.session_id, coalesce(b.best, 0.5::DOUBLE) AS confidence FROM k LEFT JOIN b USING (session_id)")
def _(t):
    facts = ex.extract(t.session_messages.select("session_id", "turn_number", "content"))
    return ex.confidence(t.session_messages.select("session_id").distinct(), facts, "session_id")


@query("merge_rule_and_model_facts", f"""WITH {_EXTRACT}, model AS (SELECT session_id, upper(content) AS content FROM extracted WHERE kind = 'statement')
  SELECT session_id, content, 'model' AS side FROM model UNION ALL SELECT session_id, content, 'rules' FROM extracted e WHERE NOT EXISTS (SELECT 1 FROM model m WHERE m.session_id = e.session_id AND lower(m.content) = lower(e.content))""")
def _(t):
    facts = ex.extract(t.session_messages.select("session_id", "turn_number", "content")).select("session_id", "kind", "content")
    model = facts.where("kind = 'statement'").select("session_id", F.upper("content").alias("content"), F.lit("model").alias("side"))
    return ex.merge_facts(facts.select("session_id", "content", F.lit("rules").alias("side")), model, "session_id")


@query("merge_entities_last_wins", f"""WITH b AS (SELECT s_nationkey AS batch, s_suppkey AS position, 0 AS side, {_entity_sql("'The ' || s_name")} AS canonical_name, 'organization' AS entity_type FROM supplier
   UNION ALL SELECT c_nationkey, c_custkey, 1, {_entity_sql("replace(c_name, 'Customer', 'Supplier')")}, 'person' FROM customer)
  SELECT batch, canonical_name, entity_type FROM b WHERE canonical_name <> '' QUALIFY row_number() OVER (PARTITION BY batch, canonical_name ORDER BY side DESC, position DESC) = 1""")
def _(t):
    rules = t.supplier.select(F.col("s_nationkey").alias("batch"), F.col("s_suppkey").alias("position"),
                              F.concat(F.lit("The "), "s_name").alias("canonical_name"), F.lit("organization").alias("entity_type"))
    model = t.customer.select(F.col("c_nationkey").alias("batch"), F.col("c_custkey").alias("position"),
                              F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("canonical_name"), F.lit("person").alias("entity_type"))
    return ex.merge_entities(rules, model, "batch").select("batch", "canonical_name", "entity_type")


@query("edges_resolved", """WITH e AS (SELECT 't' || (c_nationkey % 5) AS tenant_id, c_custkey AS position, lower(replace(c_name, '#', ' ')) AS source_name, CASE c_custkey % 3 WHEN 0 THEN 'resides_in' WHEN 1 THEN 'Lives_In' ELSE 'likes' END AS relation, 'nation_' || (c_nationkey + 5 * (c_custkey % 5)) AS target_name FROM customer),
  n AS (SELECT tenant_id, position, source_name, CASE lower(relation) WHEN 'resides_in' THEN 'lives_in' WHEN 'likes' THEN 'prefers' ELSE lower(relation) END AS relation, target_name FROM e)
  SELECT n.tenant_id, a.entity_id AS source_id, n.relation, b.entity_id AS target_id FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tenant_id, source_name, relation, target_name ORDER BY position) = 1) n
  JOIN entities a ON a.tenant_id = n.tenant_id AND a.canonical_name = n.source_name JOIN entities b ON b.tenant_id = n.tenant_id AND b.canonical_name = n.target_name""")
def _(t):
    rel = F.when(F.col("c_custkey") % 3 == 0, "resides_in").when(F.col("c_custkey") % 3 == 1, "Lives_In").otherwise("likes")
    e = t.customer.select(
        F.concat(F.lit("t"), F.col("c_nationkey") % 5).alias("tenant_id"), F.col("c_custkey").alias("position"),
        F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("source_name"), rel.alias("relation"),
        F.concat(F.lit("nation_"), F.col("c_nationkey") + 5 * (F.col("c_custkey") % 5)).alias("target_name"))
    return ex.resolve_edges(ex.distinct_edges(e, "tenant_id"), t.entities).select("tenant_id", "source_id", "relation", "target_id")


@query("contradictions_marked", "SELECT fact_id, CASE WHEN contradicts_id IS NOT NULL AND fact_id % 2 = 0 THEN 'active' ELSE 'none' END AS contradiction_status, CAST(CASE WHEN fact_id % 2 = 0 THEN contradicts_id END AS STRING) AS contradicts_id FROM facts")
def _(t):
    rows = t.facts.select("fact_id", F.when(F.col("fact_id") % 2 == 0, "contradict").otherwise("add").alias("operation"), F.col("contradicts_id").alias("contradicts_fact_id"))
    return ex.mark_contradictions(rows).select("fact_id", "contradiction_status", F.col("contradicts_id").cast("string").alias("contradicts_id"))


# --- linking -----------------------------------------------------------------------
@query("mentioned_entities", """SELECT f.tenant_id, f.fact_id, e.entity_id FROM facts f JOIN entities e ON e.tenant_id = f.tenant_id AND CASE WHEN e.canonical_name = 'user' THEN starts_with(lower(f.content), 'user ') OR contains(lower(f.content), ' user ') ELSE length(e.canonical_name) >= 3 AND contains(lower(f.content), e.canonical_name) END""")
def _(t):
    return linking.mentioned_entities(t.facts, t.entities)




_LINKED = f"""k AS (SELECT fact_id, tenant_id, created_at, tags, {_kwset('content')} AS w FROM facts),
  l AS (SELECT DISTINCT l.fact_id, l.entity_id, e.tenant_id, e.canonical_name FROM fact_entities l JOIN entities e USING (entity_id) WHERE e.canonical_name NOT IN ('user', 'assistant')),
  el AS (SELECT l.entity_id, l.canonical_name, k.* FROM l JOIN k ON k.fact_id = l.fact_id AND k.tenant_id = l.tenant_id),
  pr AS (SELECT a.tenant_id, a.entity_id, a.canonical_name AS entity_name, a.fact_id AS s, o.fact_id AS d, o.created_at AS old_at, a.created_at AS new_at, CASE WHEN least(len(a.w), len(o.w)) > 0 THEN len(list_intersect(a.w, o.w)) / least(len(a.w), len(o.w))::DOUBLE ELSE 0 END AS ov
    FROM el a JOIN el o ON o.tenant_id = a.tenant_id AND o.entity_id = a.entity_id AND NOT list_contains(o.tags, 'scratchpad') WHERE len(a.w) >= 2)"""
_EDGES = """SELECT tenant_id, entity_id AS source_id, entity_id AS target_id, 'relates_to' AS relation, 'associative' AS edge_type, round(least(ov + 0.2::DOUBLE, 1), 9) AS weight, round(ov, 9) AS confidence, entity_name, s AS source_fact_id, d AS target_fact_id
  FROM kept QUALIFY row_number() OVER (PARTITION BY s, d ORDER BY entity_id) = 1"""


@query("cross_links", f"WITH {_LINKED}, kept AS (SELECT * FROM pr WHERE ov >= 0.2 AND (old_at < new_at OR old_at = new_at AND d < s)) {_EDGES}")
def _(t):
    return linking.all_cross_links(t.facts, t.fact_entities, t.entities).withColumns(
        {"weight": F.round("weight", 9), "confidence": F.round("confidence", 9)})


@query("cross_links_of_new_facts", f"""WITH {_LINKED}, kept AS (SELECT * FROM pr WHERE ov >= 0.2 AND new_at >= TIMESTAMP '2024-01-25 00:00:00' AND old_at < TIMESTAMP '2024-01-25 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_id, s ORDER BY old_at DESC, d DESC) <= 5) {_EDGES}""")
def _(t):
    new = t.facts.where("created_at >= TIMESTAMP '2024-01-25 00:00:00'")
    return linking.cross_links(new, t.facts, t.fact_entities, t.entities, per_entity=5).withColumns(
        {"weight": F.round("weight", 9), "confidence": F.round("confidence", 9)})


# --- profiles and recall -------------------------------------------------------------
@query("user_profiles", f"""WITH r AS (SELECT * FROM facts WHERE scope = 'user'),
  v AS (SELECT *, max(created_at) OVER (PARTITION BY tenant_id, scope, scope_id) AS lu FROM r WHERE valid_until IS NULL),
  p AS (SELECT *, CASE WHEN importance >= 0.7::DOUBLE AND (epoch_us({NOW}) - epoch_us(valid_from)) / {DAY} > 7 THEN 'static' ELSE 'dynamic' END AS part FROM v WHERE NOT list_contains(tags, 'raw_chunk'))
  SELECT tenant_id, scope_id, fact_id, part, CASE {_CATS} ELSE 'other' END AS category, strftime(lu, '%Y-%m-%d %H:%M:%S') AS last_updated,
   row_number() OVER (PARTITION BY tenant_id, scope, scope_id, part ORDER BY CASE WHEN part = 'static' THEN -importance ELSE -epoch_us(valid_from) END, created_at DESC, fact_id DESC) AS position FROM p""")
def _(t):
    return profiles.user_profiles(t.facts, t.now).select(
        "tenant_id", "scope_id", "fact_id", "part", "category", stamp("last_updated"), F.col("position").cast("long").alias("position"))


_LABELS = r"""labels AS (SELECT tenant_id, fact_id, CAST(json_extract_string(metadata, '$.priority_order') AS INT) AS po, 'Priority #' || json_extract_string(metadata, '$.priority_order') || ' (' ||
  trim(regexp_replace(content, '(?i)^User(''s)?\s+(plans|added|believes|is planning|wants)\s+', '')) || ')' AS label FROM facts WHERE json_extract_string(metadata, '$.priority_order') IS NOT NULL)"""


@query("priority_labels", f"WITH {_LABELS} SELECT tenant_id, fact_id, CAST(po AS BIGINT) AS priority_order, label FROM labels")
def _(t):
    return profiles.priority_labels(t.facts).withColumn("priority_order", F.col("priority_order").cast("long"))


_DEPS = f"""{_LABELS},
  ends AS (SELECT tenant_id, relation, CAST(json_extract_string(metadata, '$.sourceFactId') AS BIGINT) AS s, CAST(json_extract_string(metadata, '$.targetFactId') AS BIGINT) AS d, json_extract_string(metadata, '$.deadline') AS due FROM dependency_edges),
  near AS (SELECT * FROM ends e WHERE EXISTS (SELECT 1 FROM labels l WHERE l.tenant_id = e.tenant_id AND l.fact_id IN (e.s, e.d))),
  ord AS (SELECT tenant_id, relation, CASE WHEN relation = 'precedes' THEN s ELSE d END AS a, CASE WHEN relation = 'precedes' THEN d ELSE s END AS b FROM near WHERE relation IN ('precedes', 'depends_on') AND d IS NOT NULL),
  stated AS (SELECT DISTINCT x.tenant_id, x.fact_id, kind, coalesce(label, 'another priority') AS value FROM (SELECT tenant_id, a AS fact_id, 'blocks' AS kind, b AS other FROM ord UNION ALL SELECT tenant_id, b, 'blocked_by', a FROM ord) x LEFT JOIN labels l ON l.tenant_id = x.tenant_id AND l.fact_id = x.other),
  due AS (SELECT DISTINCT tenant_id, s AS fact_id, due AS value FROM near WHERE relation = 'deadline' AND due <> ''),
  passed AS (SELECT DISTINCT o.tenant_id, o.a AS fact_id, value || ' (cascaded)' AS value FROM ord o JOIN due ON due.tenant_id = o.tenant_id AND due.fact_id = o.b WHERE relation = 'precedes' AND NOT EXISTS (SELECT 1 FROM due x WHERE x.tenant_id = o.tenant_id AND x.fact_id = o.a)),
  implied AS (SELECT DISTINCT st.tenant_id, st.fact_id, d.value || ' (implicit — blocks deadline item)' AS value FROM stated st JOIN labels l ON l.tenant_id = st.tenant_id AND l.label = st.value JOIN due d ON d.tenant_id = l.tenant_id AND d.fact_id = l.fact_id
    WHERE st.kind = 'blocks' AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM due UNION ALL SELECT * FROM passed) x WHERE x.tenant_id = st.tenant_id AND x.fact_id = st.fact_id)),
  deps AS (SELECT * FROM stated UNION ALL SELECT tenant_id, fact_id, 'deadline', value FROM (SELECT * FROM due UNION ALL SELECT * FROM passed UNION ALL SELECT * FROM implied))"""


@query("recall_dependencies", f"WITH {_DEPS} SELECT tenant_id, fact_id, kind, value FROM deps")
def _(t):
    return profiles.dependencies(t.dependency_edges, profiles.priority_labels(t.facts))


@query("recall_priority_first", f"""WITH {fr.vector_cte('v', 10, 0.1)}, {_LABELS},
  base AS (SELECT v.query_id, r.tenant_id, v.fact_id, v.similarity AS score FROM v JOIN requests r USING (query_id)),
  inj AS (SELECT DISTINCT b.query_id, b.tenant_id, l.fact_id, 0.1::DOUBLE AS score FROM base b JOIN labels l USING (tenant_id) WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.query_id = b.query_id AND x.fact_id = l.fact_id)),
  al AS (SELECT a.*, l.po, f.content FROM (SELECT * FROM base UNION ALL SELECT * FROM inj) a LEFT JOIN labels l ON l.tenant_id = a.tenant_id AND l.fact_id = a.fact_id JOIN facts f ON f.fact_id = a.fact_id WHERE coalesce(json_extract_string(f.metadata, '$.dismissed'), 'false') <> 'true'),
  pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY po IS NULL, po, score DESC, fact_id) AS rank FROM al),
  bu AS (SELECT *, sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM pl)
  SELECT query_id, fact_id, rank, round(score, 6) AS score, CAST(used AS BIGINT) AS tokens FROM bu WHERE used <= 2000 OR rank = 1""")
def _(t):
    found = vector_search(t.requests, t.facts, 10, 0.1).join(t.requests.select("query_id", "tenant_id"), "query_id").select(
        "query_id", "tenant_id", "fact_id", F.col("similarity").alias("score"))
    rows = profiles.recalled(found, t.facts)
    kept = ranking.token_budget(profiles.place_recalled(rows), 2000, keep_first=True, text=F.col("content"))
    return kept.select("query_id", "fact_id", F.col("rank").cast("long").alias("rank"), _r("score"), "tokens")

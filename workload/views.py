"""The memory tables as views over the driver tables.

One SQL text per view, valid in Spark SQL and in DuckDB, used as a CTE by both.
Every view keeps all rows of the table it is built on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemoframe.session import configure
from mnemoframe.sources.io import read_parquet

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# tables whose rows carry text work, and the columns that spread them
SPREAD = {"documents": ("doc_id",), "pages": ("page_id", "url"),
          "conversations": ("conv_id", "turn")}

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"

VIEWS = {
    "facts": """
SELECT d.doc_id AS fact_id,
  concat('t', CAST(d.doc_id % 5 AS STRING)) AS tenant_id,
  CASE WHEN floor(d.doc_id / 15) % 3 = 0 THEN 'session' ELSE 'user' END AS scope,
  d.lang AS scope_id,
  d.doc_id % 100 AS session_id,
  concat(d.text, chr(10), 'User ', CASE d.doc_id % 8
    WHEN 0 THEN 'lives in' WHEN 1 THEN 'works at' WHEN 2 THEN 'prefers'
    WHEN 3 THEN 'is allergic to' WHEN 4 THEN 'was born in' WHEN 5 THEN 'plans a trip to'
    WHEN 6 THEN 'moved on March 5, 2023 to' ELSE 'thinks in Q2 2024 about' END,
    ' nation_', CAST(d.doc_id % 25 AS STRING), '.') AS content,
  e.embedding AS embedding,
  CAST(d.doc_id % 5 + 5 * floor(d.doc_id / 15) AS BIGINT) AS lineage_id,
  CAST(floor((d.doc_id % 15) / 5) AS INT) + 1 AS version,
  CAST(DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS TIMESTAMP) AS valid_from,
  CASE WHEN d.doc_id % 7 = 0 THEN CAST(DATE '2024-01-11' + CAST(d.doc_id % 30 AS INT) AS TIMESTAMP) END AS valid_until,
  CAST(d.doc_id % 11 AS DOUBLE) / 10 AS importance,
  CAST(d.n_chars % 60 AS INT) AS frequency,
  CASE WHEN d.doc_id % 7 <> 3 THEN CAST(DATE '2024-01-02' + CAST(d.doc_id % 29 AS INT) AS TIMESTAMP) END AS last_accessed,
  CASE d.doc_id % 6 WHEN 0 THEN 'api' WHEN 1 THEN 'document' WHEN 2 THEN 'url' WHEN 3 THEN NULL ELSE 'conversation' END AS source_type,
  CASE WHEN d.doc_id % 13 = 0 THEN split('raw_chunk', ',') WHEN d.doc_id % 19 = 0 THEN split('scratchpad,note', ',') ELSE split('extracted', ',') END AS tags,
  CASE WHEN d.doc_id % 4 <> 1 THEN CAST(DATE '2023-06-01' + CAST(d.doc_id % 365 AS INT) AS TIMESTAMP) END AS event_date,
  CASE WHEN d.doc_id % 10 <> 9 THEN CAST(DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS TIMESTAMP) END AS document_date,
  CASE WHEN d.doc_id % 17 = 0 AND d.doc_id >= 5 THEN 'active' ELSE 'none' END AS contradiction_status,
  CASE WHEN d.doc_id % 17 = 0 AND d.doc_id >= 5 THEN d.doc_id - 5 END AS contradicts_id,
  CASE WHEN d.doc_id % 9 = 0 AND d.doc_id >= 5 THEN concat('{"relationType":"updates","relatedFactId":', CAST(d.doc_id - 5 AS STRING), '}')
    WHEN d.doc_id % 23 = 0 THEN concat('{"priority_order":', CAST(1 + floor(d.doc_id / 23) % 6 AS INT), ',"status":"', CASE WHEN d.doc_id % 2 = 0 THEN 'not_started' ELSE 'in_progress' END, '","dismissed":', CASE WHEN d.doc_id % 5 = 4 THEN 'true' ELSE 'false' END, '}')
    ELSE '{}' END AS metadata,
  CASE WHEN d.doc_id % 4 = 0 THEN concat('Conversation from ', d.source, ' in ', d.lang, CASE WHEN d.doc_id % 8 = 0 THEN repeat(' about the plan', 20) ELSE '' END) END AS source_chunk,
  d.doc_id % 40 AS extraction_id,
  CAST(DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS TIMESTAMP) AS created_at
FROM (SELECT *, doc_id % (SELECT count(*) FROM embeddings) AS vec_key FROM documents) d LEFT JOIN embeddings e ON e.vec_id = d.vec_key""",
    "entities": """
SELECT concat('u', CAST(r_regionkey AS STRING)) AS entity_id, concat('t', CAST(r_regionkey AS STRING)) AS tenant_id,
  'user' AS canonical_name, 'person' AS entity_type, CAST(DATE '2023-01-01' AS TIMESTAMP) AS created_at, CAST(r_regionkey AS BIGINT) AS vec_key FROM region
UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), concat('t', CAST(r_regionkey AS STRING)), lower(r_name), 'location',
  CAST(DATE '2023-01-02' AS TIMESTAMP), CAST(r_regionkey + 7 AS BIGINT) FROM region
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('t', CAST(n_nationkey % 5 AS STRING)), lower(n_name), 'location',
  CAST(DATE '2023-02-01' + CAST(n_nationkey % 30 AS INT) AS TIMESTAMP), CAST(n_nationkey + 31 AS BIGINT) FROM nation
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('t', CAST(c_nationkey % 5 AS STRING)), lower(replace(c_name, '#', ' ')), 'person',
  CAST(DATE '2023-03-01' + CAST(c_custkey % 200 AS INT) AS TIMESTAMP), c_custkey FROM customer
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('t', CAST(s_nationkey % 5 AS STRING)), lower(replace(s_name, '#', ' ')), 'organization',
  CAST(DATE '2023-04-01' + CAST(s_suppkey % 100 AS INT) AS TIMESTAMP), s_suppkey + 3 FROM supplier
UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), concat('t', CAST(p_partkey % 5 AS STRING)), concat(lower(p_name), ' ', CAST(p_partkey AS STRING)), 'product',
  CAST(DATE '2023-05-01' + CAST(p_partkey % 100 AS INT) AS TIMESTAMP), p_partkey + 11 FROM part""",
    "entity_vectors": """
SELECT n.entity_id, n.tenant_id, n.canonical_name, n.entity_type, e.embedding
FROM (SELECT *, vec_key % (SELECT count(*) FROM embeddings) AS vec_place FROM entities) n JOIN embeddings e ON e.vec_id = n.vec_place""",
    "edges": """
SELECT concat(k.source_id, '|', k.relation, '|', k.target_id) AS edge_id, k.* FROM (
SELECT concat('n', CAST(n_nationkey AS STRING)) AS source_id, concat('r', CAST(n_regionkey AS STRING)) AS target_id, concat('t', CAST(n_regionkey AS STRING)) AS tenant_id,
  'located_in' AS relation, 'hierarchical' AS edge_type, CAST(1 AS DOUBLE) AS weight, CAST(DATE '2023-01-01' AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_until, CAST(NULL AS BIGINT) AS fact_id FROM nation
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), concat('t', CAST(c_nationkey % 5 AS STRING)),
  'lives_in', 'hierarchical', CAST(1 AS DOUBLE), CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS TIMESTAMP),
  CASE WHEN c_custkey % 6 = 0 THEN CAST(DATE '2024-01-10' + CAST(c_custkey % 30 AS INT) AS TIMESTAMP) END, c_custkey FROM customer
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), concat('t', CAST(s_nationkey % 5 AS STRING)),
  'located_in', 'hierarchical', CAST(1 AS DOUBLE), CAST(DATE '2023-01-01' AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT) FROM supplier
UNION ALL SELECT concat('u', CAST(n_regionkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)), concat('t', CAST(n_regionkey AS STRING)),
  'prefers', 'associative', CAST(0.7 AS DOUBLE), CAST(DATE '2023-01-01' AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT) FROM nation
UNION ALL SELECT concat('c', CAST(o.o_custkey AS STRING)), concat('s', CAST(l.l_suppkey AS STRING)), concat('t', CAST(c.c_nationkey % 5 AS STRING)),
  'uses', 'associative', CAST(0.5 AS DOUBLE), CAST(min(o.o_orderdate) AS TIMESTAMP),
  CASE WHEN count(*) % 4 = 3 THEN CAST(max(l.l_shipdate) AS TIMESTAMP) END, CAST(NULL AS BIGINT)
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey % 5 = c.c_nationkey % 5
  GROUP BY o.o_custkey, l.l_suppkey, c.c_nationkey % 5) k""",
    "fact_entities": """
SELECT doc_id AS fact_id, concat('n', CAST(doc_id % 25 AS STRING)) AS entity_id, 'mentioned' AS role FROM documents
UNION ALL SELECT d.doc_id, concat('c', CAST(c.c_custkey AS STRING)), 'subject' FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM customer) AS cust_key FROM documents) d
  JOIN customer c ON c.c_custkey = d.cust_key AND c.c_nationkey % 5 = d.doc_id % 5
UNION ALL SELECT doc_id, concat('u', CAST(doc_id % 5 AS STRING)), 'object' FROM documents""",
    "requests": """
SELECT b.item_id AS query_id, concat('t', CAST(b.item_id % 5 AS STRING)) AS tenant_id, 'user' AS scope,
  CASE WHEN b.item_id % 4 = 3 THEN 'fr' ELSE 'en' END AS scope_id,
  concat(b.text, ' ', CASE b.item_id % 7 WHEN 0 THEN 'the first trip to' WHEN 1 THEN 'in March about' WHEN 2 THEN 'yesterday my allergic list for'
    WHEN 3 THEN 'last month at' WHEN 4 THEN 'on 15th March, 2023 near' WHEN 5 THEN 'the last order from' ELSE 'plans and lives in' END,
    ' nation_', CAST(b.item_id % 25 AS STRING)) AS query,
  e.embedding AS embedding
FROM (SELECT *, item_id * 7 % (SELECT count(*) FROM embeddings) AS vec_key FROM benchmark) b JOIN embeddings e ON e.vec_id = b.vec_key""",
    "triggers": """
SELECT concat('g', CAST(n_nationkey AS STRING)) AS trigger_id, concat('t', CAST(n_nationkey % 5 AS STRING)) AS tenant_id, 'user' AS scope,
  CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END AS scope_id, n_nationkey % 7 <> 6 AS active, CAST(n_nationkey % 3 AS INT) AS priority,
  CASE n_nationkey % 6 WHEN 0 THEN '{"topic_match":["Trip","order"]}'
    WHEN 1 THEN concat('{"keyword_any":["', lower(n_name), '","nothing"]}')
    WHEN 2 THEN '{"AND":[{"entity_present":["Person"]},{"OR":[{"keyword_any":["march"]},{"topic_match":["plans"]}]}]}'
    WHEN 3 THEN concat('{"semantic_similarity":{"text":"', n_name, '","threshold":0.05}}')
    WHEN 4 THEN '{"OR":[{"topic_match":["allergic"]},{"entity_present":["spaceship"]}]}' ELSE '{}' END AS condition,
  CAST(n_nationkey AS BIGINT) AS fact_a, CAST(n_nationkey + 25 AS BIGINT) AS fact_b,
  concat('n', CAST(n_nationkey AS STRING)) AS watched_entity, n_name AS vector_text, e.embedding AS vector,
  CAST(n_nationkey % 4 AS BIGINT) AS times_fired
FROM (SELECT *, n_nationkey * 11 % (SELECT count(*) FROM embeddings) AS vec_key FROM nation) k JOIN embeddings e ON e.vec_id = k.vec_key""",
    "memory_accesses": """
SELECT event_id AS access_id, user_id AS fact_id, CAST(ts AS TIMESTAMP) AS accessed_at,
  CASE event_type WHEN 'purchase' THEN 'explicit_positive' WHEN 'click' THEN 'implicit_positive' WHEN 'error' THEN 'explicit_negative' WHEN 'view' THEN 'implicit_negative' ELSE 'correction' END AS feedback_type,
  value FROM events""",
    "session_messages": """
SELECT conv_id AS session_id, turn AS turn_number, role,
  concat(text, chr(10), CASE conv_id % 9
    WHEN 0 THEN concat(role, ': I live in nation_', CAST(conv_id % 25 AS STRING), '.')
    WHEN 1 THEN concat(role, ': I work at Supplier', CAST(conv_id AS STRING), '! It pays $12.50 or 300 euros')
    WHEN 2 THEN concat(role, ': My name is Customer Nine, remember it')
    WHEN 3 THEN concat(role, ': I am allergic to nuts from batch ', CAST(turn AS STRING), '?')
    WHEN 4 THEN concat(role, ': write to user', CAST(conv_id AS STRING), '@example.com or see https://example.com/', CAST(turn AS STRING))
    WHEN 5 THEN concat(role, ': We met on March 5th, 2023 and on 2024-01-', CAST(10 + turn AS STRING), '. I really love tea.')
    WHEN 6 THEN concat(role, ': call (555) 010-12', CAST(10 + turn AS STRING), ' as I moved to nation_', CAST(turn AS STRING))
    WHEN 7 THEN concat(role, ': I think that the plan is good. My favorite color is teal')
    ELSE concat(role, ': I hate rain') END) AS content,
  CASE WHEN conv_id % 3 = 0 THEN conv_id END AS extraction_id,
  CAST(DATE '2024-01-01' + CAST(conv_id % 20 AS INT) AS TIMESTAMP) + CAST(turn AS INT) * INTERVAL '7' MINUTE AS created_at
FROM conversations""",
    "fact_versions": """
SELECT o_custkey AS lineage_id, o_orderkey AS fact_id, o_orderstatus AS content, CAST(o_orderdate AS TIMESTAMP) AS valid_from,
  CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS TIMESTAMP) AS valid_until FROM orders""",
    "usage_events": """
SELECT concat('t', CAST(user_id % 20 AS STRING)) AS tenant_id, user_id, CAST(ts AS TIMESTAMP) AS ts, event_type, CAST(1 AS BIGINT) AS queries,
  CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE CAST(10 AS BIGINT) END AS tokens,
  CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS BIGINT) AS extractions, value AS cost_usd FROM events""",
    "sessions": """
SELECT c.conv_id AS session_id, concat('t', CAST(c.conv_id % 5 AS STRING)) AS tenant_id, 'user' AS scope, concat('s', CAST(c.conv_id % 3 AS STRING)) AS scope_id,
  CAST(DATE '2024-01-01' + CAST(c.conv_id % 25 AS INT) AS TIMESTAMP) AS started_at,
  CASE WHEN c.conv_id % 4 <> 0 THEN CAST(DATE '2024-01-02' + CAST(c.conv_id % 25 AS INT) AS TIMESTAMP) END AS ended_at, max(c.turn) + 1 AS turns
FROM conversations c GROUP BY c.conv_id""",
    "extractions": """
SELECT p.page_id AS extraction_id, concat('t', CAST(p.page_id % 5 AS STRING)) AS tenant_id, 'user' AS scope, CASE WHEN p.page_id % 2 = 0 THEN 'en' ELSE 'fr' END AS scope_id,
  'url' AS input_type, p.url AS data, CASE p.page_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
  CAST(length(p.html) AS BIGINT) AS tokens_in, p.page_id % 7 AS tokens_out, CAST(DATE '2024-01-01' + CAST(p.page_id % 28 AS INT) AS TIMESTAMP) AS created_at
FROM pages p""",
    "dependency_edges": """
SELECT concat('d', CAST(doc_id AS STRING)) AS edge_id, concat('t', CAST(doc_id % 5 AS STRING)) AS tenant_id,
  CASE WHEN floor(doc_id / 23) % 3 = 0 THEN 'precedes' WHEN floor(doc_id / 23) % 3 = 1 THEN 'depends_on' ELSE 'deadline' END AS relation,
  CASE WHEN doc_id % 23 = 0 THEN concat('{"sourceFactId":', CAST(doc_id AS STRING), ',"targetFactId":', CAST(doc_id + 115 AS STRING), ',"deadline":"2024-03-', CAST(10 + doc_id % 20 AS STRING), '"}')
    ELSE concat('{"sourceFactId":', CAST(doc_id AS STRING), ',"targetFactId":', CAST(23 * floor(doc_id / 23) AS BIGINT), '}') END AS metadata
FROM documents""",
    "webhooks": """
SELECT concat('w', CAST(s_suppkey AS STRING)) AS webhook_id, concat('t', CAST(s_suppkey % 5 AS STRING)) AS tenant_id, concat('secret-', s_name) AS secret,
  s_suppkey % 4 <> 3 AS active,
  CASE WHEN s_suppkey % 3 = 0 THEN split('extraction.completed,extraction.failed', ',') ELSE split('extraction.completed', ',') END AS events
FROM supplier""",
    "api_keys": """
SELECT concat('k', CAST(c_custkey AS STRING)) AS key_id, concat('t', CAST(c_nationkey % 5 AS STRING)) AS tenant_id, concat('sk_', lpad(CAST(c_custkey AS STRING), 9, '0')) AS key_prefix,
  CASE WHEN c_custkey % 5 = 0 THEN split('admin', ',') WHEN c_custkey % 2 = 0 THEN split('read,write', ',') ELSE split('read', ',') END AS scopes,
  c_custkey % 9 <> 0 AS active, CASE WHEN c_custkey % 3 = 0 THEN CAST(DATE '2024-01-20' + CAST(c_custkey % 30 AS INT) AS TIMESTAMP) END AS expires_at
FROM customer""",
}


def _uses(text: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]


def ctes(*names: str) -> str:
    """``name AS (…), …`` for the named views and the views they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for used in _uses(VIEWS[name]):
            visit(used)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the views it reads."""
    used = _uses(sql)
    if not used:
        return sql
    recursive = re.match(r"\s*WITH\s+RECURSIVE\b", sql, re.I)
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I) if re.match(
        r"\s*WITH\b", sql, re.I) else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ctes(*used) + (",\n" + rest if rest is not None else "\n" + sql)


class Tables:
    """Driver tables and memory views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    @property
    def now(self) -> Column:
        return F.expr(NOW)

    @property
    def as_of(self) -> Column:
        return F.expr(AS_OF)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in RAW:
                self._cache[name] = read_parquet(
                    self.spark, f"{self.folder}/{name}.parquet", SPREAD.get(name, ()))
            elif name in VIEWS:
                self._cache[name] = self._view(name)
            else:
                raise AttributeError(name)
        return self._cache[name]

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for used in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)\b", text)):
            if used in RAW or used in VIEWS:
                getattr(self, used).createOrReplaceTempView(f"_mf_{used}")
                text = re.sub(rf"\b(FROM|JOIN)\s+{used}\b", rf"\1 _mf_{used}", text)
        return self.spark.sql(text)

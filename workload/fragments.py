"""SQL fragments (DuckDB) shared by the oracles of the retrieval queries."""

from __future__ import annotations

from mnemoframe.functions import fixed_values as fv
from workload.views import NOW

S = "tenant_id, scope, scope_id"
SEARCHABLE = "source_type <> 'api' AND NOT list_contains(tags, 'raw_chunk')"


def valid(as_of: str | None = None, t: str = "") -> str:
    p = f"{t}." if t else ""
    if as_of is None:
        return f"{p}valid_until IS NULL"
    return f"({p}valid_from <= {as_of} AND ({p}valid_until IS NULL OR {p}valid_until > {as_of}))"


def terms(col: str, stops=fv.QUERY_STOP_WORDS) -> str:
    listed = ", ".join(f"'{w}'" for w in stops)
    return (f"list_filter(string_split_regex(lower({col}), '[^a-z0-9]+'), "
            f"lambda w: length(w) >= 2 AND NOT list_contains([{listed}], w))")


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def vector_cte(name: str, k: int, floor: float, where: str = "true", queries: str = "requests",
               as_of: str | None = None) -> str:
    return f"""
{name} AS (SELECT query_id, fact_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fact_id) AS position
  FROM (SELECT r.query_id, f.fact_id, round({cosine('f.embedding', 'r.embedding')}, 9) AS similarity
    FROM {queries} r JOIN facts f USING ({S}) WHERE {valid(as_of, 'f')} AND f.embedding IS NOT NULL AND {where}) p
  WHERE similarity >= {floor} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fact_id) <= {k})"""


def bm25_cte(name: str, k: int, where: str = "true", as_of: str | None = None,
             match_all: bool = False) -> str:
    k1, b = fv.BM25_K1, fv.BM25_B
    having = f"HAVING count(*) = any_value(qn.asked)" if match_all else ""
    return f"""
{name}_docs AS (SELECT {S}, fact_id, {terms('content')} AS ts FROM facts WHERE {valid(as_of)} AND {where}),
{name}_stats AS (SELECT {S}, count(*) AS n, avg(len(ts)) AS avg_dl FROM {name}_docs GROUP BY ALL),
{name}_post AS (SELECT {S}, fact_id, dl, term, count(*) AS tf FROM (SELECT {S}, fact_id, len(ts) AS dl, unnest(ts) AS term FROM {name}_docs) GROUP BY ALL),
{name}_df AS (SELECT {S}, term, count(*) AS df FROM {name}_post GROUP BY ALL),
{name}_q AS (SELECT DISTINCT {S}, query_id, unnest({terms('query')}) AS term FROM requests),
{name}_qn AS (SELECT query_id, count(*) AS asked FROM {name}_q GROUP BY ALL),
{name}_raw AS (SELECT q.query_id, p.fact_id, round(sum(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * p.tf * ({k1 + 1}::DOUBLE) / (p.tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * p.dl / s.avg_dl))), 9) AS raw_score
  FROM {name}_q q JOIN {name}_post p USING ({S}, term) JOIN {name}_df d USING ({S}, term) JOIN {name}_stats s USING ({S}) JOIN {name}_qn qn ON qn.query_id = q.query_id
  GROUP BY q.query_id, p.fact_id {having}),
{name}_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, fact_id) AS position FROM {name}_raw
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, fact_id) <= {k}),
{name} AS (SELECT *, CASE WHEN max(raw_score) OVER (PARTITION BY query_id) > 0 THEN raw_score / max(raw_score) OVER (PARTITION BY query_id) ELSE 0 END AS keyword_score FROM {name}_top)"""


TOKENS = ("list_filter(list_transform(string_split_regex(query, '[\\s.]+'), lambda w: "
          "lower(regexp_replace(w, '[^A-Za-z0-9_-]', '', 'g'))), lambda w: length(w) >= 2)")


def seeds_cte(name: str = "seeds") -> str:
    return f"""
{name}_tok AS (SELECT query_id, tenant_id, query, {TOKENS} AS t FROM requests),
{name}_names AS (
  SELECT query_id, tenant_id, unnest(t) AS canonical_name FROM {name}_tok
  UNION SELECT query_id, tenant_id, t[i] || ' ' || t[i + 1] FROM {name}_tok, LATERAL (SELECT unnest(range(1, len(t))) AS i)
  UNION SELECT query_id, tenant_id, t[i] || '.' || t[i + 1] FROM {name}_tok, LATERAL (SELECT unnest(range(1, len(t))) AS i)
  UNION SELECT query_id, tenant_id, trim(lower(query)) FROM {name}_tok
  UNION SELECT query_id, tenant_id, trim(regexp_replace(replace(lower(query), '.', ' '), '\\s+', ' ', 'g')) FROM {name}_tok
  UNION SELECT query_id, tenant_id, 'user' FROM {name}_tok WHERE regexp_matches(query, '(?i)\\b(user|me|my|i)\\b')),
{name} AS (SELECT DISTINCT query_id, n.tenant_id, entity_id FROM {name}_names n JOIN entities e USING (tenant_id, canonical_name))"""


def reach_cte(name: str = "reached", seeds: str = "seeds", depth: int = 2, cap: int = 200,
              as_of: str | None = None) -> str:
    return f"""
{name}_adj AS (SELECT tenant_id, source_id AS node, target_id AS neighbour FROM edges WHERE {valid(as_of)} AND source_id <> target_id
  UNION SELECT tenant_id, target_id, source_id FROM edges WHERE {valid(as_of)} AND source_id <> target_id),
{name}_walk AS (SELECT query_id, tenant_id, entity_id AS node, 0 AS depth FROM {seeds}
  UNION SELECT w.query_id, w.tenant_id, a.neighbour, w.depth + 1 FROM {name}_walk w JOIN {name}_adj a ON a.tenant_id = w.tenant_id AND a.node = w.node WHERE w.depth < {depth}),
{name} AS (SELECT query_id, tenant_id, node AS entity_id, depth FROM (SELECT query_id, tenant_id, node, min(depth) AS depth FROM {name}_walk GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, node) <= {cap})"""


def per_entity_cte(name: str, n: int) -> str:
    order = "ORDER BY f.importance DESC, f.created_at DESC, f.fact_id"
    return f"""
{name} AS (SELECT f.tenant_id, l.entity_id, f.fact_id, row_number() OVER (PARTITION BY f.tenant_id, l.entity_id {order}) AS rank
  FROM fact_entities l JOIN facts f USING (fact_id) WHERE f.valid_until IS NULL AND NOT list_contains(f.tags, 'raw_chunk')
  QUALIFY row_number() OVER (PARTITION BY f.tenant_id, l.entity_id {order}) <= {n})"""


def graph_facts_cte(name: str, k: int, reached: str = "reached") -> str:
    return per_entity_cte(f"{name}_pe", max(3, k)) + f""",
{name}_b AS (SELECT *, greatest(3, ceil({float(k)} / count(*) OVER (PARTITION BY query_id))) AS budget FROM {reached}),
{name}_s AS (SELECT b.query_id, p.fact_id, max(pow(0.5, b.depth)) AS graph_score FROM {name}_pe p JOIN {name}_b b USING (tenant_id, entity_id) WHERE p.rank <= b.budget GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, fact_id) AS position FROM {name}_s
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, fact_id) <= {k})"""


def entity_types_cte(name: str = "etypes") -> str:
    return f"""
{name} AS (SELECT tenant_id, list(DISTINCT lower(entity_type)) AS types FROM entities GROUP BY ALL)"""


def fired_cte(name: str = "fired") -> str:
    """The six condition shapes of the triggers view, written out one by one."""
    q = "lower(r.query)"
    return entity_types_cte() + f""",
{name} AS (SELECT r.query_id, g.trigger_id, g.priority FROM requests r JOIN triggers g USING ({S}) LEFT JOIN etypes t ON t.tenant_id = r.tenant_id
  WHERE g.active AND CASE CAST(substr(g.trigger_id, 2) AS INT) % 6
    WHEN 0 THEN contains({q}, 'trip') OR contains({q}, 'order')
    WHEN 1 THEN contains({q}, lower(g.vector_text)) OR contains({q}, 'nothing')
    WHEN 2 THEN list_contains(t.types, 'person') AND (contains({q}, 'march') OR contains({q}, 'plans'))
    WHEN 3 THEN {cosine('r.embedding', 'g.vector')} >= 0.05
    WHEN 4 THEN contains({q}, 'allergic') OR list_contains(t.types, 'spaceship')
    ELSE false END)"""


def surfaced_cte(name: str = "surfaced", fired: str = "fired") -> str:
    return f"""
{name}_new AS (SELECT l.entity_id, f.tenant_id, f.fact_id FROM fact_entities l JOIN facts f USING (fact_id) WHERE f.valid_until IS NULL
  QUALIFY row_number() OVER (PARTITION BY f.tenant_id, l.entity_id ORDER BY f.created_at DESC, f.fact_id DESC) <= 10),
{name}_tq AS (SELECT x.query_id || '|' || x.trigger_id AS query_id, x.query_id AS qid, x.trigger_id, x.priority, r.tenant_id, r.scope, r.scope_id, g.vector AS embedding
  FROM {fired} x JOIN requests r USING (query_id) JOIN triggers g USING (trigger_id) WHERE g.priority > 0),
{vector_cte(name + '_t', 5, 0.0, queries=name + '_tq')},
{name} AS (
  SELECT x.query_id, f.fact_id, x.trigger_id, x.priority, 0 AS part, 0.0::DOUBLE AS vector_score FROM {fired} x JOIN requests r USING (query_id) JOIN triggers g USING (trigger_id)
    JOIN facts f ON f.tenant_id = r.tenant_id AND f.fact_id IN (g.fact_a, g.fact_b) WHERE f.valid_until IS NULL
  UNION ALL SELECT x.query_id, n.fact_id, x.trigger_id, x.priority, 1, 0.0 FROM {fired} x JOIN requests r USING (query_id) JOIN triggers g USING (trigger_id)
    JOIN {name}_new n ON n.tenant_id = r.tenant_id AND n.entity_id = g.watched_entity
  UNION ALL SELECT q.qid, t.fact_id, q.trigger_id, q.priority, 2, t.similarity FROM {name}_t t JOIN {name}_tq q USING (query_id))"""


def time_ref_cte(name: str = "refs", table: str = "requests", now: str = NOW) -> str:
    """Time reference columns y, m, d, ordering of each query text."""
    q = "lower(query)"
    dated, named = [], []
    for i, (full, short) in enumerate(zip(fv.MONTHS, fv.MONTH_ABBREVIATIONS), 1):
        w = f"(?:{full}|{short})"
        fwd = rf"\b{w}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:[,\s]+(\d{{4}}))?"
        bwd = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+{w}\b(?:[,\s]+(\d{{4}}))?"
        for p in (fwd, bwd):
            dated.append((f"regexp_matches({q}, '{p}')",
                          f"nullif(regexp_extract({q}, '{p}', 2), '')", str(i),
                          f"nullif(regexp_extract({q}, '{p}', 1), '')"))
        named.append((f"regexp_matches({q}, '\\b{w}\\b')", "NULL", str(i), "NULL"))
    y = f"({now} - INTERVAL 1 DAY)"
    wk = f"({now} - INTERVAL 7 DAY)"
    mo = f"({now} - INTERVAL 1 MONTH)"
    rel = [(f"regexp_matches({q}, '\\byesterday\\b')", f"year{y}", f"month{y}", f"day{y}"),
           (f"regexp_matches({q}, '\\blast\\s+week\\b')", f"year{wk}", f"month{wk}", f"day{wk}"),
           (f"regexp_matches({q}, '\\blast\\s+month\\b')", f"year{mo}", f"month{mo}", "NULL")]
    rules = dated + named + rel

    def case(pos: int) -> str:
        return "CASE " + " ".join(f"WHEN {r[0]} THEN CAST({r[pos]} AS INT)" for r in rules) + " END"

    return f"""
{name} AS (SELECT query_id, {case(1)} AS y, {case(2)} AS m, {case(3)} AS d,
  CASE WHEN regexp_matches({q}, '\\blast\\b') AND NOT regexp_matches({q}, '\\blast\\s+(week|month|year)\\b') THEN 'last'
       WHEN regexp_matches({q}, '\\bfirst\\b') THEN 'first' END AS ordering FROM {table})"""

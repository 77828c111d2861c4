"""Registered queries against their SQL on the smallest data set.

All of them with MNEMOFRAME_ALL=1; without it, one in each family.
"""

import math
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from workload.views import RAW

FOLDER = "/root/testdata/sf0.001"
FAMILIES = (
    "vec_topk", "kw_bm25", "compound_search", "graph_search", "trigger_surface", "full_search",
    "scope_pages_next", "incident_edges", "edit_facts_versions", "purge_scope_cascade",
    "versions_at_times", "usage_upsert", "session_windows", "cross_links", "mentioned_entities",
    "user_profiles", "recall_dependencies", "extract_facts", "export_scopes", "stream_sessions")
NAMES = sorted(oracle_sql()) if os.environ.get("MNEMOFRAME_ALL") else FAMILIES

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not there")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in RAW:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cursor = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(
        columns, cursor.fetchall())

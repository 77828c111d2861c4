"""Blocked similarities, the coarse vector index and the stored keyword index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import keyword_index, keyword_search, vector_blocks, vector_index, vector_search
from mnemoframe.operators.lookups import SCOPE

SCHEMA = "tenant_id string, scope string, scope_id string, fact_id long, content string, embedding array<float>"


def facts(spark, count=600, seed=1):
    rnd = random.Random(seed)
    words = ["tea", "rain", "plan", "trip", "nation", "order", "the", "and", "late", "train", "x1", "y2", "zeta"]
    rows = []
    for n in range(count):
        vector = [rnd.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]
        vector = [None, [], [0.0] * 6, vector[:3], vector][min(n % 40, 4)]
        rows.append(("t1" if n % 10 else "t2", "user", "hot" if n % 5 else None, n,
                     " ".join(rnd.choice(words[:3 + n % 11]) for _ in range(rnd.choice([0, 1, 6, 30]))) or None, vector))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def queries(spark, seed=2):
    rnd = random.Random(seed)
    rows = []
    for n in range(30):
        vector = [None, [], [0.0] * 6, [1.0, 2.0, 3.0]][n] if n < 4 else [rnd.uniform(-1, 1) for _ in range(6)]
        rows.append((n, "t1" if n % 3 else "t2", "user", "hot" if n % 7 else None, "tea and late trains x1 order", vector))
    return spark.createDataFrame(rows, "query_id long, tenant_id string, scope string, scope_id string, query string, embedding array<float>")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_blocks_equal_the_join(spark, monkeypatch):
    stored, asked = facts(spark), queries(spark)
    for floor in (-1.0, 0.0, 0.3):
        want = vector_search.joined_pairs(asked, stored, SCOPE, "fact_id", floor)
        found = vector_search.similar_pairs(asked, stored, SCOPE, "fact_id", floor)
        assert rows_of(found) == rows_of(want)
    monkeypatch.setattr(vector_blocks, "QUERY_ROWS", 5)
    assert vector_blocks.vector_blocks(asked, stored, SCOPE, "fact_id", 0.0) is None
    large = rows_of(vector_search.nearest(asked, stored, SCOPE, "fact_id", 7, 0.0))
    monkeypatch.undo()
    monkeypatch.setattr(vector_blocks, "_HELD", 50)  # cut down often
    assert rows_of(vector_search.nearest(asked, stored, SCOPE, "fact_id", 7, 0.0)) == large
    assert vector_search.nearest(asked.limit(0), stored, SCOPE, "fact_id", 7, 0.0).count() == 0
    assert vector_search.nearest(asked, stored.limit(0), SCOPE, "fact_id", 7, 0.0).count() == 0


def test_no_vector_is_shuffled(spark):
    plan = vector_search.nearest(queries(spark), facts(spark), SCOPE, "fact_id", 7, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_index_with_all_cells_is_exact(spark, tmp_path):
    stored, asked = facts(spark), queries(spark)
    centres = vector_index.fit(stored, "fact_id", cells=12)
    index = vector_index.write(stored, centres, str(tmp_path / "a"), shards=2)
    want = rows_of(vector_search.nearest(asked, stored, SCOPE, "fact_id", 9, 0.0))
    assert rows_of(vector_index.search(asked, index, 9, probes=index.cells)) == want
    again = vector_index.load(spark, str(tmp_path / "a"))
    assert again.on == SCOPE and rows_of(vector_index.search(asked, again, 9, probes=index.cells)) == want
    # a scope of few rows is searched whole
    assert rows_of(vector_index.search(asked, index, 9, probes=1, reach=10_000)) == want
    few = rows_of(vector_index.search(asked, index, 9, probes=1, reach=1))
    assert few and few != want
    exact = vector_search.nearest(asked, stored, SCOPE, "fact_id", 9, 0.0)
    told = vector_index.recall(vector_index.search(asked, index, 9, probes=1, reach=1), exact).agg(F.sum("met"), F.sum("wanted")).first()
    assert told[0] == len({r[:2] for r in few} & {r[:2] for r in want}) and told[1] == len(want)


def test_index_reads_probed_cells_only(spark, tmp_path):
    stored = facts(spark)
    index = vector_index.write(stored, vector_index.fit(stored, "fact_id", cells=12), str(tmp_path / "a"))
    one = queries(spark).where("query_id = 10")
    plan = vector_index.search(one, index, 3, probes=2, reach=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_index_of_nothing(spark, tmp_path):
    none = facts(spark).limit(0)
    index = vector_index.write(none, vector_index.fit(none, "fact_id"), str(tmp_path / "a"))
    assert vector_index.search(queries(spark), index).count() == 0
    keyword_index.write(none, str(tmp_path / "b"))
    assert keyword_index.search(spark, queries(spark), str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_stored_keywords_equal_the_search(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(keyword_index, "RANGE_FACTS", 8)
    stored = facts(spark, 900).where("scope_id is not null")
    asked = queries(spark)
    keyword_index.write(stored, str(tmp_path))
    open_facts = stored.withColumns({"valid_until": F.lit(None).cast("timestamp"), "valid_from": F.lit(None).cast("timestamp")})
    for match_all in (False, True):
        want = rows_of(keyword_search.keyword_search(asked, open_facts, k, match_all=match_all).select(
            "query_id", "fact_id", F.round("raw_score", 6), "position"))
        got = keyword_index.search(spark, asked, str(tmp_path), k, match_all=match_all)
        assert rows_of(got.select("query_id", "fact_id", F.round("raw_score", 6), "position")) == want
        assert want if not match_all else True
    assert "content" not in got._jdf.queryExecution().analyzed().toString()


def test_stored_keywords_skip_ranges(spark):
    met = spark.createDataFrame(
        [(1, r, 5.0 if r < 3 else 0.5) for r in range(40)] + [(1, 7, 4.4), (1, 8, 4.6)], "query_id long, range long, _most double")
    assert {r.range for r in keyword_index.promising_ranges(met, 3).collect()} == {0, 1, 2, 8}
    assert keyword_index.promising_ranges(met, 41).count() == 40


def test_products_with_centres_are_bounded(spark, monkeypatch):
    stored, asked = facts(spark), queries(spark)
    centres = vector_index.fit(stored, "fact_id", 9)
    kept = ["fact_id"]
    want = [rows_of(vector_index._nearest_cells(stored.where("embedding is not null"), kept, centres, p)) for p in (1, 4, 9)]
    monkeypatch.setattr(vector_index, "NEAR_VALUES", 20)  # two rows at once
    monkeypatch.setattr(vector_blocks, "_AT_ONCE", 7)
    assert want == [rows_of(vector_index._nearest_cells(stored.where("embedding is not null"), kept, centres, p)) for p in (1, 4, 9)]
    best = vector_blocks._Best(vector_blocks._Queries(asked.where("embedding is not null").select(
        *SCOPE, "query_id", F.col("embedding").cast("array<double>").alias("embedding")).toArrow(), SCOPE), 3, -1.0)
    sizes = []
    monkeypatch.setattr(vector_blocks, "_unit", lambda m: sizes.append(len(m)) or m)
    for batch in stored.where("embedding is not null").select(*SCOPE, "fact_id", "embedding").toArrow().combine_chunks().to_batches():
        list(best.add(batch, SCOPE, "fact_id"))
    assert sizes and max(sizes) <= 7

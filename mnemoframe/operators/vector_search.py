"""Exact nearest facts by cosine, for a batch of queries, and duplicates told by them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.functions import fixed_values as fv, vectors
from mnemoframe.operators.grouping import many_parts, salted_join, top_k
from mnemoframe.operators.lookups import SCOPE, searchable, valid_at
from mnemoframe.operators.vector_blocks import CELL_ROWS, Vectors, vector_blocks, vector_cells
from mnemoframe.session import stored

# Similarities closer than this count as equal, so ties break by id on any machine.
TIE_DIGITS = 9
HEADS = 4_096  # rows of a scope that are decided in one task


def with_norm(rows: DataFrame, vector: str, out: str) -> DataFrame:
    """Keep rows that have a vector, as doubles with their length next to it."""
    wide = rows.where(F.col(vector).isNotNull()).withColumn(vector, vectors.doubles(F.col(vector)))
    return wide.withColumn(out, vectors.norm(F.col(vector)))


def similar_pairs(queries: DataFrame, rows: DataFrame, on: Sequence[str], row_id: str,
                  min_similarity: float, salts: int = 8, k: int | None = None) -> DataFrame:
    """``query_id, row_id, similarity`` of pairs that share the keys and pass the floor.

    Queries of a checked size meet the vectors where those lie; of more of them, blocks meet blocks.
    With ``k`` only rows that can be among a query's best ``k`` need come.
    """
    found = vector_blocks(queries, rows, on, row_id, min_similarity, k)
    if found is None and not on:
        return joined_pairs(queries, rows, on, row_id, min_similarity, salts)
    if found is None:
        found = vector_cells(queries, rows, on, row_id, min_similarity, k)
    rounded = F.round("similarity", TIE_DIGITS)
    return found.withColumn("similarity", rounded).where(F.col("similarity") >= min_similarity)


def joined_pairs(queries: DataFrame, rows: DataFrame, on: Sequence[str], row_id: str,
                 min_similarity: float, salts: int = 8) -> DataFrame:
    """The same pairs for any number of queries and without Python, which is slow where scopes are large.

    The join is an equi-join on the scope, hot scopes are salted, and vectors are
    dropped as soon as the similarity is known.
    """
    left = with_norm(rows.select(*on, row_id, "embedding"), "embedding", "_norm")
    right = with_norm(
        queries.select(*on, "query_id", F.col("embedding").alias("_query")), "_query", "_qnorm")
    similarity = F.round(vectors.cosine(F.col("embedding"), F.col("_query"), F.col("_norm"),
                                        F.col("_qnorm")), TIE_DIGITS)
    # a plain filter would be pushed into the join and compute the product twice
    passing = F.filter(F.array(similarity), lambda s: s >= min_similarity)
    return salted_join(left, right, on, row_id, salts).select(
        "query_id", row_id, F.explode(passing).alias("similarity"))


def nearest(queries: DataFrame, rows: DataFrame, on: Sequence[str], row_id: str, k: int,
            min_similarity: float, salts: int = 8) -> DataFrame:
    pairs = similar_pairs(queries, rows, on, row_id, min_similarity, salts, k)
    return top_k(pairs, ["query_id"], [F.col("similarity").desc(), F.col(row_id)], k,
                 rank="position")


def vector_search(queries: DataFrame, facts: DataFrame, k: int = fv.DEFAULT_LIMIT,
                  min_similarity: float = 0.0, as_of: Column | None = None,
                  only_searchable: bool = False) -> DataFrame:
    """Nearest valid facts in each query's scope: ``query_id, fact_id, similarity, position``."""
    rows = facts.where(valid_at(as_of))
    if only_searchable:
        rows = rows.where(searchable())
    return nearest(queries, rows, SCOPE, "fact_id", k, min_similarity)


def match_entities(queries: DataFrame, entities: DataFrame, k: int = fv.DEFAULT_LIMIT,
                   min_similarity: float = fv.ENTITY_MIN_SIMILARITY) -> DataFrame:
    """Nearest entities of the query's tenant."""
    return nearest(queries, entities, ("tenant_id",), "entity_id", k, min_similarity)


def rerank(results: DataFrame, queries: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """Blend a result's score with query similarity and keep the best ``k``."""
    vectors_of = facts.select("fact_id", vectors.doubles(F.col("embedding")).alias("_fact"))
    asked = queries.select("query_id", vectors.doubles(F.col("embedding")).alias("_query"))
    scored = results.join(vectors_of, "fact_id").join(asked, "query_id").withColumn(
        "reranked_score", F.round(scoring_blend(
            F.col("score"), F.coalesce(vectors.cosine(F.col("_fact"), F.col("_query")),
                                       F.lit(0.0))), TIE_DIGITS))
    return top_k(scored.drop("_fact", "_query"), ["query_id"],
                 [F.col("reranked_score").desc(), F.col("fact_id")], k, rank="position")


def scoring_blend(score: Column, similarity: Column) -> Column:
    return score * F.lit(1.0 - fv.RERANK_WEIGHT) + similarity * F.lit(fv.RERANK_WEIGHT)


def deduplicate(candidates: DataFrame, facts: DataFrame,
                min_similarity: float = fv.DEDUP_MIN_SIMILARITY,
                k: int = fv.DEDUP_MATCHES, order: str = "query_id",
                same_similarity: float | None = None) -> DataFrame:
    """Operation of each extracted fact against the stored ones and the batch itself.

    ``candidates`` holds ``query_id``, the scope, ``content``, ``embedding``, ``operation``
    and ``order``, the input order.  An operation other than add is trusted.  Text that an
    open fact of the scope has, or an earlier candidate, means noop; so does, with
    ``same_similarity``, a vector that near to an earlier candidate's that stays.  Anything
    else is an add unless a classifier says otherwise: ``match_count`` and ``best_fact_id`` are
    the ``k`` nearest stored facts above the floor, which it would get to see.
    """
    # written once: vectors are costly to make and read by each step below
    batch = stored(candidates.withColumns({
        "_add": F.coalesce("operation", F.lit("add")) == "add",
        "_text": _said(), "_place": F.struct(F.col(order).alias("order"), F.col("query_id").alias("id"))}), "candidates")
    undecided = batch.where("_add")
    seen = (vector_search(undecided, facts, k, min_similarity).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("match_count"), F.min_by("fact_id", "position").alias("best_fact_id")))
    on = [*SCOPE, "_text"]
    known = facts.where(valid_at()).withColumn("_text", _said()).select(*on).distinct()
    firsts = undecided.select(*on, "_place").groupBy(*on).agg(F.min("_place").alias("_first"))
    told = firsts.join(known.withColumn("_known", F.lit(True)), on, "left")
    spread = salted_join(undecided.select(*on, "query_id", "_place"), told, on, "query_id")
    same = spread.where(F.coalesce("_known", F.lit(False)) | (F.col("_place") != F.col("_first"))).select("query_id")
    if same_similarity is not None:
        new = undecided.join(same, "query_id", "left_anti")
        same = same.unionByName(near_earlier(new, same_similarity))
    decided = F.when(~F.col("_add"), F.col("operation")).when(
        F.col("_same").isNotNull(), F.lit("noop")).otherwise(F.lit("add"))
    same = same.withColumn("_same", F.lit(True))
    return (batch.join(seen, "query_id", "left").join(same, "query_id", "left")
            .withColumn("operation", decided)
            .withColumn("match_count", F.coalesce("match_count", F.lit(0)))
            .drop("_same", "_add", "_text", "_place"))


def _said() -> Column:
    """A text but for case and space around it, as a digest: texts are long and only compared."""
    return F.sha2(F.lower(F.trim("content")), 256)


def near_earlier(rows: DataFrame, min_similarity: float, heads: int = HEADS) -> DataFrame:
    """``query_id`` of the rows that go, each for a near one of its scope that comes before it and stays.

    Round by round, the first ``heads`` rows of each scope are decided one after the other; what
    stays is kept from the others by blocks, and those near to it go.  No pair is written down.
    """
    with_vector = rows.where(F.col("embedding").isNotNull()).dropna(subset=list(SCOPE)).select(
        *SCOPE, "query_id", "_place", F.col("embedding").cast("array<double>").alias("embedding"))
    open_ = stored(with_vector, "open-rows")
    ids = open_.select("query_id", *SCOPE).distinct().groupBy("query_id").count()
    if not ids.where("query_id IS NULL OR count > 1").isEmpty():  # a row of several scopes is decided by all of them
        return first_wins(_earlier_neighbours(rows, min_similarity)).withColumnRenamed("later", "query_id")
    gone = open_.select("query_id").limit(0)
    nth = F.dense_rank().over(Window.partitionBy(*SCOPE).orderBy("_place"))
    parts = many_parts(open_.sparkSession)
    schema = open_.schema.add("_stays", "boolean")
    narrow = open_.select("query_id").schema.add("_near", "boolean")

    def decide(table: pa.Table) -> pa.Table:
        number = table.column("_nth").to_numpy()
        vectors = Vectors(table.column("embedding"))
        out = np.zeros(int(number.max()) + 1, dtype=bool)
        for n in np.unique(number).tolist():
            if not out[n]:
                later = vectors.only(number > n)
                near = later.near(vectors.only(number == n), min_similarity, TIE_DIGITS)
                out[np.unique(number[near])] = True
        return table.drop_columns(["_nth"]).append_column("_stays", pa.array(~out[number]))

    def sift(stay: pa.Table, rest: pa.Table) -> pa.Table:
        near = Vectors(rest.column("embedding")).near(Vectors(stay.column("embedding")), min_similarity, TIE_DIGITS)
        return rest.select(["query_id"]).append_column("_near", pa.array(near))

    while not open_.isEmpty():
        first = open_.withColumn("_nth", nth).where(F.col("_nth") <= heads)
        decided = stored(first.repartition(parts, *SCOPE).groupBy(*SCOPE).applyInArrow(decide, schema), "decided-rows")
        ends = decided.groupBy(*SCOPE).agg(F.max("_place").alias("_end"))
        rest = open_.join(ends, list(SCOPE)).where(F.col("_place") > F.col("_end")).drop("_end")
        blocks = rest.groupBy(*SCOPE).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("_blocks"))
        stay = decided.where("_stays").select(*SCOPE, "embedding").join(blocks, list(SCOPE)).select(
            *SCOPE, "embedding", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
        dealt = rest.join(blocks, list(SCOPE)).select(
            *SCOPE, "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int").alias("_block"))
        cell = [*SCOPE, "_block"]
        sifted = stay.repartition(parts, *cell).groupBy(*cell).cogroup(
            dealt.repartition(parts, *cell).groupBy(*cell)).applyInArrow(sift, narrow)
        near = stored(sifted.where("_near").select("query_id").distinct(), "near-rows")
        gone = gone.unionByName(decided.where("NOT _stays").select("query_id").distinct()).unionByName(near)
        open_ = stored(rest.join(near, "query_id", "left_anti"), "open-rows")
    return gone


def _earlier_neighbours(rows: DataFrame, min_similarity: float) -> DataFrame:
    """``earlier, later`` of the pairs of a scope that are near, by input order."""
    asked = rows.select(*SCOPE, "query_id", "embedding")
    pairs = similar_pairs(asked, asked.withColumnRenamed("query_id", "other"), SCOPE, "other", min_similarity)
    places = rows.select("query_id", "_place")
    return (pairs.join(places, "query_id")
            .join(places.select(F.col("query_id").alias("other"), F.col("_place").alias("_other")), "other")
            .where(F.col("_other") < F.col("_place")).select(F.col("other").alias("earlier"), F.col("query_id").alias("later")))


def first_wins(pairs: DataFrame) -> DataFrame:
    """``later`` of the nodes that go when each goes only for an earlier one that stays.

    ``pairs`` holds ``earlier, later``.  In a round, nodes without an open pair before
    them stay, what follows them goes, and its pairs with it; each round is a written table of fewer pairs.
    """
    open_ = stored(pairs, "open-pairs")
    gone = open_.select("later").limit(0)
    while not open_.isEmpty():
        stay = open_.select("earlier").distinct().join(
            open_.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        going = stored(open_.join(stay, "earlier", "left_semi").select("later").distinct(), "going")
        gone = gone.unionByName(going)
        open_ = stored(open_.join(going, "later", "left_anti").join(
            going.select(F.col("later").alias("earlier")), "earlier", "left_anti").select("earlier", "later"), "open-pairs")
    return gone

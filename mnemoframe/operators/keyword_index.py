"""Keyword search on a stored inverted index, without the texts.

``write`` stores three tables under a folder:

* ``postings``: a row for each fact and term with its count and the fact's length, in
  folders by a hash of the term, sorted by term;
* ``blocks``: the facts of a scope are dealt into ranges of some ``RANGE_FACTS``; a row for
  each term and range has the largest weight that the term gives to a fact there, and how
  many facts of the scope have the term;
* ``scopes``: number of facts and mean length.

``search`` reads the blocks of the asked terms.  In each range a query's best fact scores at
least its best single bound, and at most the sum of its bounds.  The ``k``-th largest of the
former over all ranges is a score that ``k`` different facts reach, so ranges whose sum stays
below it are skipped; the postings of asked terms in the ranges that are left are read and scored exactly.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from mnemoframe.functions import fixed_values as fv
from mnemoframe.operators.grouping import many_parts, top_k
from mnemoframe.operators.keyword_search import (
    bm25_saturation, corpus_stats, idf, normalized, query_terms, term_counts)
from mnemoframe.operators.lookups import SCOPE
from mnemoframe.operators.vector_search import TIE_DIGITS
from mnemoframe.session import stored

RANGE_FACTS = 128
FOLDERS = 64
PARTS = 8  # of a folder


def _folder(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def write(facts: DataFrame, path: str, on: Sequence[str] = SCOPE) -> None:
    """Index the given facts; which of them are searched is decided here, not by the search."""
    spark = facts.sparkSession
    corpus_stats(facts, on).write.parquet(f"{path}/scopes")
    scopes = spark.read.parquet(f"{path}/scopes")
    spans = scopes.select(*on, "avg_dl", F.ceil(F.col("n_facts") / RANGE_FACTS).alias("_ranges"))
    # all rows of a scope's term are in one task, so what is counted below needs no other shuffle
    parts = many_parts(spark)
    place = ["folder", "part"]
    part = F.pmod(F.xxhash64(*on, "term", F.lit("part")), F.lit(PARTS)).cast("int")
    key = [*place, *on, "term", "range"]
    listed = (term_counts(facts, on).join(spans.drop("avg_dl"), list(on))
              .withColumn("range", F.pmod(F.xxhash64("fact_id"), F.col("_ranges")))
              .withColumn("folder", _folder()).withColumn("part", part).drop("_ranges")
              .repartition(parts, *place).groupBy(*key, "fact_id", "dl").agg(F.sum("tf").alias("tf"))
              .sortWithinPartitions("folder", "term", *on, "range")
              .select(*on, "term", "range", "fact_id", "tf", "dl", "folder"))
    _stored(listed, f"{path}/postings")
    rows = _read(spark, f"{path}/postings").join(spans.drop("_ranges"), list(on)).withColumn("part", part)
    bounds = rows.groupBy(*key).agg(
        F.max(bm25_saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))).alias("bound"),
        F.count(F.lit(1)).alias("_facts"))
    bounds = bounds.repartition(parts, *place).withColumn(
        "df", F.sum("_facts").over(Window.partitionBy(*place, *on, "term")))
    _stored(bounds.sortWithinPartitions("folder", "term", *on)
            .select(*on, "term", "range", "bound", "df", "folder"), f"{path}/blocks")


def _stored(rows: DataFrame, path: str) -> None:
    """By folder, with the schema beside: a table without rows has no file that tells it."""
    rows.write.partitionBy("folder").parquet(path)
    rows.sparkSession.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.text(f"{path}-schema")


def _read(spark: SparkSession, path: str) -> DataFrame:
    told = spark.read.text(f"{path}-schema").first()[0]
    return spark.read.schema(T.StructType.fromJson(json.loads(told))).parquet(path)


def search(spark: SparkSession, queries: DataFrame, path: str, k: int = fv.DEFAULT_LIMIT,
           on: Sequence[str] = SCOPE, match_all: bool = False) -> DataFrame:
    """Best ``k`` facts per query: ``query_id, fact_id, raw_score, keyword_score, position``."""
    # written once: small, and known to be small, so the index is read where it lies
    terms = stored(query_terms(queries, on).withColumn("folder", _folder()), "asked-terms")
    wanted = [r["folder"] for r in terms.select("folder").distinct().collect()]  # FOLDERS at most
    keys = ["folder", *on, "term"]
    scopes = spark.read.parquet(f"{path}/scopes")
    blocks = _read(spark, f"{path}/blocks").where(F.col("folder").isin(wanted))
    met = (terms.join(blocks, keys).join(scopes, list(on))
           .withColumn("_idf", idf(F.col("df"), F.col("n_facts")))
           .withColumn("_most", F.col("_idf") * F.col("bound")))
    kept = met.join(promising_ranges(met, k, match_all), ["query_id", "range"])
    listed = _read(spark, f"{path}/postings").where(F.col("folder").isin(wanted)).join(
        terms.select(*keys).distinct(), keys, "left_semi")
    scored = kept.select(*keys, "range", "query_id", "_idf", "avg_dl").join(listed, [*keys, "range"]).select(
        "query_id", "fact_id",
        (F.col("_idf") * bm25_saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))).alias("_weight"))
    totals = scored.groupBy("query_id", "fact_id").agg(
        F.round(F.sum("_weight"), TIE_DIGITS).alias("raw_score"), F.count(F.lit(1)).alias("_matched"))
    if match_all:
        asked = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_asked"))
        totals = totals.join(asked, "query_id").where(F.col("_matched") == F.col("_asked"))
    best = top_k(totals.select("query_id", "fact_id", "raw_score"), ["query_id"],
                 [F.col("raw_score").desc(), F.col("fact_id")], k, rank="position")
    return best.withColumn("keyword_score", normalized(F.col("raw_score"), ["query_id"]))


def promising_ranges(met: DataFrame, k: int, match_all: bool = False) -> DataFrame:
    """``query_id, range`` of the ranges that can hold one of a query's best ``k`` facts.

    ``met`` has the blocks of each query's terms with the most they give (``_most``).  Where all terms are
    asked for, a range's best single bound is no score that a fact reaches, so all ranges stay.
    """
    ranges = met.groupBy("query_id", "range").agg(
        F.sum("_most").alias("_sum"), F.max("_most").alias("_best"))
    if match_all:
        return ranges.select("query_id", "range")
    least = top_k(ranges, ["query_id"], [F.col("_best").desc(), F.col("range")], k).groupBy("query_id").agg(
        F.min("_best").alias("_kth"), F.count(F.lit(1)).alias("_count"))
    slack = 1e-6  # scores are compared after rounding
    return ranges.join(least, "query_id").where(
        (F.col("_count") < k) | (F.col("_sum") >= F.col("_kth") - slack)).select("query_id", "range")

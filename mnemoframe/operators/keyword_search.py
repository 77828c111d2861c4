"""BM25 over scoped facts, for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mnemoframe.functions import fixed_values as fv
from mnemoframe.functions.text import search_terms
from mnemoframe.operators.grouping import salted_join, top_k
from mnemoframe.operators.lookups import SCOPE, searchable, valid_at
from mnemoframe.operators.vector_search import TIE_DIGITS
from mnemoframe.session import stored

_ROWS_AT_ONCE = 256  # texts whose terms are counted together


def postings(facts: DataFrame, on: Sequence[str] = SCOPE) -> DataFrame:
    """``scope…, fact_id, term, tf, dl``: the inverted index, one row per term of a fact.

    Term counts are folded per fact before the shuffle.  ``keyword_index`` stores it.
    """
    docs = facts.select(*on, "fact_id", search_terms(F.col("content")).alias("_terms"))
    words = docs.select(*on, "fact_id", F.size("_terms").cast("long").alias("dl"),
                        F.explode("_terms").alias("term"))
    return words.groupBy(*on, "fact_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(facts: DataFrame, on: Sequence[str] = SCOPE) -> DataFrame:
    """The rows of ``postings`` counted within each row of facts, so without a shuffle; a fact of several rows has several."""
    docs = facts.select(*on, "fact_id", search_terms(F.col("content")).alias("term"))
    schema = T.StructType([*docs.drop("term").schema, T.StructField("dl", T.LongType()),
                           T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return docs.where(F.size("term") > 0).mapInArrow(lambda batches: _counted(batches, [*on, "fact_id"]), schema)


def _counted(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, len(whole), _ROWS_AT_ONCE):
            batch = whole.slice(first, _ROWS_AT_ONCE)
            lists = batch.column("term")
            sizes = lists.value_lengths().to_numpy()
            words = lists.flatten().dictionary_encode()
            many = max(len(words.dictionary), 1)
            pair, times = np.unique(np.repeat(np.arange(len(batch)), sizes) * many + words.indices.to_numpy(), return_counts=True)
            row = pa.array(pair // many)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in keep), pa.array(sizes.astype(np.int64)).take(row),
                 words.dictionary.take(pa.array(pair % many)), pa.array(times.astype(np.int64))], [*keep, "dl", "term", "tf"])


def corpus_stats(facts: DataFrame, on: Sequence[str] = SCOPE) -> DataFrame:
    """Number of facts and mean length per scope."""
    sizes = facts.select(*on, F.size(search_terms(F.col("content"))).alias("_dl"))
    return sizes.groupBy(*on).agg(F.count(F.lit(1)).alias("n_facts"),
                                  F.avg("_dl").alias("avg_dl"))


def query_terms(queries: DataFrame, on: Sequence[str] = SCOPE) -> DataFrame:
    return queries.select(
        *on, "query_id",
        F.explode(F.array_distinct(search_terms(F.col("query")))).alias("term"))


def matching_postings(facts: DataFrame, terms: DataFrame, on: Sequence[str] = SCOPE) -> DataFrame:
    """Postings of the queried terms only, cut down before they are counted."""
    docs = facts.select(*on, "fact_id", search_terms(F.col("content")).alias("_terms"))
    words = docs.select(*on, "fact_id", F.size("_terms").cast("long").alias("dl"),
                        F.explode("_terms").alias("term"))
    # a hot term is on the left of a semi join, which AQE splits by itself
    hits = words.join(terms.select(*on, "term").distinct(), [*on, "term"], "left_semi")
    return hits.groupBy(*on, "fact_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_weight(tf: Column, dl: Column, df: Column, n: Column, avg_dl: Column) -> Column:
    return idf(df, n) * bm25_saturation(tf, dl, avg_dl)


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_saturation(tf: Column, dl: Column, avg_dl: Column) -> Column:
    """Weight of a term in a fact without its rarity; at most ``k1 + 1``."""
    k1, b = F.lit(fv.BM25_K1), fv.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (F.lit(1 - b) + F.lit(b) * dl / avg_dl))


def bm25(terms: DataFrame, hits: DataFrame, stats: DataFrame, k: int,
         on: Sequence[str] = SCOPE, match_all: bool = False) -> DataFrame:
    """Best ``k`` facts per query: ``query_id, fact_id, raw_score, keyword_score, position``.

    ``keyword_score`` is the raw score over the query's maximum.  Term weights are
    joined to the (small) query side, so the postings are joined once.
    """
    # counting through tf keeps the column, so both reads of hits are one exchange
    frequency = hits.groupBy(*on, "term").agg(
        F.sum(F.least(F.col("tf"), F.lit(1))).alias("df"))
    weighted = terms.join(frequency, [*on, "term"]).join(stats, list(on))
    scored = salted_join(hits, weighted, [*on, "term"], "fact_id").select(
        "query_id", "fact_id",
        bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_facts"),
                    F.col("avg_dl")).alias("_weight"))
    totals = scored.groupBy("query_id", "fact_id").agg(
        F.round(F.sum("_weight"), TIE_DIGITS).alias("raw_score"),
        F.count(F.lit(1)).alias("_matched"))
    if match_all:
        asked = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_asked"))
        totals = totals.join(asked, "query_id").where(F.col("_matched") == F.col("_asked"))
    best = top_k(totals.select("query_id", "fact_id", "raw_score"), ["query_id"],
                 [F.col("raw_score").desc(), F.col("fact_id")], k, rank="position")
    return best.withColumn("keyword_score", normalized(F.col("raw_score"), ["query_id"]))


def normalized(score: Column, keys: Sequence[str]) -> Column:
    """Score over the group's maximum; 0 where the maximum is not positive."""
    top = F.max(score).over(Window.partitionBy(*keys))
    return F.when(top > 0, score / top).otherwise(F.lit(0.0))


def keyword_search(queries: DataFrame, facts: DataFrame, k: int = fv.DEFAULT_LIMIT,
                   as_of: Column | None = None, only_searchable: bool = False,
                   match_all: bool = False) -> DataFrame:
    """BM25 search of valid facts; corpus statistics are those of the searched scope."""
    rows = facts.where(valid_at(as_of))
    if only_searchable:
        rows = rows.where(searchable())
    # written once: small, and known to be small, so neither texts nor their words are shuffled to meet them
    asked_scopes = stored(queries.select(*SCOPE).distinct(), "asked-scopes")
    rows = rows.join(asked_scopes, list(SCOPE), "left_semi")
    terms = stored(query_terms(queries), "asked-terms")
    return bm25(terms, matching_postings(rows, terms), corpus_stats(rows), k,
                match_all=match_all)


def compound_search(queries: DataFrame, facts: DataFrame, k: int,
                    min_similarity: float = fv.COMPOUND_MIN_SIMILARITY,
                    as_of: Column | None = None) -> DataFrame:
    """Vector and keyword candidates as one stream with their source."""
    from mnemoframe.operators.vector_search import vector_search

    near = vector_search(queries, facts, k, min_similarity, as_of, only_searchable=True)
    worded = keyword_search(queries, facts, k, as_of, only_searchable=True)
    return near.select(
        "query_id", "fact_id", F.lit("vector").alias("source"),
        F.col("similarity").alias("score"), "position",
    ).unionByName(worded.select(
        "query_id", "fact_id", F.lit("keyword").alias("source"),
        F.col("keyword_score").alias("score"), "position"))

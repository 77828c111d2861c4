"""From candidate streams to a ranked, deduplicated, enriched answer.

Everything here runs after the per-signal top-k, on a few hundred rows per query.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.functions import dates, fixed_values as fv, scoring, vectors
from mnemoframe.operators.grouping import salted_join, top_k
from mnemoframe.operators.lookups import json_field
from mnemoframe.operators.vector_search import TIE_DIGITS

STREAMS = ("vector", "keyword", "graph", "trigger")
RETRIEVED = ("vector", "keyword", "graph")


def stream(rows: DataFrame, source: str, score: str | None,
           triggered_by: Column | None = None, position: Column | None = None) -> DataFrame:
    """One signal's rows in the common candidate layout."""
    signal = {"trigger": "vector"}.get(source, source)
    return rows.select(
        "query_id", "fact_id", F.lit(source).alias("source"),
        F.lit(STREAMS.index(source)).alias("stream"),
        (F.col("position") if position is None else position).cast("long").alias("position"),
        *[(F.col(score) if s == signal and score else F.lit(0.0)).cast("double")
          .alias(f"{s}_score") for s in RETRIEVED],
        (F.lit(None).cast("string") if triggered_by is None else triggered_by)
        .alias("triggered_by"))


def concat_streams(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def rerank_streams(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Blend vector and graph scores with query similarity before fusion.

    However many candidates there are: a fact's score does not depend on the others'.  Facts
    without a vector keep their score.  Keyword and trigger rows pass through.  Candidates
    carry their ``embedding``.
    """
    is_ranked = F.col("source").isin("vector", "graph")
    asked = queries.select("query_id", vectors.doubles(F.col("embedding")).alias("_query"))
    joined = candidates.join(asked, "query_id", "left")
    similarity = F.round(vectors.cosine(F.col("embedding"), F.col("_query")), TIE_DIGITS)
    applies = is_ranked & F.col("embedding").isNotNull() & F.col("_query").isNotNull()
    blended = {
        f"{s}_score": F.when(applies & (F.col("source") == s), F.round(
            scoring.blended(F.col(f"{s}_score"), similarity), TIE_DIGITS))
        .otherwise(F.col(f"{s}_score")) for s in ("vector", "graph")}
    ordered = joined.withColumns(blended).drop("_query", "embedding")
    strength = F.greatest("vector_score", "graph_score")
    new_position = F.row_number().over(
        Window.partitionBy("query_id", "source").orderBy(
            F.when(is_ranked, -strength), "position", "fact_id"))
    return ordered.withColumn("position", F.when(is_ranked, new_position).otherwise(
        F.col("position")).cast("long"))


def merge_candidates(candidates: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per (query, fact): best score per signal, first source, last trigger.

    ``carry`` names fact columns that ride along unchanged.
    """
    order = F.struct("stream", "position")
    last = F.struct("stream", "position", "triggered_by")
    merged = candidates.groupBy("query_id", "fact_id").agg(
        *[F.max(f"{s}_score").alias(f"{s}_score") for s in RETRIEVED],
        F.min_by("source", order).alias("source"),
        F.max_by("triggered_by", F.when(F.col("triggered_by").isNotNull(), last))
        .alias("triggered_by"),
        F.min(order).alias("first_seen"),
        *([F.any_value(F.struct(*carry)).alias("_fact")] if carry else []))
    return merged.select(*[c for c in merged.columns if c != "_fact"],
                         *([F.col("_fact.*")] if carry else []))


FACT_FIELDS = (
    "lineage_id", "version", "importance", "frequency", "last_accessed", "created_at",
    "valid_from", "event_date", "document_date", "contradiction_status", "contradicts_id",
    "metadata", "content", "source_chunk",
)


def with_fact_fields(rows: DataFrame, facts: DataFrame, fields=FACT_FIELDS) -> DataFrame:
    """Fact columns for a few rows: other facts go before their texts and vectors are moved."""
    wanted = facts.join(rows.select("fact_id"), "fact_id", "left_semi")
    return rows.join(wanted.select("fact_id", *fields), "fact_id")


def score_time(rows: DataFrame, references: DataFrame, now: Column) -> DataFrame:
    """Add ``temporal_score`` from each query's time reference (0 without one).

    A pure first/last question scores by event order; any other reference by
    distance to the date meant, over the largest distance among the candidates.
    Candidates without a date score 0.
    """
    joined = rows.join(references.select("query_id", "time_ref"), "query_id", "left")
    ref = F.col("time_ref")
    ordering = dates.is_ordering_only(ref)
    per_query = Window.partitionBy("query_id")
    dated = F.col("event_date").isNotNull()
    epoch = F.unix_micros("event_date")
    signed = F.when(ref["ordering"] == "first", epoch).otherwise(-epoch)
    rank = F.row_number().over(
        per_query.orderBy(F.when(dated, 0).otherwise(1), signed, F.col("fact_id")))
    total = F.sum(dated.cast("int")).over(per_query)
    by_order = F.when(dated, 1.0 - (rank - 1) / total).otherwise(F.lit(0.0))
    when = F.coalesce("event_date", "document_date")
    meant = F.unix_micros(dates.reference_date(ref, now).cast("timestamp"))
    gap = F.abs(F.unix_micros(when) - meant).cast("double")
    joined = joined.withColumn("_gap", F.when(dates.names_date(ref), gap))
    widest = F.max("_gap").over(per_query)
    near = F.when((widest > 0) & F.col("_gap").isNotNull(), 1.0 - F.col("_gap") / widest)
    score = F.when(F.coalesce(ordering, F.lit(False)), by_order).otherwise(
        F.coalesce(near, F.lit(0.0)))
    return joined.withColumn("temporal_score", score).drop("_gap", "time_ref")


def score_memory(rows: DataFrame, now: Column, half_life_days: float = fv.HALF_LIFE_DAYS,
                 norm_k: float = fv.FREQUENCY_NORM) -> DataFrame:
    return rows.withColumns({
        "recency_score": scoring.recency(
            F.col("last_accessed"), F.col("created_at"), now, half_life_days),
        "salience_score": scoring.salience(F.col("importance"), F.col("frequency"), norm_k),
    })


def fuse(rows: DataFrame, limit: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted sum of the six signals, best ``limit`` per query, ties by first seen."""
    scored = rows.withColumn("score", F.round(scoring.fused_score(weights), TIE_DIGITS))
    return top_k(scored, ["query_id"],
                 [F.col("score").desc(), F.col("first_seen"), F.col("fact_id")], limit,
                 rank="rank")


def newest_per_lineage(rows: DataFrame) -> DataFrame:
    """Keep the newest version of each lineage; facts without a lineage all stay."""
    newest = F.row_number().over(Window.partitionBy("query_id", "lineage_id").orderBy(
        F.col("created_at").desc(), F.col("rank")))
    return rows.withColumn("_n", newest).where(
        F.col("lineage_id").isNull() | (F.col("_n") == 1)).drop("_n")


def drop_updated(rows: DataFrame) -> DataFrame:
    """Drop a fact that another result of the same query says it updates."""
    updated = F.when(json_field("metadata", "relationType") == "updates",
                     json_field("metadata", "relatedFactId"))
    per_query = F.collect_set(updated).over(Window.partitionBy("query_id"))
    return rows.withColumn("_updated", per_query).where(
        ~F.array_contains("_updated", F.col("fact_id").cast("string"))).drop("_updated")


def token_budget(rows: DataFrame, budget: int, keep_first: bool = False,
                 order: str = "rank", text: Column | None = None) -> DataFrame:
    """Best results whose running token estimate stays within the budget.

    The running sum only grows, so keeping rows up to the budget is the same as
    stopping at the first overflow.
    """
    cost = scoring.token_estimate(F.col("content") if text is None else text)
    if text is None:
        cost = cost + F.coalesce(scoring.token_estimate(F.col("source_chunk")), F.lit(0))
    running = F.sum(cost).over(Window.partitionBy("query_id").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    fits = running <= budget
    if keep_first:
        fits = fits | (F.row_number().over(
            Window.partitionBy("query_id").orderBy(order)) == 1)
    return rows.withColumns({"tokens": running, "_fits": fits}).where("_fits").drop("_fits")


def surface_contradictions(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the contradicted fact and how long it stood; absent when it is gone."""
    wanted = F.when(F.col("contradiction_status") != "none", F.col("contradicts_id"))
    named = rows.select(wanted.alias("fact_id"))
    old = facts.join(named, "fact_id", "left_semi").select(
        F.col("fact_id").alias("contradicted_fact_id"), F.col("content").alias("contradicted_content"),
        F.col("valid_from").alias("_old_from"))
    joined = rows.withColumn("_wanted", wanted).join(
        old, F.col("_wanted") == F.col("contradicted_fact_id"), "left")
    text = F.when(F.col("contradicted_fact_id").isNotNull(),
                  dates.timeline(F.col("_old_from"), F.col("valid_from")))
    return joined.withColumn("timeline", text).drop("_wanted", "_old_from")


def history(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Other versions of each result, one row each."""
    versions = facts.select("lineage_id", F.col("fact_id").alias("version_fact_id"),
                            F.col("version").alias("history_version"),
                            F.col("valid_from").alias("history_valid_from"))
    wanted = rows.select("query_id", "fact_id", "lineage_id")
    versions = versions.join(wanted.select("lineage_id"), "lineage_id", "left_semi")
    return salted_join(versions, wanted, ["lineage_id"], "version_fact_id").where(
        F.col("version_fact_id") != F.col("fact_id"))


def graph_context(rows: DataFrame, links: DataFrame, entities: DataFrame,
                  edges: DataFrame, salts: int = 8) -> DataFrame:
    """Entities of each result and their edges, one row per edge.

    Edges are salted, so a hub's are read by several tasks.  Each entity also has a
    row without an edge where its first salt holds none.
    """
    named = rows.select("query_id", "fact_id").join(
        links.select("fact_id", "entity_id"), "fact_id").join(
        entities.select("tenant_id", "entity_id", "canonical_name"), "entity_id").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ends = F.array_distinct(F.array("source_id", "target_id"))
    touching = edges.select("tenant_id", F.explode(ends).alias("entity_id"), "edge_id",
                            "relation").withColumn(
        "_salt", F.pmod(F.xxhash64("edge_id"), F.lit(salts)).cast("int"))
    joined = named.join(touching, ["tenant_id", "entity_id", "_salt"], "left")
    return joined.where(F.col("edge_id").isNotNull() | (F.col("_salt") == 0)).drop("_salt")

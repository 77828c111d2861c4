"""Table maintenance as rewrites: every function returns the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions import scoring
from mnemoframe.operators.grouping import first_per_key

FACT_DEFAULTS = {
    "version": 1, "frequency": 1, "decay_score": 1.0,
    "importance": 0.5, "confidence": 0.8, "contradiction_status": "none",
    "metadata": "{}",
}


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill null or absent columns with their default."""
    return rows.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value)
        for name, value in defaults.items()})


def new_facts(rows: DataFrame, now: Column) -> DataFrame:
    """Rows ready to append: defaults set, valid and created from now on."""
    filled = with_defaults(rows, FACT_DEFAULTS)
    stamps = {name: F.coalesce(F.col(name), now) if name in rows.columns else now
              for name in ("created_at", "valid_from", "last_accessed")}
    return filled.withColumns(stamps)


def new_edges(rows: DataFrame) -> DataFrame:
    return with_defaults(rows, {"weight": 1.0, "confidence": 0.8})


def invalidate(facts: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Soft delete: close the listed facts that are still open."""
    hit = keys.select("fact_id").distinct().withColumn("_hit", F.lit(True))
    closed = F.when(F.col("_hit") & F.col("valid_until").isNull(), now).otherwise(
        F.col("valid_until"))
    return (facts.join(hit, "fact_id", "left").withColumn("valid_until", closed)
            .drop("_hit"))


def edit_facts(facts: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Edit by versioning: close the old row and append its successor.

    ``edits`` holds ``fact_id, new_fact_id, new_content``; columns not edited are
    carried over to the new version.
    """
    edits = edits.select("fact_id", "new_fact_id", "new_content")
    old = facts.join(edits, "fact_id")
    successors = old.withColumns({
        "fact_id": F.col("new_fact_id"),
        "content": F.coalesce("new_content", "content"),
        "version": F.col("version") + 1,
        "valid_from": now, "valid_until": F.lit(None).cast("timestamp"), "created_at": now,
    }).select(*facts.columns)
    return invalidate(facts, edits, now).select(*facts.columns).unionByName(successors)


def purge_scope(tables: dict[str, DataFrame], scopes: DataFrame) -> dict[str, DataFrame]:
    """Hard delete of scopes with cascade to links, edges and extractions."""
    keys = ["tenant_id", "scope", "scope_id"]
    gone = tables["facts"].join(scopes.select(*keys).distinct(), keys, "left_semi").select(
        "fact_id", "extraction_id")
    fact_ids = gone.select("fact_id")
    return {
        "facts": tables["facts"].join(scopes.select(*keys), keys, "left_anti"),
        "fact_entities": tables["fact_entities"].join(fact_ids, "fact_id", "left_anti"),
        "edges": tables["edges"].join(fact_ids, "fact_id", "left_anti"),
        "extractions": tables["extractions"].join(scopes.select(*keys), keys, "left_anti"),
    }


def update_fields(rows: DataFrame, updates: DataFrame, key: str, *fields: str) -> DataFrame:
    """Keyed update; a null in the update keeps the old value."""
    renamed = updates.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    merged = rows.join(renamed, key, "left")
    return merged.withColumns(
        {f: F.coalesce(f"_new_{f}", f) for f in fields}).select(*rows.columns)


def insert_ignore(rows: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Append rows whose key is not there yet, each key once."""
    return rows.unionByName(only_new(rows, incoming, *keys))


def only_new(rows: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows whose key is not there yet, each key once.

    Of several rows of a key the least in the order of their other columns stays, so
    that a repeated run chooses the same.
    """
    others = sorted(c for c in incoming.columns if c not in keys) or list(keys)
    once = first_per_key(incoming, list(keys), [F.col(c).asc_nulls_last() for c in others])
    return once.join(rows.select(*keys), list(keys), "left_anti")


def month_counters(existing: DataFrame, events: DataFrame, ts: str,
                   counters: tuple[str, ...]) -> DataFrame:
    """Additive upsert of per-tenant month counters."""
    month = F.date_trunc("month", F.col(ts)).alias("period_start")
    delta = events.groupBy("tenant_id", month).agg(*[F.sum(c).alias(c) for c in counters])
    both = existing.select("tenant_id", "period_start", *counters).unionByName(delta)
    return both.groupBy("tenant_id", "period_start").agg(
        *[F.sum(c).alias(c) for c in counters])


def count_fired(triggers: DataFrame, matches: DataFrame) -> DataFrame:
    """Add the number of matches of this run to each trigger's counter."""
    fired = matches.groupBy("trigger_id").agg(F.count(F.lit(1)).alias("_fired"))
    return (triggers.join(fired, "trigger_id", "left")
            .withColumn("times_fired",
                        F.col("times_fired") + F.coalesce("_fired", F.lit(0)))
            .drop("_fired"))


def latest_access(accesses: DataFrame) -> DataFrame:
    """Most recent access row of each fact."""
    return first_per_key(accesses, ["fact_id"],
                         [F.col("accessed_at").desc(), F.col("access_id").desc()])


def feedback_on_latest(accesses: DataFrame, feedback: DataFrame) -> DataFrame:
    """Write feedback onto the most recent access row of the fact only."""
    target = latest_access(accesses).select("access_id", "fact_id")
    marked = target.join(feedback.select(
        "fact_id", F.col("was_useful").alias("_useful"),
        F.col("feedback_type").alias("_type")), "fact_id").drop("fact_id")
    return (accesses.join(marked, "access_id", "left").withColumns({
        "was_useful": F.coalesce("_useful", "was_useful"),
        "feedback_type": F.coalesce("_type", "feedback_type"),
        "was_corrected": F.coalesce(F.col("_type") == "correction", F.lit(False)),
    }).drop("_useful", "_type"))


def mark_extracted(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Set the extraction id of processed messages (``session_id, turn_number``)."""
    keys = ["session_id", "turn_number"]
    marks = done.select(*keys, F.col("extraction_id").alias("_done"))
    return messages.join(marks, keys, "left").withColumn(
        "extraction_id", F.coalesce("_done", "extraction_id")).drop("_done")


def apply_feedback(facts: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """New importance and decay score of facts that got one feedback event each."""
    joined = facts.join(feedback.select("fact_id", "feedback_type"), "fact_id")
    changed = joined.withColumn(
        "new_importance", scoring.adjusted_importance(F.col("importance"), F.col("feedback_type")))
    return changed.withColumn("new_decay_score", scoring.decay(
        F.col("new_importance"), F.col("frequency"),
        F.coalesce("last_accessed", now), now))


def access_decay(facts: DataFrame, accessed: DataFrame, now: Column) -> DataFrame:
    """Frequency and decay after recording accesses (``fact_id``, one row per access)."""
    return decay_after(facts, access_hits(accessed), now)


def access_hits(accessed: DataFrame) -> DataFrame:
    """``fact_id, hits`` of accesses, one row each."""
    return accessed.groupBy("fact_id").agg(F.count(F.lit(1)).alias("hits"))


def decay_after(facts: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Frequency and decay of facts after all rows ``fact_id, hits`` of a log of accesses."""
    total = hits.groupBy("fact_id").agg(F.sum("hits").alias("_hits"))
    touched = facts.join(total, "fact_id").withColumn(
        "new_frequency", F.col("frequency") + F.col("_hits"))
    return touched.withColumn("new_decay_score", scoring.decay(
        F.col("importance"), F.col("new_frequency"), now, now)).drop("_hits")


def lifecycle(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Latest status of each extraction job from its status events."""
    return first_per_key(
        ledger.select("extraction_id").join(events, "extraction_id"), ["extraction_id"],
        [F.col("changed_at").desc(), F.col("status_order").desc()])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

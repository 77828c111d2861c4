"""Periodic jobs over the whole fact table, and the scratchpad."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions import fixed_values as fv
from mnemoframe.functions.dates import event_date_text
from mnemoframe.functions.text import reembedding_text
from mnemoframe.operators.linking import cross_links
from mnemoframe.operators.lookups import SCOPE, valid_at


def backfill_event_dates(facts: DataFrame) -> DataFrame:
    """Fill missing event dates from the text; an impossible date stays missing."""
    found = F.try_to_timestamp(event_date_text(F.col("content")), F.lit("yyyy-MM-dd"))
    return facts.withColumn("event_date", F.coalesce("event_date", found))


def reembed(facts: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    text = reembedding_text(F.col("content"), F.col("source_chunk"))
    return facts.withColumn("embedding", embed(text))


def backfill_cross_links(facts: DataFrame, links: DataFrame, entities: DataFrame,
                         since: Column) -> DataFrame:
    """Cross links of the open facts created since a point in time."""
    return cross_links(facts.where(valid_at() & (F.col("created_at") >= since)), facts, links,
                       entities)


def scratchpads(facts: DataFrame, additions: DataFrame,
                cap: int = fv.SCRATCHPAD_CHARS) -> DataFrame:
    """Scratchpad of each scope with its new lines appended.

    ``additions`` has one row per scope (``new_text``).  ``needs_compression`` marks a
    pad over the size limit; shortening it takes a model and is left to the caller.
    """
    pads = facts.where(valid_at() & F.array_contains("tags", "scratchpad"))
    current = pads.groupBy(*SCOPE).agg(
        F.max_by("content", F.struct("created_at", "fact_id")).alias("_pad"))
    merged = additions.join(current, list(SCOPE), "left").withColumn(
        "content", F.concat_ws("\n", "_pad", "new_text"))
    return merged.withColumn("needs_compression", F.length("content") > cap).drop("_pad")


def session_summaries(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """What an ended session left behind: its fact count and best fact."""
    made = facts.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("facts"),
        F.max_by("fact_id", F.struct("importance", "created_at", "fact_id")).alias("top_fact_id"))
    return sessions.where(F.col("ended_at").isNotNull()).join(made, "session_id", "left").withColumn(
        "facts", F.coalesce("facts", F.lit(0)))

"""User profiles, feedback and recall views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.functions.scoring import days_between
from mnemoframe.functions.text import priority_label, profile_category
from mnemoframe.operators.grouping import first_per_key, top_k
from mnemoframe.operators.lookups import SCOPE, json_field, not_dismissed, valid_at, with_priority

STATIC_IMPORTANCE = 0.7
STATIC_DAYS = 7


def user_profiles(facts: DataFrame, now: Column) -> DataFrame:
    """Stable and changing facts of every user, from all that are valid.

    ``part`` is static for important facts older than a week, else dynamic; static
    facts are placed by importance, dynamic ones by recency.
    """
    shown = facts.where((F.col("scope") == "user") & valid_at()).withColumn(
        "last_updated", F.max("created_at").over(Window.partitionBy(*SCOPE))).where(
        ~F.array_contains("tags", "raw_chunk"))
    static = (F.col("importance") >= STATIC_IMPORTANCE) & (
        days_between(now, F.col("valid_from")) > STATIC_DAYS)
    parts = shown.withColumns({
        "part": F.when(static, "static").otherwise("dynamic"),
        "category": profile_category(F.col("content"))})
    order = [F.when(F.col("part") == "static", -F.col("importance")).otherwise(
        -F.unix_micros("valid_from")), F.col("created_at").desc(), F.col("fact_id").desc()]
    return parts.withColumn("position", F.row_number().over(
        Window.partitionBy(*SCOPE, "part").orderBy(*order)))


def greeting_facts(facts: DataFrame, items: int = 15, max_chars: int = 150,
                   min_importance: float = 0.6, about: str | None = None) -> DataFrame:
    """Facts to open a session with: most important first, equal texts once, short ones only."""
    rows = facts.where(valid_at() & (F.col("scope") == "user"))
    rows = (rows.where(F.col("content").ilike(f"%{about}%")) if about
            else rows.where(F.col("importance") >= min_importance))
    best = [F.col("importance").desc(), F.col("created_at").desc(), F.col("fact_id")]
    short = rows.where(F.length("content") <= max_chars).withColumn(
        "_text", F.xxhash64(*SCOPE, F.lower(F.trim("content"))))
    once = first_per_key(short, [*SCOPE, "_text"], best)
    return top_k(once, SCOPE, best, items, rank="rank").drop("_text")


def priority_labels(facts: DataFrame) -> DataFrame:
    """``tenant_id, fact_id, priority_order, label`` of facts that are priorities."""
    rows = with_priority(facts).select(
        "tenant_id", "fact_id", "content",
        json_field("metadata", "priority_order").cast("int").alias("priority_order"))
    return rows.where(F.col("priority_order") != 0).select(
        "tenant_id", "fact_id", "priority_order", F.concat(
            F.lit("Priority #"), F.col("priority_order").cast("string"), F.lit(" ("),
            priority_label(F.col("content")), F.lit(")")).alias("label"))


def dependencies(edges: DataFrame, labels: DataFrame,
                 shown: DataFrame | None = None) -> DataFrame:
    """What each fact blocks, is blocked by and is due, one row per statement.

    ``kind`` is blocks, blocked_by or deadline.  Deadlines pass on once: to a fact
    without one that precedes a dated fact, then to one that blocks a dated
    priority.  Only edges that touch a shown fact or a priority count.
    """
    id_type = labels.schema["fact_id"].dataType
    ends = edges.where(F.col("relation").isin("precedes", "depends_on", "deadline")).select(
        "tenant_id", "relation",
        json_field("metadata", "sourceFactId").cast(id_type).alias("source"),
        json_field("metadata", "targetFactId").cast(id_type).alias("target"),
        json_field("metadata", "deadline").alias("deadline"))
    touched = labels.select("tenant_id", "fact_id")
    if shown is not None:
        touched = touched.unionByName(shown.select("tenant_id", "fact_id"))
    touched = touched.distinct()
    source = touched.select("tenant_id", F.col("fact_id").alias("source"),
                            F.lit(True).alias("_s"))
    target = touched.select("tenant_id", F.col("fact_id").alias("target"),
                            F.lit(True).alias("_t"))
    ends = ends.join(source, ["tenant_id", "source"], "left").join(
        target, ["tenant_id", "target"], "left").where(
        F.coalesce("_s", F.lit(False)) | F.coalesce("_t", F.lit(False)))

    paired = ends.where(F.col("relation").isin("precedes", "depends_on")
                        & F.col("target").isNotNull())
    first = F.when(F.col("relation") == "precedes", F.col("source")).otherwise(F.col("target"))
    second = F.when(F.col("relation") == "precedes", F.col("target")).otherwise(F.col("source"))
    ordered = paired.select("tenant_id", "relation", first.alias("first"), second.alias("second"))
    stated = ordered.select("tenant_id", F.inline(F.array(
        F.struct(F.col("first").alias("fact_id"), F.lit("blocks").alias("kind"),
                 F.col("second").alias("other")),
        F.struct(F.col("second").alias("fact_id"), F.lit("blocked_by").alias("kind"),
                 F.col("first").alias("other")))))
    names = labels.select("tenant_id", F.col("fact_id").alias("other"), "label")
    stated = stated.join(names, ["tenant_id", "other"], "left").select(
        "tenant_id", "fact_id", "kind",
        F.coalesce("label", F.lit("another priority")).alias("value")).distinct()

    due = ends.where((F.col("relation") == "deadline") & (F.col("deadline") != "")).select(
        "tenant_id", F.col("source").alias("fact_id"), F.col("deadline").alias("value")).distinct()
    dated = due.select("tenant_id", "fact_id").distinct()
    plain = due.where(~F.contains("value", F.lit("cascaded")))
    passed = (ordered.where(F.col("relation") == "precedes")
              .join(plain.withColumnRenamed("fact_id", "second"), ["tenant_id", "second"])
              .withColumnRenamed("first", "fact_id")
              .join(dated, ["tenant_id", "fact_id"], "left_anti")
              .select("tenant_id", "fact_id",
                      F.concat("value", F.lit(" (cascaded)")).alias("value")).distinct())
    all_dated = dated.unionByName(passed.select("tenant_id", "fact_id").distinct())
    labelled = labels.join(plain.where(~F.contains("value", F.lit("implicit"))),
                           ["tenant_id", "fact_id"]).select(
        "tenant_id", "label", F.col("value").alias("_due"))
    implied = (stated.where(F.col("kind") == "blocks").withColumnRenamed("value", "label")
               .join(labelled, ["tenant_id", "label"])
               .join(all_dated, ["tenant_id", "fact_id"], "left_anti")
               .select("tenant_id", "fact_id", F.concat(
                   "_due", F.lit(" (implicit — blocks deadline item)")).alias("value")).distinct())
    deadlines = due.unionByName(passed).unionByName(implied).select(
        "tenant_id", "fact_id", F.lit("deadline").alias("kind"), "value")
    return stated.unionByName(deadlines)


def recalled(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Search results plus the tenant's priorities they miss, with text and metadata.

    ``results`` holds ``query_id, tenant_id, fact_id, score``; an added priority
    scores 0.1.
    """
    labels = priority_labels(facts).select("tenant_id", "fact_id", "priority_order")
    asked = results.select("query_id", "tenant_id").distinct()
    missing = asked.join(labels, "tenant_id").join(
        results.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti").select(
        "query_id", "tenant_id", "fact_id", F.lit(0.1).alias("score"))
    both = results.select("query_id", "tenant_id", "fact_id", "score").unionByName(missing)
    return both.join(labels, ["tenant_id", "fact_id"], "left").join(
        facts.select("fact_id", "content", "metadata"), "fact_id")


def place_recalled(rows: DataFrame) -> DataFrame:
    """Priorities by their order, then memories by score; dismissed facts are hidden."""
    order = [F.col("priority_order").isNull(), F.col("priority_order"), F.col("score").desc(),
             F.col("fact_id")]
    return rows.where(not_dismissed()).withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(*order)))

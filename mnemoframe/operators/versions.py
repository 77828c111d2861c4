"""Valid-time intervals of versioned facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mnemoframe.operators.grouping import in_ranges


def as_of_join(probes: DataFrame, versions: DataFrame, keys: list[str], at: str,
               row_id: str = "fact_id") -> DataFrame:
    """The version valid at each probe's time: start included, end not.

    Versions of a lineage follow one another, so the candidate is the last one
    started.  It is carried forward inside (lineage, range of rows) and from the
    previous ranges' last versions, so neither pairs of a lineage nor a whole lineage
    ever meet in one task, even where all its rows have one time.
    """
    version = F.struct(*[F.col(c) for c in versions.columns if c not in keys])
    probe = F.struct(*[F.col(c) for c in probes.columns if c not in keys])
    starts = versions.select(*keys, F.col("valid_from").alias("_ts"), F.lit(0).alias("_kind"),
                             F.col(row_id).alias("_tie"), version.alias("_version"))
    asked = probes.select(*keys, F.col(at).alias("_ts"), F.lit(1).alias("_kind"),
                          probe.alias("_probe"))
    line = starts.unionByName(asked, allowMissingColumns=True).withColumn("_spread", F.xxhash64("_probe"))
    line = in_ranges(line, keys, ["_ts", "_kind", "_tie", "_spread"], "_bucket")
    ends = line.groupBy(*keys, "_bucket").agg(F.max_by("_version", F.when(
        F.col("_kind") == 0, F.struct("_ts", "_tie"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(
        before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_ts", "_kind", "_tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = line.join(carried, [*keys, "_bucket"]).withColumn("_found", F.coalesce(
        F.last("_version", ignorenulls=True).over(inside), F.col("_carried")))
    hits = found.where((F.col("_kind") == 1) & F.col("_found").isNotNull()).select(
        *keys, "_probe.*", "_found.*")
    return hits.where(F.col("valid_until").isNull() | (F.col("valid_until") > F.col(at)))


def close_versions(rows: DataFrame, keys: list[str], start: str, row_id: str) -> DataFrame:
    """``valid_until`` of each version: the start of the next one in its lineage.

    The next start comes from the same range of rows, or else from the first version
    of the lineage's next range, so no task holds a whole lineage.
    """
    cut = in_ranges(rows, keys, [start, row_id], "_bucket")
    heads = cut.groupBy(*keys, "_bucket").agg(F.min(start).alias("_head"))
    following = F.lead("_head").over(Window.partitionBy(*keys).orderBy("_bucket"))
    heads = heads.select(*keys, "_bucket", following.alias("_next_head"))
    within = F.lead(start).over(
        Window.partitionBy(*keys, "_bucket").orderBy(start, row_id))
    return (cut.join(heads, [*keys, "_bucket"])
            .withColumn("valid_until", F.coalesce(within, F.col("_next_head")))
            .drop("_bucket", "_next_head"))


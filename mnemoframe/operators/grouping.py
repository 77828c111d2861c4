"""Top-k, keyset pages, skew-proof joins and row numbering per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mnemoframe.session import stored


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group in a total order.

    The rank filter makes Catalyst plan a group limit on the map side, so a group
    of any size ships at most ``k`` rows per task into the shuffle.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: str,
                salts: int = 8, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys on the big side spread over ``salts`` tasks.

    The small side is repeated once per salt.  Which side is broadcast, if any,
    is left to Catalyst and its size threshold.
    """
    if salts <= 1:
        return big.join(small, list(on), how)
    salted = big.withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def many_parts(spark: SparkSession) -> int:
    """Partitions for work that is heavy beside its bytes, which would be put together by their size otherwise."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def keyset_page(df: DataFrame, requests: DataFrame, scope_keys: Sequence[str], ts: str,
                row_id: str, newest_first: bool = True) -> DataFrame:
    """One page per request row, with a ``has_more`` flag.

    ``requests`` holds ``page_id``, the scope keys, ``page_limit`` and the cursor
    pair ``cursor_ts``/``cursor_id`` (null for the first page).  One row past the
    limit is probed to learn whether more rows follow.
    """
    pairs = salted_join(df, requests, scope_keys, row_id)
    if newest_first:
        after = (F.col(ts) < F.col("cursor_ts")) | (
            (F.col(ts) == F.col("cursor_ts")) & (F.col(row_id) < F.col("cursor_id")))
        order = [F.col(ts).desc(), F.col(row_id).desc()]
    else:
        after = (F.col(ts) > F.col("cursor_ts")) | (
            (F.col(ts) == F.col("cursor_ts")) & (F.col(row_id) > F.col("cursor_id")))
        order = [F.col(ts).asc(), F.col(row_id).asc()]
    pairs = pairs.where(F.col("cursor_ts").isNull() | after)
    ranked = F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    probed = pairs.withColumn("position", ranked).where(F.col("position") <= F.col("page_limit") + 1)
    more = F.max("position").over(Window.partitionBy("page_id"))
    return (probed.withColumn("has_more", more > F.col("page_limit"))
            .where(F.col("position") <= F.col("page_limit")))


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows dealt out by ranges of (keys, order), the range's number beside them; written once.

    Ranges ascend and hold about as many rows each, so a key of any share spreads over
    them, at one time or at many.  ``order`` should tell any two rows of a key apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], name: str) -> DataFrame:
    """1-based row number per group by time, for groups of unbounded size.

    Rows are numbered inside (group, range of rows) and shifted by the number of rows in
    earlier ranges.  No task ever sorts a whole group: the only window over a group
    runs on its counts by range.
    """
    rows = in_ranges(df, keys, [ts, *ties], "_range")
    sizes = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    local = F.row_number().over(
        Window.partitionBy(*keys, "_range").orderBy(ts, *ties))
    return (rows.join(shifts, [*keys, "_range"])
            .withColumn(name, local + F.col("_shift")).drop("_range", "_shift"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order (distinct by key, first wins)."""
    return top_k(df, keys, order, 1)

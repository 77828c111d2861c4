"""Partitioned tables whose changes write only the partitions they touch.

Rows lie in folders by the table's keys and the commit that wrote them; a commit counts
once its rows in ``commits`` are written, one for each partition it wrote, with its place
in the order of commits and whether it replaces the partition (``whole``) or adds to it.
A reader takes, of each partition, the last whole commit and what was added since: never
half of a change, and no gap while a change is written.  What a failed writer leaves
behind has no commit and is never read.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mnemoframe.session import stored


def join_same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null equals null; of the right side only other columns come along."""
    named = right.select(*[F.col(c).alias(f"_of_{c}") for c in columns], *[c for c in right.columns if c not in columns])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns], F.lit(True))
    return left.join(named, match, how).drop(*[f"_of_{c}" for c in columns])


class PartitionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, tuple(keys)
        self.schema = T.StructType.fromDDL(schema)
        fields = [self.schema[k] for k in keys]
        self._stored = T.StructType([*self.schema.fields, T.StructField("_commit", T.StringType())])
        self._log = T.StructType([*fields, T.StructField("_commit", T.StringType()), T.StructField("_place", T.LongType()),
                                  T.StructField("_whole", T.BooleanType())])

    def create(self) -> None:
        self.spark.createDataFrame([], self._stored).write.mode("ignore").partitionBy(*self.keys, "_commit").parquet(
            f"{self.path}/rows")
        self.spark.createDataFrame([], self._log).write.mode("ignore").parquet(f"{self.path}/commits")

    def commits(self) -> DataFrame:
        return self.spark.read.schema(self._log).parquet(f"{self.path}/commits")

    def live(self) -> DataFrame:
        """``keys, _commit`` of the folders that make up the table."""
        log = self.commits()
        last = log.where("_whole").groupBy(*self.keys).agg(F.max("_place").alias("_last"))
        return join_same(log, last, self.keys, "left").where(
            F.col("_last").isNull() | (F.col("_place") >= F.col("_last"))).select(*self.keys, "_commit")

    def read(self) -> DataFrame:
        """The rows; a filter on the keys reaches the folders."""
        rows = self.spark.read.schema(self._stored).parquet(f"{self.path}/rows")
        return join_same(rows, self.live(), [*self.keys, "_commit"], "left_semi").select(*self.schema.names)

    def append(self, rows: DataFrame) -> None:
        """Add rows; columns they lack are null."""
        self._commit(rows, None)

    def change(self, touched: DataFrame, new_rows: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the touched partitions by what ``new_rows`` makes of their rows.

        ``touched`` holds the keys of the partitions.  Rows that move to other partitions are added there.
        """
        keys = stored(touched.select(*self.keys).distinct(), "touched") if self.keys else None
        now = self.read()
        if keys is not None:
            now = join_same(now, keys, self.keys, "left_semi")
        self._commit(new_rows(now), keys if keys is not None else self.spark.range(1).select())

    def _commit(self, rows: DataFrame, whole: DataFrame | None) -> None:
        name = uuid.uuid4().hex
        place = (self.commits().agg(F.max("_place")).first()[0] or 0) + 1
        held = [c for c in self.schema.names if c in rows.columns]
        aligned = self.spark.createDataFrame([], self.schema).unionByName(rows.select(*held), allowMissingColumns=True)
        if self.keys:  # partitions of any share are split or merged to the advisory size
            aligned = aligned.hint("rebalance", *self.keys)
        aligned.withColumn("_commit", F.lit(name)).write.mode("append").partitionBy(*self.keys, "_commit").parquet(
            f"{self.path}/rows")
        written = self.spark.read.schema(self._stored).parquet(f"{self.path}/rows").where(F.col("_commit") == name).select(
            *self.keys).distinct()
        if whole is None:
            log = written.withColumn("_whole", F.lit(False))
        elif not self.keys:
            log = whole.withColumn("_whole", F.lit(True))
        else:
            log = whole.withColumn("_whole", F.lit(True)).unionByName(
                join_same(written, whole, self.keys, "left_anti").withColumn("_whole", F.lit(False)))
        if whole is None and not self.keys:
            log = self.spark.range(1).select(F.lit(False).alias("_whole"))
        (log.select(*self.keys, F.lit(name).alias("_commit"), F.lit(place).cast("long").alias("_place"), "_whole")
         .coalesce(1).write.mode("append").parquet(f"{self.path}/commits"))

"""The memory tables as one store of partitioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from mnemoframe.schemas import TABLES
from mnemoframe.sources.partitioned import PartitionedTable


class MemoryCatalog:
    """The memory tables of one store; every read is a DataFrame.

    Tables lie by tenant and, where they have one, by scope.
    """

    def __init__(self, spark: SparkSession, name: str, location: str | None = None):
        self.spark = spark
        self.location = location or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"

    def create(self, location: str | None = None) -> None:
        self.location = location or self.location
        for name in TABLES:
            self._table(name).create()

    def _table(self, name: str) -> PartitionedTable:
        columns = T.StructType.fromDDL(TABLES[name]).names
        return PartitionedTable(self.spark, f"{self.location}/{name}", TABLES[name],
                                [c for c in ("tenant_id", "scope") if c in columns])

    def table(self, name: str) -> DataFrame:
        return self._table(name).read()

    def commits(self, name: str) -> DataFrame:
        """Which partitions each commit wrote."""
        return self._table(name).commits()

    def append(self, name: str, rows: DataFrame) -> None:
        """Append rows; columns the rows lack are written as null."""
        self._table(name).append(rows)

    def change(self, name: str, touched: DataFrame, new_rows: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the partitions whose keys ``touched`` holds, and no others."""
        self._table(name).change(touched, new_rows)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Rewrite the whole table."""
        table = self._table(name)
        table.change(table.live(), lambda _: rows)

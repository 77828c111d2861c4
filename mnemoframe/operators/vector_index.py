"""Approximate nearest rows through a stored coarse index: cells, probes, exact scores.

``fit`` learns cell centres on a bounded sample of all rows, ``write`` stores every row
in the cell of its nearest centre, and how many rows of each scope a cell has.  ``search``
reads the cells nearest to each query, at least ``probes`` of those that its scope has rows in and
so many that they hold ``reach`` rows for each one asked, and scores their rows exactly.
A small scope is so searched whole, a large one in part.  With all cells probed the result
is that of the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from mnemoframe.functions import fixed_values as fv
from mnemoframe.operators.grouping import top_k
from mnemoframe.operators.lookups import SCOPE
from mnemoframe.operators.vector_search import similar_pairs

SAMPLE_ROWS = 20_000  # bound of the rows that centres are fitted on
MOST_CELLS = 4096  # so centres of 1024 dimensions take 32 MB
NEAR_VALUES = 1 << 18  # similarities to centres that a task holds at once, whatever the number of cells
_ROUNDS = 8


@dataclass(frozen=True)
class Index:
    """A stored index: the folder of its cells, and their centres."""

    path: str
    centres: np.ndarray
    on: tuple[str, ...]
    row_id: str
    schema: T.StructType

    @property
    def cells(self) -> int:
        return len(self.centres)

    def probes(self) -> int:
        """Cells read for a query unless the caller says how many: five eighths, eight at least.

        So many give nine tenths of the neighbours even where vectors have no clusters; those
        that have some need far fewer.
        """
        return max(8, -(-self.cells * 5 // 8))


REACH = 16  # rows scored for each one asked, at least, while the scope has them


def fit(rows: DataFrame, row_id: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres of the cells, by spherical k-means on the rows whose ids have the least hashes.

    Rows of all keys and partitions are as likely to be in the sample.  The number of cells is
    the square root of the number of rows unless given, ``MOST_CELLS`` at most.
    """
    usable = rows.where(F.size("embedding") > 0)
    size, count = usable.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    wanted = min(MOST_CELLS, cells or max(1, round(count ** 0.5)))
    if not count:
        return np.zeros((1, 1))
    sample = (usable.where(F.size("embedding") == size)
              .orderBy(F.xxhash64(row_id), row_id).limit(min(sample_rows, SAMPLE_ROWS))
              .select(F.col("embedding").cast("array<double>").alias("v")).toArrow())
    matrix = _unit(np.array(sample.column("v").to_pylist(), dtype=np.float64).reshape(len(sample), size))
    matrix = np.unique(np.nan_to_num(matrix), axis=0)
    wanted = min(wanted, len(matrix))
    random = np.random.default_rng(0)
    centres = matrix[random.choice(len(matrix), wanted, replace=False)]
    for _ in range(_ROUNDS):
        of = (matrix @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, matrix)
        empty = np.bincount(of, minlength=wanted) == 0
        sums[empty] = matrix[random.choice(len(matrix), int(empty.sum()))]
        centres = _unit(sums)
    return centres


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _nearest_cells(rows: DataFrame, kept: Sequence[str], centres: np.ndarray, probes: int) -> DataFrame:
    """``kept`` columns with ``cell, nearness``: a row for each of the ``probes`` nearest cells, from 0 on.

    A vector of another length than the centres', or of zeros, is as near to all: it is in
    cell 0, and asks for the first cells.
    """
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("cell", T.IntegerType()),
                           T.StructField("nearness", T.IntegerType())])
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = held.value
        step = max(1, NEAR_VALUES // len(middle))
        for whole in batches:
            for first in range(0, len(whole), step):
                batch = whole.slice(first, step)
                column = batch.column("embedding")
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                ends = np.cumsum(sizes)
                cells = np.tile(np.arange(probes, dtype=np.int32), (len(batch), 1))
                fit_ = np.flatnonzero(sizes == middle.shape[1])
                if len(fit_):
                    near = _unit(flat[(ends[fit_] - middle.shape[1])[:, None] + np.arange(middle.shape[1])]) @ middle.T
                    cells[fit_] = (near.argmax(axis=1)[:, None] if probes == 1  # ties: the first, as in the order
                                   else np.argsort(-near, axis=1, kind="stable")[:, :probes])
                places = pa.array(np.repeat(np.arange(len(batch)), probes))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(places) for c in kept), pa.array(cells.ravel(), pa.int32()),
                     pa.array(np.tile(np.arange(probes, dtype=np.int32), len(batch)))], schema.names)

    return rows.mapInArrow(run, schema)


def write(rows: DataFrame, centres: np.ndarray, path: str, row_id: str = "fact_id",
          on: Sequence[str] = SCOPE, shards: int = 1) -> Index:
    """Store each row with a vector once, by cell; a cell is written by ``shards`` tasks."""
    kept = rows.where(F.col("embedding").isNotNull()).select(*on, row_id, "embedding")
    placed = _nearest_cells(kept, kept.columns, centres, 1).drop("nearness")
    shard = F.pmod(F.xxhash64(row_id), F.lit(shards))
    (placed.repartition("cell", shard).sortWithinPartitions("cell", *on)
     .write.partitionBy("cell").parquet(f"{path}/cells"))
    rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/cells").groupBy(*on, "cell").agg(
        F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/counts")
    told = rows.sparkSession.createDataFrame(
        [(n, c.tolist()) for n, c in enumerate(centres)], "cell int, centre array<double>")
    told.coalesce(1).write.parquet(f"{path}/centres")
    spec = json.dumps({"on": list(on), "row_id": row_id, "cells": placed.schema.jsonValue()})
    rows.sparkSession.createDataFrame([(spec,)], "spec string").coalesce(1).write.text(f"{path}/spec")
    return Index(path, centres, tuple(on), row_id, placed.schema)


def load(spark: SparkSession, path: str) -> Index:
    spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
    return Index(path, np.array([r["centre"] for r in rows]), tuple(spec["on"]), spec["row_id"],
                 T.StructType.fromJson(spec["cells"]))


def search(queries: DataFrame, index: Index, k: int = fv.DEFAULT_LIMIT, probes: int | None = None,
           min_similarity: float = 0.0, reach: int = REACH) -> DataFrame:
    """``query_id, row_id, similarity, position`` among the rows of each query's nearest cells.

    Only probed cells are read: the cells are the folders of the table.  The shape of the result,
    the order of ties and the meaning of the floor are those of the exact search.
    """
    spark = queries.sparkSession
    keys = list(index.on)
    asked = queries.where(F.col("embedding").isNotNull()).select(*keys, "query_id", "embedding")
    # cells without a row of the scope do not count as probed
    ranked = _nearest_cells(asked, [*keys, "query_id"], index.centres, index.cells).join(
        spark.read.parquet(f"{index.path}/counts"), [*keys, "cell"])
    nearer = Window.partitionBy("query_id").orderBy("nearness")
    before = F.coalesce(F.sum("rows").over(nearer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    probed = (ranked.withColumn("_nth", F.row_number().over(nearer)).withColumn("_before", before)
              .where((F.col("_nth") <= (probes or index.probes())) | (F.col("_before") < reach * k))
              .select("query_id", "cell"))
    wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]  # MOST_CELLS at most
    stored = spark.read.schema(index.schema).parquet(f"{index.path}/cells")
    if len(wanted) < index.cells:
        stored = stored.where(F.col("cell").isin(wanted))
    pairs = similar_pairs(asked.join(probed, "query_id"), stored, (*keys, "cell"), index.row_id, min_similarity, k=k)
    return top_k(pairs, ["query_id"], [F.col("similarity").desc(), F.col(index.row_id)], k, rank="position")


def recall(found: DataFrame, exact: DataFrame, row_id: str = "fact_id") -> DataFrame:
    """``query_id, wanted, met``: how many of each query's exact neighbours were found."""
    hits = found.select("query_id", row_id).withColumn("_met", F.lit(1))
    return exact.join(hits, ["query_id", row_id], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("_met").alias("met"))

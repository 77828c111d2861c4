"""Similarities of blocks of vectors: one matrix product of a batch of rows and their queries.

A batch of questions is small beside the stored vectors.  Up to a checked size it travels
to the tasks once, and the stored vectors are read where they lie: no vector is shuffled,
and a task ships at most its best ``k`` rows of a query.  Beyond that size
``vector_blocks`` says so by returning ``None``, and ``vector_cells`` lets blocks of both sides meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mnemoframe.operators.grouping import many_parts

QUERY_ROWS = 16_384
QUERY_BYTES = 64 << 20
_CLOSE = 1e-9  # rows nearer than this to the k-th stay; ranks are given after rounding
_HELD = 1 << 18
CELL_ROWS = 8_192  # of a block
CELL_ROWS_OF_PAIRS = 2_048  # of a block whose pairs may all come
_AT_ONCE = 1 << 20  # similarities of one product


class _Queries:
    """Queries by their keys, with the vectors of each length in one matrix."""

    def __init__(self, table: pa.Table, on: Sequence[str]):
        self.ids = table.column("query_id").combine_chunks()
        keys = list(zip(*(table.column(c).to_pylist() for c in on))) if on else [()] * len(table)
        rows: dict[tuple, dict[int, list[int]]] = {}
        vectors = table.column("embedding").to_pylist()
        for n, (key, vector) in enumerate(zip(keys, vectors)):
            if None not in key:  # an equi-join drops them
                rows.setdefault(key, {}).setdefault(len(vector), []).append(n)
        self.groups = {
            key: [(np.array(of), _unit(np.array([vectors[n] for n in of], dtype=np.float64).reshape(len(of), size)))
                  for size, of in sizes.items()]
            for key, sizes in rows.items()}


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def vector_blocks(queries: DataFrame, rows: DataFrame, on: Sequence[str], row_id: str,
                  min_similarity: float, k: int | None = None) -> DataFrame | None:
    """``query_id, row_id, similarity`` of pairs that share the keys and pass the floor.

    With ``k``, each task keeps what can be among a query's best ``k``.  Vectors of other
    lengths than the query's, empty ones and zeros have similarity 0; rows and queries without a vector, or with a null key,
    pair with nothing.  Not a number never passes.  ``None`` if the queries are too large to travel.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select(
        *on, "query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    taken = asked.limit(QUERY_ROWS + 1).toArrow()
    if len(taken) > QUERY_ROWS or taken.nbytes > QUERY_BYTES:
        return None
    held = rows.sparkSession.sparkContext.broadcast(_Queries(taken, on))
    schema = T.StructType([
        asked.schema["query_id"], rows.schema[row_id], T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(held.value, k, min_similarity - _CLOSE)
        names = schema.names
        for batch in batches:
            for chunk in best.add(batch, on, row_id):
                yield pa.RecordBatch.from_arrays(chunk, names)
        for chunk in best.rest():
            yield pa.RecordBatch.from_arrays(chunk, names)

    return (rows.where(F.col("embedding").isNotNull()).select(*on, row_id, "embedding")
            .mapInArrow(run, schema))


def vector_cells(queries: DataFrame, rows: DataFrame, on: Sequence[str], row_id: str,
                 min_similarity: float, k: int | None = None) -> DataFrame:
    """The pairs of ``vector_blocks`` for any number of queries.

    Queries and rows of a key are dealt into blocks by their measured numbers, and two blocks meet in a
    task's memory: a vector is sent once for each block of the other side, a pair only if it passes.
    """
    size = CELL_ROWS_OF_PAIRS if k is None else CELL_ROWS
    asked = queries.where(F.col("embedding").isNotNull()).select(
        *on, "query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    taken = rows.where(F.col("embedding").isNotNull()).select(*on, F.col(row_id).alias("_row"), "embedding")

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    counts = blocks(asked, "_asks").join(blocks(taken, "_takes"), list(on))
    cell = [*on, "_ask", "_take"]
    parts = many_parts(rows.sparkSession)

    def dealt(side: DataFrame, row: str, mine: tuple[str, str], other: tuple[str, str]):
        own = F.pmod(F.xxhash64(row, "embedding"), F.col(mine[1])).cast("int").alias(mine[0])
        every = F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)).alias(other[0])
        out = side.join(counts, list(on)).select(*side.columns, own, every)
        return out.repartition(parts, *cell).groupBy(*cell)

    schema = T.StructType([
        asked.schema["query_id"], T.StructField(row_id, taken.schema["_row"].dataType), T.StructField("similarity", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(_Queries(left, ()), k, min_similarity - _CLOSE)
        found = [chunk for batch in right.combine_chunks().to_batches(max_chunksize=size // 8) for chunk in best.add(batch, (), "_row")]
        found.extend(best.rest())
        names = schema.names
        none = [left.schema.field("query_id").type, right.schema.field("_row").type, pa.float64()]
        return pa.concat_tables([pa.Table.from_arrays(chunk, names) for chunk in found]
                                or [pa.Table.from_arrays([pa.array([], kind) for kind in none], names)])

    asks, takes = ("_ask", "_asks"), ("_take", "_takes")
    return dealt(asked, "query_id", asks, takes).cogroup(dealt(taken, "_row", takes, asks)).applyInArrow(run, schema)


class Vectors:
    """Vectors of several lengths; a missing one is near to nothing."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        sizes = np.asarray(lists.value_lengths().fill_null(-1))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(np.maximum(sizes, 0))
        self.count = len(sizes)
        self.groups = {}
        for size in np.unique(sizes[sizes >= 0]).tolist():
            of = np.flatnonzero(sizes == size)
            self.groups[size] = of, _unit(flat[(ends[of] - size)[:, None] + np.arange(size)])

    def near(self, other: Vectors, least: float, digits: int) -> np.ndarray:
        """Whether some vector of the other ones is as near as ``least``, after rounding."""
        out = np.zeros(self.count, dtype=bool)
        for size, (of, unit) in self.groups.items():
            for far, (some, others) in other.groups.items():
                if far != size:
                    out[of] |= least <= 0
                    continue
                step = max(1, _AT_ONCE // len(some))
                for first in range(0, len(of), step):
                    with np.errstate(invalid="ignore"):
                        near = unit[first:first + step] @ others.T
                        out[of[first:first + step]] |= (np.round(near, digits) >= least).any(axis=1)
        return out

    def only(self, rows: np.ndarray) -> Vectors:
        some = object.__new__(Vectors)
        some.count, some.groups = self.count, {}
        for size, (of, unit) in self.groups.items():
            kept = rows[of]
            if kept.any():
                some.groups[size] = of[kept], unit[kept]
        return some


class _Best:
    """Pairs found in a task; with ``k``, cut down to each query's best now and then."""

    def __init__(self, queries: _Queries, k: int | None, floor: float):
        self.queries, self.k = queries, k
        self.least = np.full(len(queries.ids), floor)  # what a pair has to reach
        self.number: list[np.ndarray] = []
        self.similarity: list[np.ndarray] = []
        self.row: list[pa.Array] = []
        self.count = 0

    def add(self, batch: pa.RecordBatch, on: Sequence[str], row_id: str) -> Iterator[list]:
        keys = list(zip(*(batch.column(c).to_pylist() for c in on))) if on else [()] * len(batch)
        of: dict[tuple, list[int]] = {}
        for n, key in enumerate(keys):
            of.setdefault(key, []).append(n)
        ids = batch.column(row_id)
        for key, some in of.items():
            groups = self.queries.groups.get(key)
            if not groups:
                continue
            vectors = batch.column("embedding").take(pa.array(some))
            sizes = vectors.value_lengths().to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                of_size = np.flatnonzero(sizes == size)
                for numbers, other in groups:
                    step = max(1, _AT_ONCE // len(numbers))
                    for first in range(0, len(of_size), step):
                        rows = of_size[first:first + step]
                        if other.shape[1] == size:
                            near = _unit(flat[(ends[rows] - size)[:, None] + np.arange(size)]) @ other.T
                        else:
                            near = np.zeros((len(rows), len(numbers)))
                        with np.errstate(invalid="ignore"):
                            at, query = np.nonzero(near >= self.least[numbers])
                        if len(at):
                            self._keep(numbers[query], near[at, query], ids.take(pa.array(np.array(some)[rows[at]])))
                        if self.k is not None and self.count >= _HELD:
                            self._cut()
        if self.count >= _HELD:
            if self.k is None:
                yield from self.rest()
            else:
                self._cut()

    def _keep(self, number: np.ndarray, similarity: np.ndarray, row: pa.Array) -> None:
        self.number.append(number)
        self.similarity.append(similarity)
        self.row.append(row)
        self.count += len(number)

    def _cut(self) -> None:
        number, similarity = np.concatenate(self.number), np.concatenate(self.similarity)
        order = np.lexsort((-similarity, number))
        sorted_numbers = number[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_numbers[1:] != sorted_numbers[:-1])))
        full = np.diff(np.append(first, len(order))) >= self.k
        kth = order[first[full] + self.k - 1]
        self.least[number[kth]] = np.maximum(self.least[number[kth]], similarity[kth] - _CLOSE)
        stay = similarity >= self.least[number]
        row = pa.concat_arrays(self.row).filter(pa.array(stay))
        self.number, self.similarity, self.row, self.count = [], [], [], 0
        self._keep(number[stay], similarity[stay], row)

    def rest(self) -> Iterator[list]:
        if not self.count:
            return
        if self.k is not None:
            self._cut()
        for number, similarity, row in zip(self.number, self.similarity, self.row):
            yield [self.queries.ids.take(pa.array(number)), row, pa.array(similarity, pa.float64())]
        self.number, self.similarity, self.row, self.count = [], [], [], 0

"""Near-duplicate vectors by a subspace pigeonhole join, exact for a cosine threshold.

Unit vectors whose cosine is at least ``c`` lie within a squared distance of 2 - 2c.  A
fixed random rotation spreads that distance, and the rotated vectors are cut into
blocks; in some block the squared distance is at most the block's share by its number
of dimensions.  Each block is range-joined: a vector has a home cell in a grid over the
first dimensions of the block, as wide as the block's radius, and visits those cells
after it in order that its ball reaches.  A pair counts in the first block that is
within its share, so each is verified and counted once; cosines are then taken in
double precision on the given components.

Equal vectors form a class that stands for them.  Cells with many vectors are cut into
chunks, and tasks get pairs of chunks; they return numbers of links and a spanning
forest, never the pairs.  The grid gets more dimensions as the number of vectors grows,
so that cells keep their size.

Vectors that are null, zero, empty or hold null or non-finite components link with
nothing; vectors of different lengths do not link.  Rows with equal ids are taken as one
vector's rows: each gets its own number of links and the component of its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mnemoframe.llm.common import store
from mnemoframe.llm.components import components

BLOCK = 8  # dimensions of a block
CELL = 10_000  # vectors that a cell and those around it should have at most
CHUNK = 8192
_SLACK = 1e-9
_ROTATIONS: dict[int, np.ndarray] = {}


def _rotation(size: int) -> np.ndarray:
    if size not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
        _ROTATIONS[size] = q * np.sign(np.diag(r))
    return _ROTATIONS[size]


def _unit(keys: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(keys), dtype=kind).reshape(len(keys), -1).astype(np.float64)
    # scaled first, so that squares neither vanish nor overflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _kind(vectors: DataFrame, column: str) -> str:
    return "<f4" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "<f8"


def keyed(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows ``id, key``: the bytes of the components, or null where a vector links with nothing."""
    kind = _kind(vectors, vector_column)
    schema = T.StructType([T.StructField("id", vectors.schema[id_column].dataType), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                good = x is not None and len(x) and np.isfinite(x).all() and np.any(x)
                keys.append((x + 0.0).astype(kind).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["id", "key"])

    return vectors.select(id_column, vector_column).mapInArrow(run, schema)


def seats(classes: DataFrame, kind: str, distance: float, grid: int) -> DataFrame:
    """Rows ``id, n, key, block, cell, guest``: the home of each class in each block, and its visits."""
    schema = T.StructType([*classes.select("id", "n", "key").schema.fields, T.StructField("block", T.IntegerType()),
                           T.StructField("cell", T.LongType()), T.StructField("guest", T.IntegerType())])

    def of_vector(spot: np.ndarray, width: float) -> Iterator[tuple[int, int]]:
        """Home cell, and the later cells within one width, by packed coordinates."""
        span = int(2 / width) + 4  # coordinates of unit vectors lie between -1 and 1
        home = np.floor((spot + 1) / width).astype(np.int64) + 1
        inside = (spot + 1) / width - (home - 1)
        pack = 0
        for c in home:
            pack = pack * span + int(c)
        yield pack, 0
        # squared distance to each neighbouring cell is the sum over its dimensions
        reach = [(0.0, 0, 0)]
        for dimension, part in enumerate(inside):
            weight = span ** (len(home) - 1 - dimension)
            reach = [(d + e, p + step * weight, first or step)
                     for d, p, first in reach
                     for step, e in ((-1, part ** 2), (0, 0.0), (1, (1 - part) ** 2)) if d + e <= 1 + 1e-6]
        for _, shift, first in reach:
            if first > 0:
                yield pack + shift, 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                take, blocks, cells, guests = [], [], [], []
                for row, key in enumerate(batch.column("key").to_pylist()):
                    spots = _unit([key], kind)[0]
                    size = len(spots)
                    spots = spots @ _rotation(size)
                    for block, first in enumerate(range(0, size, BLOCK)):
                        part = spots[first:first + BLOCK]
                        width = np.sqrt(distance * len(part) / size)
                        for cell, guest in of_vector(part[:grid], float(width)):
                            take.append(row)
                            blocks.append(block)
                            cells.append(cell)
                            guests.append(guest)
                rows = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("id", "n", "key")), pa.array(blocks, pa.int32()),
                     pa.array(cells, pa.int64()), pa.array(guests, pa.int32())], schema.names)

    return classes.select("id", "n", "key").mapInArrow(run, schema)


def _pairs(x: np.ndarray, y: np.ndarray, cosine: float, distance: float, block: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of x, rows of y) that link and for which this is the first block within its
    share; of a chunk with itself, each pair once."""
    size = x.shape[1]
    turn = _rotation(size)
    firsts = range(0, size, BLOCK)
    shares = np.array([distance * len(turn[k:k + BLOCK]) / size for k in firsts])
    rx, ry = x @ turn, y @ turn
    a, b = (r[:, block * BLOCK:(block + 1) * BLOCK] for r in (rx, ry))
    # one product gives the squared distances within the block
    a = np.column_stack((-2 * a, (a * a).sum(1), np.ones(len(a))))
    b = np.column_stack((b, np.ones(len(b)), (b * b).sum(1))).T
    out = [(np.zeros(0, dtype=np.int64),) * 2]
    for first in range(0, len(x), 64):
        i, j = np.nonzero(a[first:first + 64] @ b <= shares[block] + _SLACK)
        i += first
        if own:
            i, j = i[j > i], j[j > i]
        for at in range(0, len(i), 20_000):
            p, q = i[at:at + 20_000], j[at:at + 20_000]
            alike = (x[p] * y[q]).sum(1) >= cosine
            p, q = p[alike], q[alike]
            within = np.add.reduceat((rx[p] - ry[q]) ** 2, firsts, axis=1) - shares
            good = (within[:, block] <= 0) & ~(within[:, :block] <= 0).any(1)
            # what rounding could decide is taken again, pair by pair in one way
            for n in np.flatnonzero((np.abs(within[:, :block + 1]) < _SLACK).any(1)):
                gap = np.add.reduceat(np.einsum("i,ij->j", x[p[n]] - y[q[n]], turn) ** 2, firsts) - shares
                good[n] = gap[block] <= 1e-12 and not (gap[:block] <= 1e-12).any()
            out.append((p[good], q[good]))
    return tuple(np.concatenate(z) for z in zip(*out))


def _count(kind: str, cosine: float, distance: float):
    kinds = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, i, j, guests = (k.as_py() for k in (key[0], key[2], key[3], key[4]))
        side = table["side"].to_numpy()
        parts = [table.filter(pa.array(side == s)) for s in (0, 1)]
        if not parts[0].num_rows or (not parts[1].num_rows and (guests or i != j)):
            return kinds.empty_table()
        own = not guests and i == j  # pairs within one chunk
        left, right = parts[0], parts[0] if own else parts[1]
        by_size: dict[int, list] = {}
        for n, part in enumerate((left, right)):
            for row, data in enumerate(part["key"].to_pylist()):
                by_size.setdefault(len(data), [[], []])[n].append((row, data))
        ids = [p["id"].to_numpy() for p in (left, right)]
        copies = [p["n"].to_numpy() for p in (left, right)]
        every = np.concatenate(ids)
        links = np.zeros(len(every), dtype=np.int64)
        label = np.arange(len(every))
        for xs, ys in by_size.values():
            if not xs or not ys or (own and len(xs) < 2) or block * BLOCK >= len(xs[0][1]) // np.dtype(kind).itemsize:
                continue
            a, b = (np.array([r for r, _ in s]) for s in (xs, ys))
            x, y = (_unit([d for _, d in s], kind) for s in (xs, ys))
            p, q = _pairs(x, y, cosine, distance, block, own)
            p, q = a[p], b[q]
            np.add.at(links, p, copies[1][q])
            q = q if own else q + len(ids[0])
            np.add.at(links, q, copies[0][p])
            while True:  # least labels along the pairs, until they stay
                low = np.minimum(label[p], label[q])
                before = label.copy()
                np.minimum.at(label, p, low)
                np.minimum.at(label, q, low)
                label = label[label]
                if (before == label).all():
                    break
        told = np.flatnonzero(links)
        return pa.table({"id": every[told], "links": links[told], "other": every[label[told]]}, schema=kinds)

    return run


def link(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows ``vec_id, n_links, component_id, kept`` for each row of ``vectors``; ids are whole numbers."""
    distance, kind = 2 - 2 * cosine, _kind(vectors, vector_column)
    rows = store(keyed(vectors, id_column, vector_column), "vectors")
    classes = store(
        rows.filter("key is not null and id is not null").groupBy("key").agg(
            F.min("id").cast("long").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    # two vectors at random are in the same or touching cells in about 4 of 10 cases a dimension
    grid = int(np.clip(np.ceil(np.log(max(1, classes.count()) / CELL) / np.log(2.5)), 1, BLOCK))
    placed = store(seats(classes, kind, distance, grid), "seats")
    counts = (
        placed.groupBy("block", "cell").agg(
            F.sum((F.col("guest") == 0).cast("long")).alias("homes"), F.sum("guest").alias("guests"))
        .filter("homes > 0 and homes + guests > 1")
        .select("block", "cell", *[F.greatest(F.lit(1), F.ceil(F.col(c) / CHUNK)).cast("int").alias(c) for c in ("homes", "guests")],
                (F.col("guests") > 0).alias("visited")))
    seated = placed.join(counts, ["block", "cell"]).withColumn(
        "chunk", F.pmod(F.xxhash64("id"), F.when(F.col("guest") == 0, F.col("homes")).otherwise(F.col("guests"))).cast("int"))

    def task(i, j, guests, side):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(guests).alias("visits"), side.alias("side"))

    def among(c):
        return task(F.least(c, F.col("chunk")), F.greatest(c, F.col("chunk")), 0, (c < F.col("chunk")).cast("int"))

    homes = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("homes") - 1), among),
        F.when(F.col("visited"), F.transform(
            F.sequence(F.lit(0), F.col("guests") - 1), lambda c: task(F.col("chunk"), c, 1, F.lit(0)))).otherwise(
            F.array().cast("array<struct<i:int,j:int,visits:int,side:int>>")))
    visits = F.transform(
        F.sequence(F.lit(0), F.col("homes") - 1), lambda c: task(c, F.col("chunk"), 1, F.lit(1)))
    tasks = seated.withColumn("task", F.explode(F.when(F.col("guest") == 0, homes).otherwise(visits))).select(
        "block", "cell", "task.*", "id", "n", "key")
    found = store(
        tasks.groupBy("block", "cell", "i", "j", "visits").applyInArrow(
            _count(kind, cosine, distance), "id long, links long, other long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    member = rows.join(classes.select("key", F.col("id").alias("chief"), "n"), "key", "left")
    of_class = (
        member.join(links.withColumnRenamed("id", "chief"), "chief", "left")
        .join(joined.withColumnRenamed("node", "chief"), "chief", "left")
        .select(F.col("id").alias(id_column),
                F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
                F.coalesce("component", "chief", F.col("id").cast("long")).alias("component_id")))
    return of_class.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))

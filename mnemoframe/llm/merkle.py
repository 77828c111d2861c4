"""Merkle trees over the rows of a table, with a proof for each row, by time-forward processing.

Every node of a tree has a label: the last leaf below it, then its level.  Children come
before their parents in the order of labels, and few messages are under way at a time.
The forward sweep visits the nodes in that order: a node takes the digests that its
children have sent it out of a priority queue ordered by the receiver's label, makes its
own digest, and sends that to its parent.  The reversed sweep runs through the same nodes
backwards: each takes its proof suffix (the siblings on the way from it to the root) out
of the queue and sends every child the suffix lengthened by the child's siblings.

A tree is cut into blocks, each the subtree of ``FAN ** HEIGHT`` consecutive nodes.
Within a block the queue is a heap of at most ``FAN`` messages a level; between blocks it
is Spark's sorted shuffle, which is external: messages are rows keyed by the receiving
block and sorted by label, so that a block meets its suffix before its leaves.  No block,
and so no task, grows with the tree; ``n`` leaves take ``log(n) / log(FAN ** HEIGHT)``
rounds, each on a table smaller by that power.

The trees' roots are the leaves of one more tree, in ascending order of their keys.

Leaves are ordered by ``order`` (null first), then by digest, so rows with equal order have
a defined place and equal rows are interchangeable.  The null key is a tree of its own and comes first.
A tree of one leaf has the leaf's digest as root, and its leaf adds no siblings.  Columns
other than those named are neither read nor hashed.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mnemoframe.llm.common import parallelism, store

FAN = 8
HEIGHT = 4  # levels of a block
_MOST_LEVELS = 21  # 8 ** 21 is the number of 64-bit integers that are not negative
_DIGEST = 64  # hexadecimal digits

_PATH = T.ArrayType(T.StringType(), False)


def row_digest(*values: Column) -> Column:
    """Digest of values in a row: each ``-`` if null, else its length in UTF-8 bytes, ``:``, and itself."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    def step(digest: Column, siblings: Column) -> Column:
        before = F.substring(siblings, 1, 1).cast("int") * _DIGEST
        return F.sha2(F.concat(
            siblings.substr(F.lit(2), before), digest, siblings.substr(before + 2, F.length(siblings))), 256)

    return F.aggregate(proof, leaf, step)


def proof_text(proof: Column) -> Column:
    """The siblings of a proof in a row, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.substring(s, 2, FAN * _DIGEST)), "")


def manifest(leaves: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``leaves`` with ``proof, subroot, root`` added.

    ``leaves`` has ``leaf`` (a digest), ``key`` (the tree of a leaf), ``order`` (its place
    there) and any others, which stay.  ``proof`` has an element for each level on the way
    to ``root``: a digit, the place among the siblings, then the siblings' digests.
    ``subroot`` is the root of the key's tree.
    """
    placed = _numbered(leaves, key, order)
    rounds = _climbed(placed)
    tops = rounds[-1].select("_tree", F.col("_digest").alias("subroot"))
    forest = _numbered(
        tops.select("subroot", F.col("_tree").alias("_key"), F.lit("").alias("_all"), F.col("subroot").alias("leaf")),
        "_all", "_key")
    above = _climbed(forest)
    root = above[-1].select("_tree", F.lit(0).cast("long").alias("_index"), F.array().cast(_PATH).alias("_path"),
                            F.lit("").alias("_subroot"), F.col("_digest").alias("_root"))
    heads = _descended(above, root, forest, ["_key", "subroot"])
    messages = heads.select(F.col("_key").alias("_tree"), F.lit(0).cast("long").alias("_index"),
                            "_path", F.col("subroot").alias("_subroot"), "_root")
    found = _descended(rounds, messages, placed, leaves.columns)
    return found.select(*leaves.columns, F.col("_path").alias("proof"),
                        F.col("_subroot").alias("subroot"), F.col("_root").alias("root"))


def _numbered(leaves: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``_tree, _index, _levels, _digest``: the place of each leaf in its tree, and the levels above it.

    Rows are dealt out by ranges of (key, order, digest), so a key of any share spreads
    over tasks; a row's place is that in its range plus the key's rows in ranges before.
    """
    parts = parallelism(leaves.sparkSession)
    by = [F.col(key), F.col(order), F.col("leaf")]
    sorted_rows = store(
        leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)), "leaves")
    ranges = sorted_rows.groupBy("_part", F.col(key).alias("_tree")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("_tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_rows").over(tree)
    bounds = ranges.select(
        F.col("_part").alias("_of"), "_tree",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        sum((total > F.lit(FAN ** level)).cast("int") for level in range(_MOST_LEVELS)).alias("_levels"))
    return sorted_rows.join(
        bounds, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_tree"))
    ).select(*leaves.columns, "_tree", (F.col("_at") + F.col("_shift")).alias("_index"), "_levels",
             F.col("leaf").alias("_digest"))


def _climbed(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, from the leaves to the roots of all trees."""
    rounds = [nodes.select("_tree", "_index", "_levels", "_digest")]
    most = nodes.agg(F.max("_levels")).first()[0] or 0
    schema = rounds[0].schema
    for _ in range(0, most, HEIGHT):
        up = _by_block(rounds[-1]).select("_tree", "_block", "_index", "_levels", "_digest").mapInArrow(_sent_up, schema)
        rounds.append(store(up, "nodes"))
    return rounds


def _descended(rounds: list[DataFrame], messages: DataFrame, leaves: DataFrame, kept: list[str]) -> DataFrame:
    """Deliver the proof suffixes of the roots (``messages``) down to ``leaves``.

    Gives the columns ``kept`` of the leaves with ``_path, _subroot, _root``.
    """
    for nodes in reversed(rounds[1:-1]):
        messages = store(_delivered(nodes, messages, ["_tree", "_index"]), "suffixes")
    if len(rounds) == 1:  # each leaf is a root
        return leaves.join(
            messages.withColumnRenamed("_tree", "_own").drop("_index"), F.col("_tree").eqNullSafe(F.col("_own"))
        ).select(*kept, "_path", "_subroot", "_root")
    return _delivered(leaves, messages, kept)


def _delivered(nodes: DataFrame, messages: DataFrame, kept: list[str]) -> DataFrame:
    """One reversed sweep through the blocks of ``nodes``; ``messages`` hold a suffix for each block."""
    told = nodes.select("_tree", "_index", "_levels", "_digest", F.struct(*kept).alias("_row"))
    rows = told.unionByName(
        messages.withColumn("_levels", F.lit(None).cast("int")).select(
            "_tree", F.col("_index").alias("_receiver"), "_levels", "_path", "_subroot", "_root"),
        allowMissingColumns=True)
    schema = T.StructType([
        T.StructField("_row", told.schema["_row"].dataType), T.StructField("_path", _PATH),
        T.StructField("_subroot", T.StringType()), T.StructField("_root", T.StringType())])
    swept = _by_block(rows).select(
        "_tree", "_block", "_index", "_levels", "_digest", "_row", "_path", "_subroot", "_root").mapInArrow(_sent_down, schema)
    return swept.select("_row.*", "_path", "_subroot", "_root")


def _by_block(nodes: DataFrame) -> DataFrame:
    """Blocks whole in a task, one after another, their rows in the order of labels; messages come first."""
    block = F.expr(f"div(_index, {FAN ** HEIGHT})")
    if "_receiver" in nodes.columns:
        block = F.coalesce(F.col("_receiver"), block)
    return (nodes.withColumn("_block", block)
            .repartition("_tree", "_block")
            .sortWithinPartitions("_tree", "_block", F.col("_index").asc_nulls_first()))


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """``(tree, block, rows)`` for each run of rows of a block."""
    own, rows = None, []
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in ("_tree", "_block", *columns)]
        for tree, block, *values in zip(*lists):
            if own != (tree, block) and rows:
                yield *own, rows
                rows = []
            own = (tree, block)
            rows.append(values)
    if rows:
        yield *own, rows


def _sent_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for tree, block, rows in _blocks(batches, ["_levels", "_digest"]):
        levels = rows[0][0]
        height = min(levels, HEIGHT)
        out.append((tree, block, levels - height, forward([d for _, d in rows], height)[-1][2]))
    if out:
        trees, blocks, levels, digests = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(trees, pa.string()), pa.array(blocks, pa.int64()), pa.array(levels, pa.int32()),
             pa.array(digests, pa.string())], ["_tree", "_index", "_levels", "_digest"])


def _sent_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def kept_rows(source):
        for batch in source:
            place = batch.schema.get_field_index("_row")
            held.append(batch.column(place))
            # rows of the leaves stay in Arrow; their numbers travel
            yield batch.set_column(place, "_row", pa.array(range(len(batch)), pa.int32())).append_column(
                "_from", pa.array([len(held) - 1] * len(batch), pa.int32()))

    held: list[pa.Array | None] = []
    for _, _, rows in _blocks(kept_rows(batches), ["_levels", "_digest", "_row", "_from", "_path", "_subroot", "_root"]):
        _, _, _, _, path, subroot, root = rows[0]
        leaves = rows[1:]
        height = min(leaves[0][0], HEIGHT)
        paths = backward(forward([row[1] for row in leaves], height), tuple(path))
        first, last = leaves[0][3], leaves[-1][3]
        pieces = []
        for batch in range(first, last + 1):
            numbers = [row[2] for row in leaves if row[3] == batch]
            pieces.append(held[batch].slice(numbers[0], len(numbers)))
        for batch in range(first):
            held[batch] = None
        count = len(leaves)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays(pieces), pa.array(paths, pa.list_(pa.string())),
             pa.array([subroot] * count, pa.string()), pa.array([root] * count, pa.string())],
            ["_row", "_path", "_subroot", "_root"])


def forward(digests: list[str], levels: int) -> list[tuple]:
    """Visit the nodes of a tree over ``digests``, of so many levels, in ascending order of labels.

    Gives ``(label, place below the parent, digest, [(label, digest) of each child])`` of
    each; the root comes last.  ``FAN ** levels`` is at least the number of digests.
    """
    queue: list[tuple] = []  # (label of the receiver, number of the sender in its level, label, digest)
    log: list[tuple] = []
    last = len(digests) - 1

    def visit(level: int, number: int, label: tuple[int, int], digest: str, children: list) -> None:
        log.append((label, number % FAN, digest, children))
        if level < levels:
            above = number // FAN
            receiver = (min((above + 1) * FAN ** (level + 1) - 1, last), level + 1)
            heapq.heappush(queue, (receiver, number, label, digest))

    for number, digest in enumerate(digests):
        visit(0, number, (number, 0), digest, [])
        while queue and queue[0][0][0] == number:
            label, sender, *child = heapq.heappop(queue)
            children = [child]
            while queue and queue[0][0] == label:
                children.append(heapq.heappop(queue)[2:])
            visit(label[1], sender // FAN, label,
                  sha256("".join(d for _, d in children).encode()).hexdigest(), children)
    return log


def backward(log: list[tuple], path: tuple[str, ...]) -> list[list[str]]:
    """Visit the nodes of ``forward`` in the reverse order; gives each leaf's proof, in their order.

    ``path`` is the proof suffix of the last node.
    """
    queue = [(-log[-1][0][0], -log[-1][0][1], path)]
    paths: list[list[str]] = []
    for label, _, _, children in reversed(log):
        at, level, path = heapq.heappop(queue)
        if (-at, -level) != label:
            raise AssertionError("a suffix met another node")
        if not children:
            paths.append(list(path))
        for place, (child, _) in enumerate(children):
            others = "".join(d for n, (_, d) in enumerate(children) if n != place)
            heapq.heappush(queue, (-child[0], -child[1], (f"{place}{others}", *path)))
    paths.reverse()
    return paths

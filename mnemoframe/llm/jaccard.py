"""Exact Jaccard similarity join of documents on word n-grams, by adaptive multi-match prefixes.

A document's set is hashed word n-grams (the whole sequence as one if it has fewer
words).  In an order common to all sets, rare grams first, two sets that are similar
enough share ``l`` grams among the first ``n - needed + l`` of each, for every ``l``.  A
document whose first grams are frequent takes a longer prefix with more matches asked
for, where its estimated number of candidates falls by more than the prefix costs.
Candidates are verified on the full sets.

Of two sets, the one whose prefix ends earlier in the order shows all the grams that its
prefix shares with the other, so similar sets share as many prefix grams as their needed
overlap leaves after the rest of that set; fewer rule a pair out before any set is read.

Equal sets form a class and stand for one another.  Candidates are verified in two
steps: first the sets around a prefix gram with the least of them, which joins groups of
copies in linear work; then all candidate pairs whose members are not connected yet.

Gram frequencies are counted over all documents in ``SLOTS`` hashed slots, an order that
need only be the same for all.  Null, empty and blank texts have empty sets and link with
nothing.  Rows with equal ids are taken as one document: their links are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mnemoframe.llm.common import Words, chunks, gram_hashes, mixed, small_batches, store
from mnemoframe.llm.components import components

SLOTS = 1 << 18
SHORT = 64  # documents of a gram whose pairs are joined as rows; those of more meet in tasks
MEET = 512  # documents of a gram that a task compares with as many others
LONGEST = 4  # matches asked for at most
VERIFY = 10.0  # cost of a candidate against that of an entry of a prefix list


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of each text, in a row, and where each text's begin and end."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    counts = np.diff(words.first)
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(words.first[1:], counts) - np.arange(len(hashes))  # words to the end of the text
    full = left >= n
    grams = np.zeros(len(hashes), dtype=np.uint64)
    at = np.flatnonzero(full)
    grams[at] = gram_hashes(hashes, n)[at]
    # a text with fewer words: all of them as one gram
    for size in range(1, n):
        at = words.first[:-1][counts == size]
        if len(at):
            grams[at] = mixed(gram_hashes(hashes, size)[at] + np.uint64(size))
            full[at] = True
    row, grams = row[full], grams[full]
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams = row[new], grams[new]
    return grams, np.searchsorted(row, np.arange(len(counts) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    running = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)))
    return running[at[1:]] - running[at[:-1]]


def survey(docs: DataFrame, n: int) -> DataFrame:
    """Rows ``doc_id, size, one, two`` (two digests of the set), and rows ``slot, n`` with a null
    ``size`` that count grams by hashed slot."""
    schema = T.StructType([docs.schema["doc_id"], *(
        T.StructField(c, T.LongType()) for c in ("size", "one", "two", "slot", "n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kind = np.zeros(SLOTS, dtype=np.int64), pa.int64()
        for batch in chunks(batches):
            grams, at = gram_sets(batch.column("text"), n)
            seen += np.bincount((grams % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
            digests = [_sums(mixed(grams ^ np.uint64(c)), at).view(np.int64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), *map(pa.array, digests), none, none], schema.names)
            kind = batch.column("doc_id").type
        used = np.flatnonzero(seen)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), kind), none, none, none, pa.array(used), pa.array(seen[used])], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def prefixes(docs: DataFrame, n: int, percent: int, frequency: np.ndarray) -> DataFrame:
    """Rows ``doc_id, size, matches, grams``: the adaptive prefix of each set that is not empty."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("size", T.LongType()), T.StructField("matches", T.IntegerType()),
        T.StructField("grams", T.ArrayType(T.LongType(), False))])
    usual = np.float32(np.mean(frequency[frequency > 0])) if frequency.any() else np.float32(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            grams, at = gram_sets(batch.column("text"), n)
            size = np.diff(at)
            row = np.repeat(np.arange(len(size)), size)
            often = frequency[(grams % np.uint64(SLOTS)).astype(np.int64)]
            order = np.lexsort((grams, often, row))
            grams, often = grams[order], often[order]
            shorter = size - -(-percent * size // 100)  # grams a similar set may lack
            most = np.minimum(LONGEST, size - shorter)
            partners = np.concatenate(([0.0], np.cumsum(np.maximum(often - usual, 0), dtype=np.float64)))
            best, matches = np.full(len(size), np.inf), np.ones(len(size), dtype=np.int64)
            for asked in range(1, LONGEST + 1):
                end = at[:-1] + np.minimum(shorter + asked, size)
                cost = (partners[end] - partners[at[:-1]]) * (1 + VERIFY / asked) + asked
                better = (cost < best) & (asked <= most)
                best[better], matches[better] = cost[better], asked
            length = np.where(size > 0, np.minimum(shorter + matches, size), 0)
            ends = np.concatenate(([0], np.cumsum(length)))
            kept = np.repeat(at[:-1] - ends[:-1], length) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(grams[kept].view(np.int64)))
            made = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(matches.astype(np.int32)), lists], schema.names)
            yield made.filter(pa.array(size > 0))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """Rows ``doc_id, grams binary``: the sorted set of each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("grams", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            grams, at = gram_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([grams[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (``a, b``) whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(
        run, pairs.select("a", "b").schema)


def meetings(placed: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components that meet at a gram and share as many prefix grams as
    similar sets must.

    Rows of ``placed`` are ``gram, doc_id, size, matches, component, largest, listed``.  The documents at
    a gram are cut into chunks; a task compares one chunk of those outside the largest
    component with one of all, by their whole prefixes, and returns the pairs that pass.
    """
    parts = F.ceil(F.col("listed") / MEET).cast("int")
    seated = placed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    chunk = F.sequence(F.lit(0), F.col("parts") - 1)
    left = F.when(F.col("component") != F.col("largest"), F.transform(
        chunk, lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(True).alias("left"))))
    right = F.transform(chunk, lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(False).alias("left")))
    none = F.array().cast("array<struct<i:int,j:int,left:boolean>>")
    seats = (
        seated.select("gram", "doc_id", "size", "matches", "component", F.explode(F.concat(F.coalesce(left, none), right)).alias("seat"))
        .select("gram", "seat.*", "doc_id", "size", "matches", "component")
        .join(lists.select("doc_id", "size", "matches", "grams"), ["doc_id", "size", "matches"])
        .repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j"))
    kind = placed.schema["doc_id"].dataType

    def needed(size: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Prefix grams beyond ``matches`` of the first that two sets of these sizes share at least."""
        return -(-percent * (size + other) // (100 + percent)) - -(-percent * size // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["gram", "i", "j"]):
            side = group["left"].to_numpy(zero_copy_only=False)
            x, y = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(x) or not len(y):
                continue
            grams = group["grams"].combine_chunks()
            row = np.repeat(np.arange(len(grams)), np.diff(grams.offsets.to_numpy()))
            _, token, often = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
            used = np.flatnonzero(often > 1)
            place = np.full(len(often), -1)
            place[used] = np.arange(len(used))
            known = place[token] >= 0
            table = np.zeros((len(grams), len(used)), dtype=np.float32)
            table[row[known], place[token[known]]] = 1
            shared = table[x] @ table[y].T
            size, asked, doc, component = (group[c].to_numpy() for c in ("size", "matches", "doc_id", "component"))
            s, o = size[x][:, None], size[y][None]
            least = np.minimum(needed(s, o) + asked[x][:, None], needed(o, s) + asked[y][None])
            good = (shared >= least) & (100 * s >= percent * o) & (100 * o >= percent * s)
            good &= component[x][:, None] != component[y][None]
            p, q = np.nonzero(good)
            a, b = doc[x[p]], doc[y[q]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return seats.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for first, end in zip([0, *ends], [*ends, batch.num_rows]):
            key = tuple(c[first] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, end - first))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def least_shared(percent: int, x_size: str, x_matches: str, y_size: str, y_matches: str) -> Column:
    """How many prefix grams two sets share at least if they are similar enough; sizes that rule
    it out ask for more than a prefix has."""
    both = f"({percent} * ({x_size} + {y_size}) + {99 + percent}) div {100 + percent}"
    own = [f"{both} - ({percent} * {size} + 99) div 100 + {matches}" for size, matches in (
        (x_size, x_matches), (y_size, y_matches))]
    apart = f"100 * {x_size} < {percent} * {y_size} or 100 * {y_size} < {percent} * {x_size}"
    return F.expr(f"case when {apart} then {x_size} + {y_size} + 1 else least({own[0]}, {own[1]}) end")


def link(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id, text``).

    Two sets link when 100 * shared >= percent * all grams of both.
    """
    spark = docs.sparkSession
    seen = store(survey(docs, n), "survey")
    sizes = seen.filter("size is not null").select("doc_id", "size", "one", "two")
    slots = seen.filter("size is null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(SLOTS, dtype=np.float32)  # at most SLOTS numbers, whatever the corpus
    frequency[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    # a class of equal sets is known by its least id
    classes = store(
        sizes.filter("size > 0").groupBy("size", "one", "two").agg(F.min("doc_id").alias("chief")), "classes")
    chiefs = classes.select(F.col("chief").alias("doc_id")).distinct()
    lists = store(
        prefixes(docs, n, percent, frequency).join(chiefs, "doc_id", "left_semi")
        .dropDuplicates(["doc_id", "size", "grams"]), "prefixes")
    # only grams that several documents have are kept, and travel with nothing but the id
    entries = lists.select(F.explode("grams").alias("gram"), "doc_id")
    several = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    met = store(entries.join(several, "gram"), "entries").join(lists.select("doc_id", "size", "matches"), "doc_id")
    # what meets at a gram: the least id in it is verified with all others
    hubs = met.groupBy("gram").agg(F.min("doc_id").alias("hub"))
    texts = docs.select("doc_id", "text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = store(pairs, "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        # one plan at every size: the ids may outgrow any broadcast
        sets = store(full_sets(texts.join(ends.hint("merge"), "doc_id", "left_semi"), n), "sets")
        with small_batches(spark, 500):
            return store(verified(pairs, sets, percent), "links")

    of_hub = lists.select(F.col("doc_id").alias("hub"), F.col("size").alias("hub_size"), F.col("matches").alias("hub_matches"))
    stars = (
        met.join(hubs, "gram").filter("doc_id <> hub").groupBy("hub", "doc_id", "size", "matches").agg(F.count(F.lit(1)).alias("shared"))
        .join(of_hub, "hub")
        # a pair may meet elsewhere as well: what half of the asked grams show is worth a look
        .filter(2 * F.col("shared") >= least_shared(percent, "size", "matches", "hub_size", "hub_matches"))
        .select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = confirmed(stars)
    joined = components(links)
    placed = met.join(joined, met["doc_id"] == joined["node"], "left").select(
        "gram", "doc_id", "size", "matches", F.coalesce("component", "doc_id").alias("component"))
    # of the entries of a gram, those outside its largest component meet all others
    largest = (
        placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("gram").agg(F.max(F.struct("n", "component"))["component"].alias("largest"),
                             F.count(F.lit(1)).alias("parts"), F.sum("n").alias("listed"))
        .filter("parts > 1"))
    listed = store(placed.join(largest, "gram"), "listed")
    x, y = (listed.filter(F.col("listed") <= SHORT).alias(name) for name in "xy")
    few = (
        x.filter("component <> largest").join(y, F.col("x.gram") == F.col("y.gram"))
        .filter("x.component <> y.component and (y.component = y.largest or x.doc_id < y.doc_id)")
        .filter(f"100 * x.size >= {percent} * y.size and 100 * y.size >= {percent} * x.size")
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct())
    of = {s: lists.select(F.col("doc_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("size", "matches", "grams")]) for s in "ab"}
    few = (
        few.join(of["a"], "a").join(of["b"], "b")
        .filter(F.size(F.array_intersect("a_grams", "b_grams")) >= least_shared(
            percent, "a_size", "a_matches", "b_size", "b_matches"))
        .select("a", "b"))
    rest = few.union(meetings(listed.filter(F.col("listed") > SHORT), lists, percent)).distinct()
    more = confirmed(rest)
    of_chief = components(links.union(more)) if not more.isEmpty() else joined
    # members of a class hang on its chief; equal ids count as one document
    member = sizes.join(classes, ["size", "one", "two"], "left").select("doc_id", "size", "chief")
    found = member.join(of_chief, F.col("chief") == F.col("node"), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "chief", "doc_id").alias("component_id"))
    return found

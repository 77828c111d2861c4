"""Removal of repeated passages: words covered by a window that also starts earlier in the corpus.

Windows of ``length`` words are routed by content: the least hash among the runs of
``RUN`` words in a window is its anchor, and a stretch of windows with one anchor is a
segment, so equal windows always meet.

1. Each task keeps the first of its equal segments; later ones are repeats.  What is
   left meets by anchor, where equal segments are told apart from first ones in a sorted
   pass.  Whatever the number of copies, a task holds one row of them.
2. Segments that differ but share an anchor may share windows.  Their words are fetched
   from the texts and indexed, some hundred thousand words at a time, in an FM-index over
   a wavelet tree; backward search finds which windows occur again, and all but the first
   occurrence are repeats.  Anchors of more than ``MANY`` different segments, which would
   not fit an index, take their windows through an aggregation by window instead.
3. The ranges of repeated windows of a document are joined to its text.

Windows are judged on the input.  Null texts have no words; texts with fewer words than
a window keep all.  A null id counts as the least.  Rows with equal ids are one document:
windows at the same place are no repeats of each other, and what is found in one row's
text is removed from all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F, types as T

from mnemoframe.llm.common import Words, _powers, chunks, gram_hashes, mixed, store
from mnemoframe.llm.fm_index import FmIndex

RUN = 8
MANY = 2000
INDEXED = 120_000  # words of an index, and those of one more anchor
_LEAST = -(1 << 63)
_RANGE = "key long, start long, n long"


def _segments(words: Words, length: int):
    """Arrays of row, anchor, digest, first window and number of windows of all segments."""
    hashes = words.hashes()
    run = min(RUN, length)
    grams = gram_hashes(hashes, run)
    span = length - run + 1
    empty = np.zeros(0, dtype=np.int64)
    if len(grams) < span:
        return empty, empty, empty, empty, empty
    least = sliding_window_view(grams, span).argmin(1) + np.arange(len(grams) - span + 1)
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    window = np.flatnonzero(row[:len(least)] == row[length - 1:length - 1 + len(least)])
    least, row = least[window], row[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate((at, [len(window)])))
    first, end = window[at], window[at] + count + length - 1
    power, inverse = _powers(len(hashes) + 1)
    running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)))
    digest = mixed(mixed((running[end] - running[first]) * inverse[first]) + count.astype(np.uint64))
    return row[at], grams[least[at]].view(np.int64), digest.view(np.int64), first - words.first[row[at]], count


def _told_apart(group: tuple[np.ndarray, ...], key: np.ndarray, start: np.ndarray):
    """Masks of sorted rows: the first of each group, and those at another place than it.  What is at its
    place comes from a row with the same id and is in neither."""
    lead = np.ones(len(key), dtype=bool)
    lead[1:] = np.any([g[1:] != g[:-1] for g in group], axis=0)
    at = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(key) else np.zeros(0, dtype=np.int64)
    return lead, (key != key[at]) | (start != start[at])


def _merged(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Ranges of windows with those that touch put together."""
    order = np.lexsort((start, key))
    key, start, n = key[order], start[order], n[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != (start + n)[:-1])
    at = np.flatnonzero(new)
    return [key[at], start[at], np.add.reduceat(n, at) if len(at) else n[:0]]


_ROW = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "digest", "key", "start", "n")])


def _ranges(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_ROW`` without a digest, for ranges that are known to be repeats."""
    key, start, n = _merged(key, start, n)
    spread = mixed(key.view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(spread), pa.nulls(len(key), pa.int64()), *map(pa.array, (key, start, n))], _ROW.names)


def segments(docs: DataFrame, length: int) -> DataFrame:
    """Rows ``anchor, digest, key, start, n``: each task's first of equal segments, and ranges of windows
    that are repeats within the task (without a digest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in chunks(batches):
            row, anchor, digest, start, n = _segments(Words(batch.column("text")), length)
            parts.append((anchor, digest, batch.column("key").to_numpy()[row], start.astype(np.int32), n.astype(np.int32)))
        if not parts:
            return
        anchor, digest, key, start, n = (np.concatenate(p) for p in zip(*parts))
        del parts
        order = np.lexsort((start, key, digest))
        first, later = _told_apart((digest[order],), key[order], start[order])
        again, order = order[later], order[first]
        yield _ranges(key[again], start[again].astype(np.int64), n[again].astype(np.int64))
        for at in range(0, len(order), 100_000):
            some = order[at:at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[some]), pa.array(digest[some]), pa.array(key[some]),
                 pa.array(start[some].astype(np.int64)), pa.array(n[some].astype(np.int64))], _ROW.names)

    return docs.mapInArrow(run, _ROW)


def meet(rows: DataFrame) -> DataFrame:
    """Of all segments: ranges that repeat an earlier segment (without an anchor), and first segments that share
    their anchor with a different one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor, digest, key and start of the first row of the segment before
        waiting, open_anchor = None, None  # a first segment alone so far; an anchor known to have several
        for batch in batches:
            known = batch.column("digest").is_valid().to_numpy(zero_copy_only=False)
            if not known.all():
                yield _kept(batch.filter(pa.array(~known)), None)
            batch = batch.filter(pa.array(known))
            if not batch.num_rows:
                continue
            anchor, digest = batch.column("anchor").to_numpy(), batch.column("digest").to_numpy()
            key, start = batch.column("key").to_numpy(), batch.column("start").to_numpy()
            new, later = _told_apart((anchor, digest), key, start)
            if last is not None and last[:2] == (anchor[0], digest[0]):
                until = int(np.flatnonzero(new)[1]) if new.sum() > 1 else len(new)
                later[:until] = (key[:until] != last[2]) | (start[:until] != last[3])
                new[0] = False
            if new.any():
                lead = np.flatnonzero(new)[-1]
                last = (anchor[lead], digest[lead], key[lead], start[lead])
            if later.any():
                yield _kept(_ranges(key[later], start[later], batch.column("n").to_numpy()[later]), None)
            firsts = pa.Table.from_batches([b for b in (waiting, batch.filter(pa.array(new))) if b is not None])
            firsts = firsts.combine_chunks()
            waiting = None
            if not firsts.num_rows:
                continue
            firsts = firsts.to_batches()[0]
            anchor = firsts.column("anchor").to_numpy()
            begins = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            size = np.diff(np.concatenate((begins, [len(anchor)])))
            several = size > 1
            several[0] |= open_anchor == anchor[0]
            if several[-1]:
                open_anchor = anchor[-1]
            else:
                waiting, open_anchor = firsts.slice(len(firsts) - 1), None
            out = firsts.filter(pa.array(np.repeat(several, size)))
            yield _kept(out, out.column("anchor"))

    def _kept(batch: pa.RecordBatch, anchor) -> pa.RecordBatch:
        anchor = pa.nulls(batch.num_rows, pa.int64()) if anchor is None else anchor
        return pa.RecordBatch.from_arrays([anchor, *(batch.column(c) for c in ("key", "start", "n"))], ["anchor", "key", "start", "n"])

    return rows.repartition("anchor").sortWithinPartitions("anchor", "digest", "key", "start").mapInArrow(
        run, "anchor long, key long, start long, n long")


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Rows ``anchor, key, start, n, words``: the words of the wanted segments (``anchor, key, start, n``),
    whose anchor may be null."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("wanted"))
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("anchor", "key", "start", "n")), T.StructField("words", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"))
            data, column = words.data.tobytes(), batch.column("wanted")
            struct = column.flatten()
            start, n = (struct.field(i).to_numpy() for i in (1, 2))
            row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            first = words.first[row] + start
            good = first + n + length - 1 <= words.first[row + 1]
            start, n, row, first = (x[good] for x in (start, n, row, first))
            begin, end = words.starts[first], words.ends[first + n + length - 2]
            slices = pa.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [struct.field(0).filter(pa.array(good)), batch.column("key").take(pa.array(row)), pa.array(start), pa.array(n), slices], schema.names)

    return docs.join(lists, "key").select("key", "text", "wanted").mapInArrow(run, schema)


def search(slices: DataFrame, length: int) -> DataFrame:
    """Ranges of windows that occur earlier in another segment of the same anchor, by FM-indexes."""
    def found(part: pa.Table) -> pa.RecordBatch:
        words = Words(part["words"].combine_chunks())
        ranked = np.unique(words.hashes(), return_inverse=True)[1] + 1
        counts = np.diff(words.first)
        row = np.repeat(np.arange(len(counts)), counts)
        symbols = np.zeros(len(ranked) + len(counts), dtype=np.int64)
        symbols[np.arange(len(ranked)) + row] = ranked  # a separator after each slice
        n = np.maximum(counts - length + 1, 0)
        of = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        starts = words.first[of] + of + shift
        hit, interval = FmIndex(symbols, length).repeated(symbols, starts, length)
        key, start = part["key"].to_numpy()[of[hit]], part["start"].to_numpy()[of[hit]] + shift[hit]
        return _later(interval, key, start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            held.append(batch)
            size += int(batch.column("n").to_numpy().sum()) + (length - 1) * batch.num_rows
            if size > INDEXED and anchor[0] != anchor[-1]:
                whole = pa.Table.from_batches(held)
                last = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1
                cut = len(whole) - len(batch) + last
                yield from pieces(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                size = int(held[0].column("n").to_numpy().sum()) + (length - 1) * held[0].num_rows
        if held:
            yield from pieces(pa.Table.from_batches(held))

    def pieces(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        """Indexes of whole anchors with about as many words as wanted."""
        anchor = whole["anchor"].to_numpy()
        size = np.cumsum(whole["n"].to_numpy() + length - 1)
        ends = np.flatnonzero(np.concatenate((anchor[1:] != anchor[:-1], [True]))) + 1
        first, before = 0, 0
        for end, following in zip(ends, [*ends[1:], None]):
            if following is None or size[following - 1] - before > INDEXED:
                yield found(whole.slice(first, end - first))
                first, before = end, size[end - 1]

    return slices.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _RANGE)


def _later(group: np.ndarray, key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Ranges of the windows that are not at the first place of their group."""
    order = np.lexsort((start, key, group))
    group, key, start = group[order], key[order], start[order]
    later = _told_apart((group,), key, start)[1]
    found = _merged(key[later], start[later], np.ones(int(later.sum()), dtype=np.int64))
    return pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["key", "start", "n"])


def windows(slices: DataFrame, length: int) -> DataFrame:
    """Rows ``window, key, start``: a hash of each window of the slices, the first in a batch only,
    and ranges of the others (with ``n``, without ``window``)."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("window", "key", "start", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "words"):
            words = Words(batch.column("words"))
            grams = gram_hashes(words.hashes(), length)
            n = np.maximum(np.diff(words.first) - length + 1, 0)
            of = np.repeat(np.arange(len(n)), n)
            shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            window = grams[words.first[of] + shift].view(np.int64)
            key, start = batch.column("key").to_numpy()[of], batch.column("start").to_numpy()[of] + shift
            order = np.lexsort((start, key, window))
            window, key, start = window[order], key[order], start[order]
            lead, later = _told_apart((window,), key, start)
            for mask, named in ((lead, True), (later, False)):
                found = [key[mask], start[mask], np.ones(int(mask.sum()), dtype=np.int64)]
                found = found if named else _merged(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window[mask]) if named else pa.nulls(len(found[0]), pa.int64()), *map(pa.array, found)], schema.names)

    return slices.select("key", "start", "words").mapInArrow(run, schema)


def repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """Ranges ``key, start, n`` of windows of ``docs`` (``key, text``) that also start earlier."""
    met = store(meet(segments(docs, length)), "met")
    known = met.filter("anchor is null").select("key", "start", "n")
    shared = met.filter("anchor is not null")
    many = shared.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments")).filter(F.col("segments") > MANY)
    wanted = shared.join(many, "anchor", "left").withColumn("anchor", F.when(F.col("segments").isNull(), F.col("anchor")))
    slices = store(fetch(docs, wanted.select("anchor", "key", "start", "n"), length), "slices")
    few = search(slices.filter("anchor is not null"), length)
    every = store(windows(slices.filter("anchor is null"), length), "windows")
    firsts = every.filter("window is not null").groupBy("window").agg(
        F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1")
    later = every.join(firsts, "window").filter(F.struct("key", "start") > F.col("first"))
    return known.union(few).union(every.filter("window is null").select("key", "start", "n")).union(
        later.select("key", "start", "n"))


def remove(docs: DataFrame, length: int = 20) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept`` for each row of ``docs`` (``doc_id, text``): ``kept`` is
    the words that no repeated window covers, joined by one space."""
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), "text")
    ranges = repeats(named.select("key", "text"), length).groupBy("key").agg(
        F.collect_list(F.struct("start", "n")).alias("ranges"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"))
            data, column = words.data.tobytes(), batch.column("ranges").fill_null([])
            struct = column.flatten()
            start, n = (struct.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            counts = np.diff(words.first)
            low = words.first[row] + np.minimum(start, counts[row])
            high = words.first[row] + np.minimum(start + n + length - 1, counts[row])
            depth = np.zeros(len(words.starts) + 1, dtype=np.int64)
            np.add.at(depth, low, 1)
            np.add.at(depth, high, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept, starts, ends = [], words.starts.tolist(), words.ends.tolist()
            for a, b in zip(words.first, words.first[1:]):
                kept.append(b" ".join([data[starts[i]:ends[i]] for i in np.flatnonzero(~gone[a:b]) + a]))
            removed = np.concatenate(([0], np.cumsum(gone)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(removed[words.first[1:]] - removed[words.first[:-1]]),
                 pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    return named.join(ranges, "key", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)

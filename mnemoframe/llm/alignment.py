"""Alignment of the tokens of two tokenizers, with corpus-wide counts of aligned ids.

Both tokenizers cover the same bytes of a text, a space and the text itself.  Places where
tokens of both end cut them into groups.  Most stretches are one to one: token ``i`` of A
ends where token ``i + shift`` of B ends.  Such a stretch is jumped by exponential probing:
as many ends as before, and again twice as many, are compared at the current shift until
they differ, then halves find where.  What follows is an irregular group: whichever
tokenizer lags takes its next token until both ends meet, and the shift is updated.

Documents are worked on in blocks of some megabytes of text.  A block numbers its
different groups, and its different pairs of linked ids with how many of its documents
hold each.  Corpus-wide counts are sums over blocks; they come back to each block as one
row for each of its pairs, so that no more rows are shuffled than blocks have different
pairs, however often an id occurs, and no key has more rows than there are blocks.

Texts are cut for encoding where a space follows something that is not white space, and
between a letter and a mark that no piece joins: both tokenizers start a token there
whatever stands around, so equal stretches of a block are encoded once, and remembered from block to block of a task, ``KEPT_UNITS`` of them at most.

Null and empty texts have no tokens, nor do texts whose tokens' bytes differ from the
space and the text (as where a text has U+2581, which B takes for a space).  Texts of any length are
encoded whole: a longer one is a block of its own.  Rows with equal ids or texts are
documents each.  An empty table gives an empty result.  Columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from mnemoframe.llm.common import chunks, cuttable, mixed, small_batches, spread, store, text_bytes

BLOCK_BYTES = 2 << 20
KEPT_UNITS = 300_000  # some 250 bytes each
_UNITS_AT_ONCE = 20_000
MARK = "▁"  # stands for a space in a piece model
_OUT_BYTES = 4 << 20

_STORED = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("nth", T.IntegerType()),
    T.StructField("doc_id", T.LongType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
    T.StructField("n_links", T.LongType()), T.StructField("groups", T.BinaryType()),
    T.StructField("pairs", T.BinaryType()), T.StructField("docs", T.BinaryType()),
    T.StructField("sizes_a", T.BinaryType()), T.StructField("ids_a", T.BinaryType()),
    T.StructField("sizes_b", T.BinaryType()), T.StructField("ids_b", T.BinaryType())])


_AFTER_LETTER = re.compile("(?<=[A-Za-z])[!-/:-@\\[-`{-~]")
_LETTERS, _MARKS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


def _byte_decoder() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself,
    the other bytes, ascending, for the characters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class _Vocabulary:
    """Bytes of each token of a tokenizer, and ids of texts that begin with a space."""

    def __init__(self, token: list[bytes]):
        self.token = token
        self.size = np.array([len(t) for t in token], dtype=np.int32)

    def ids(self, text: str) -> list[int]:
        """Ids of a text that begins with a space."""
        raise NotImplementedError

    def latin_ids(self, text: str) -> list[int]:
        """The same of a text whose characters all stand before U+0800."""
        return self.ids(text)

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units in a row, and how many each unit has.

        A unit begins with a space or is what follows a letter.  One that begins with a space
        may follow any other whose end is no white space: those are encoded as long texts, and
        told apart by the bytes of their tokens; so are those of Latin letters and their like alone.
        """
        data, at = text_bytes(units)
        names = units.to_pylist()
        apart = np.ones(len(names), dtype=bool)
        apart[:-1] = ~cuttable(data, np.array([0, len(data)]))[at[1:-1]]
        apart |= np.fromiter((MARK in name or name[0] != " " for name in names), dtype=bool, count=len(names))
        counts, found = np.zeros(len(names), dtype=np.int64), []
        far = np.add.reduceat(data >= 0xE0, at[:-1]) > 0 if len(names) else apart
        together = [np.flatnonzero(~apart & ~far), np.flatnonzero(~apart & far)]
        for encode, listed in zip((self.latin_ids, self.ids), together):
            for first in range(0, len(listed), _UNITS_AT_ONCE):
                some = listed[first:first + _UNITS_AT_ONCE]
                found.append(np.array(encode("".join([names[n] for n in some.tolist()])), dtype=np.int32))
                ends = np.searchsorted(np.cumsum(self.size[found[-1]]), np.cumsum((at[1:] - at[:-1])[some])) + 1
                counts[some] = np.diff(ends, prepend=0)
        alone = np.flatnonzero(apart)
        for n in alone.tolist():
            ids = self.ids(names[n]) if names[n][0] == " " else self.ids(" a" + names[n])[1:]
            found.append(np.array(ids, dtype=np.int32))
            counts[n] = len(ids)
        out = np.zeros(int(counts.sum()), dtype=np.int32)
        order = np.concatenate((*together, alone))
        if len(order):
            out[spread((np.cumsum(counts) - counts)[order], counts[order])] = np.concatenate(found)
        return out, counts

    def differ(self, ids: np.ndarray, counts: np.ndarray, units: pa.Array) -> np.ndarray:
        """True for units that their tokens' bytes do not give."""
        want, at = text_bytes(units)
        token = self.token
        got = b"".join([token[i] for i in ids.tolist()])
        ends = np.concatenate(([0], np.cumsum(self.size[ids])))[np.concatenate(([0], np.cumsum(counts)))]
        if len(ends) == len(at) and np.array_equal(ends, at) and got == want.tobytes():
            return np.zeros(len(units), dtype=bool)
        want = want.tobytes()
        return np.array([got[ends[n]:ends[n + 1]] != want[at[n]:at[n + 1]] for n in range(len(units))], dtype=bool)


class ByteLevel(_Vocabulary):
    """A byte-level BPE file of the ``tokenizers`` library.

    If the file's merges make its tokens in the order of their ids, the ids are ranks, and texts
    of Latin letters are encoded by them, which is faster.  Other texts are left to the library, as
    newer versions of Unicode sort their characters otherwise.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer  # after the setting above

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        byte = _byte_decoder()
        listed = [b""] * self._tokenizer.get_vocab_size()
        for token, i in self._tokenizer.get_vocab().items():
            listed[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(listed)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        ids = told["model"]["vocab"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in told["model"]["merges"]]
        made = [ids["".join(m.split(" "))] for m in merges]
        splitter = told.get("pre_tokenizer") or {}
        self._ranked = None
        if (made == sorted(made) and told.get("normalizer") is None
                and (splitter.get("type"), splitter.get("add_prefix_space"), splitter.get("use_regex")) == ("ByteLevel", False, True)):
            special = {t["id"] for t in told["added_tokens"]}
            self._ranked = tiktoken.Encoding(
                "file", pat_str=public_tokenizers.PATTERN, special_tokens={},
                mergeable_ranks={t: i for i, t in enumerate(listed) if i not in special})

    def ids(self, text: str) -> list[int]:
        return self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def latin_ids(self, text: str) -> list[int]:
        return self.ids(text) if self._ranked is None else self._ranked.encode_ordinary(text)


class Pieces(_Vocabulary):
    """A ``sentencepiece`` model that puts a space before a text and marks spaces with U+2581."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        super().__init__([
            bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)])
        # no piece joins a letter to these marks
        self.parted = _MARKS.copy()
        self.parted[[ord(m) for p in pieces for m in _AFTER_LETTER.findall(p)]] = False

    def ids(self, text: str) -> list[int]:
        return self._model.encode(text[1:], num_threads=1)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs``.

    ``path_a`` is a byte-level file, ``path_b`` a piece model, parts of the installation of
    every worker.  ``groups`` reads ``a1,a2|b1;a3|b2,b3``.  ``n_links`` counts the pairs of
    tokens that share a group; a pair of ids counts in how many documents of the whole
    table it is linked.  ``count_sum`` sums that over the links; ``n_best`` counts the links
    whose count is the highest that their A id has.
    """
    aligned = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _aligned(batches, path_a, path_b), _STORED), "aligned")
    listed = aligned.filter("nth = -1")
    with small_batches(docs.sparkSession, 4):  # a row has megabytes
        asked = store(listed.select("block", "pairs", "docs").mapInArrow(
            _pairs, "block long, number int, a int, b int, docs int"), "pairs")
    counts = store(asked.groupBy("a", "b").agg(F.sum("docs").alias("count")), "counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))  # a row for each id of A at most
    answers = (
        asked.drop("docs").join(counts, ["a", "b"]).join(best, "a")
        .select("block", F.lit(0).alias("order"), "number", "count", (F.col("count") == F.col("best")).alias("is_best")))
    order = F.when(F.col("nth") < 0, 1).otherwise(2)
    rows = answers.unionByName(
        aligned.drop("pairs", "docs").select("*", order.alias("order"), F.col("nth").alias("number")).drop("nth"),
        allowMissingColumns=True)
    return (
        rows.repartition("block").sortWithinPartitions("block", "order", "number")
        .select("block", "order", "count", "is_best", "doc_id", "n_a", "n_b", "n_links", "groups",
                "sizes_a", "ids_a", "sizes_b", "ids_b")
        .mapInArrow(_weighed, T.StructType([
            *[T.StructField(c, T.LongType()) for c in
              ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
            T.StructField("groups", T.StringType())])))


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """For each block: its documents with the numbers of their groups, and a row (``nth`` -1) with what
    the numbers stand for."""
    a, b = ByteLevel(path_a), Pieces(path_b)
    encoded = _Encoded(a, b)
    block = TaskContext.get().partitionId() << 32
    for batch in chunks(batches, most=BLOCK_BYTES):
        doc_ids, texts = batch.column("doc_id"), batch.column("text")
        count = len(batch)
        ids_a, of_a, ids_b, of_b = _tokens(texts, encoded)
        cuts_a, cuts_b = group_cuts(np.cumsum(a.size[ids_a], dtype=np.int32), np.cumsum(b.size[ids_b], dtype=np.int32))
        groups = _Groups(ids_a, ids_b, cuts_a, cuts_b)
        at = np.searchsorted(cuts_a, of_a, side="right")  # groups of document n: at[n] to at[n + 1]
        links = np.concatenate(([0], np.cumsum(groups.links[groups.number])))
        row = np.repeat(np.arange(count), np.diff(at))
        pairs, held = groups.documents(row)
        numbers = groups.number.astype("<i4")
        columns = {
            "block": pa.array([block] * count, pa.int64()), "nth": pa.array(range(count), pa.int32()), "doc_id": doc_ids,
            "n_a": pa.array(np.diff(of_a)), "n_b": pa.array(np.diff(of_b)), "n_links": pa.array(links[at[1:]] - links[at[:-1]]),
            "groups": pa.array([numbers[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())}
        yield _filled(columns, count)
        yield _filled({
            "block": pa.array([block], pa.int64()), "nth": pa.array([-1], pa.int32()),
            **{name: pa.array([values.astype(kind).tobytes()], pa.binary()) for name, values, kind in (
                ("pairs", pairs, "<i8"), ("docs", held, "<i4"), ("sizes_a", groups.sizes_a, "<i4"),
                ("ids_a", groups.ids_a, "<i4"), ("sizes_b", groups.sizes_b, "<i4"), ("ids_b", groups.ids_b, "<i4"))}}, 1)
        block += 1


_STORED_ARROW = {"LongType()": pa.int64(), "IntegerType()": pa.int32(), "BinaryType()": pa.binary()}


def _filled(columns: dict[str, pa.Array], count: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns.get(f.name, pa.nulls(count, _STORED_ARROW[str(f.dataType)])) for f in _STORED.fields], _STORED.names)


class _Encoded:
    """Ids of stretches of text by both tokenizers, remembered from block to block of a task."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides, self.parted = (a, b), b.parted
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self.bad = np.zeros(0, dtype=bool)  # units whose tokens' bytes differ
        self.ids = [np.zeros(0, dtype=np.int32) for _ in self.sides]
        self.counts = [np.zeros(0, dtype=np.int64) for _ in self.sides]

    def numbers(self, units: pa.Array) -> np.ndarray:
        names = units.to_pylist()
        new = [n for n, name in enumerate(names) if name not in self._number]
        if len(self._number) + len(new) > KEPT_UNITS:
            self._forget()
            new = list(range(len(names)))
        if new:
            some = units.take(pa.array(new))
            bad = np.zeros(len(some), dtype=bool)
            for side, vocabulary in enumerate(self.sides):
                ids, counts = vocabulary.encode(some)
                bad |= vocabulary.differ(ids, counts, some)
                self.ids[side] = np.concatenate((self.ids[side], ids))
                self.counts[side] = np.concatenate((self.counts[side], counts))
            self.bad = np.concatenate((self.bad, bad))
            self._number.update(zip([names[n] for n in new], range(len(self._number), len(self._number) + len(new))))
        return np.fromiter(map(self._number.__getitem__, names), dtype=np.int64, count=len(names))


def _tokens(texts: pa.Array, encoded: _Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of both tokenizers of all texts in a row, and where each text's begin and end."""
    data, at = text_bytes(texts)
    full = np.flatnonzero(np.diff(at))
    data = np.insert(data, at[full], 32)
    at = at + np.concatenate(([0], np.cumsum(np.diff(at) > 0)))
    begin = cuttable(data, at)
    begin[1:] |= _LETTERS[data[:-1]] & encoded.parted[data[1:]]
    begin[at[full]] = True
    starts = np.flatnonzero(begin)
    units = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
    of = np.searchsorted(starts, at)  # units of text n: of[n] to of[n + 1]
    used = encoded.numbers(units.dictionary)[units.indices.to_numpy()]
    bad = encoded.bad[used]
    if bad.any():  # the whole text has no tokens
        hit = np.concatenate(([0], np.cumsum(bad)))
        drop = np.repeat(hit[of[1:]] > hit[of[:-1]], np.diff(of))
        kept = np.concatenate(([0], np.cumsum(~drop)))
        used, of = used[~drop], kept[of]
    out = []
    for ids, counts in zip(encoded.ids, encoded.counts):
        lengths = counts[used]
        out += [ids[spread((np.cumsum(counts) - counts)[used], lengths)], np.concatenate(([0], np.cumsum(lengths)))[of]]
    return tuple(out)


def group_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A, and of B, stand before the end of each group.

    Both arrays ascend and have the same last value.
    """
    a, b = ends_a.astype("<i4").tobytes(), ends_b.astype("<i4").tobytes()
    of_a, of_b = memoryview(a).cast("i"), memoryview(b).cast("i")
    size = len(of_a)
    last_a, last_b, length = array("i"), array("i"), array("i")  # runs of groups of one token each, but for the first
    i = j = 0
    while i < size:
        run, step = 0, 1
        x, y = 4 * i, 4 * j
        while x < 4 * size and a[x:x + 4 * step] == b[y:y + 4 * step]:
            run += step
            x += 4 * step
            y += 4 * step
            step *= 2
        while step > 1 and x < 4 * size:
            step //= 2
            if a[x:x + 4 * step] == b[y:y + 4 * step]:
                run += step
                x += 4 * step
                y += 4 * step
        if run:
            run = min(run, size - i)
            i += run
            j += run
            last_a.append(i)
            last_b.append(j)
            length.append(run)
            if i == size:
                break
        end_a, end_b = of_a[i], of_b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = of_a[i]
            else:
                j += 1
                end_b = of_b[j]
        i += 1
        j += 1
        last_a.append(i)
        last_b.append(j)
        length.append(1)
    lengths = np.array(length, dtype=np.int64)
    back = np.repeat(np.cumsum(lengths), lengths) - np.arange(int(lengths.sum())) - 1
    return (np.repeat(np.array(last_a, dtype=np.int64), lengths) - back,
            np.repeat(np.array(last_b, dtype=np.int64), lengths) - back)


class _Groups:
    """The different groups of a block, and which of them each group is."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray):
        sides = []
        for ids, cuts in ((ids_a, cuts_a), (ids_b, cuts_b)):
            starts = np.concatenate(([0], cuts[:-1])).astype(np.int64) if len(cuts) else np.zeros(0, np.int64)
            sides.append((ids, starts, cuts - starts))
        (_, at_a, size_a), (_, at_b, size_b) = sides
        irregular = np.flatnonzero((size_a != 1) | (size_b != 1))
        # one token beside one token: the two ids themselves
        keys = np.zeros(len(at_a), dtype=np.int64)
        if len(keys):
            keys[:] = ids_a[at_a].astype(np.int64) << 31 | ids_b[at_b]
        odd = [(ids, starts[irregular], sizes[irregular]) for ids, starts, sizes in sides]
        seed = 0
        while True:
            keys[irregular] = (self._hashes(odd, seed) | np.uint64(1 << 63)).astype(np.int64)
            self.number, named = pd.factorize(keys)
            first = np.zeros(len(named), dtype=np.int64)
            first[self.number[::-1]] = np.arange(len(keys))[::-1]
            like = first[self.number[irregular]]
            if all(self._same(ids, starts, sizes, irregular, like) for ids, starts, sizes in sides):
                break
            seed += 1  # two different groups had one hash
        (self.sizes_a, self.ids_a), (self.sizes_b, self.ids_b) = (
            (sizes[first], ids[spread(starts[first], sizes[first])]) for ids, starts, sizes in sides)
        self.links = self.sizes_a.astype(np.int64) * self.sizes_b

    @staticmethod
    def _hashes(sides: list, seed: int) -> np.ndarray:
        total = np.uint64(seed)
        for salt, (ids, starts, sizes) in enumerate(sides):
            inner = spread(np.zeros(len(sizes), dtype=np.int64), sizes)  # place within the group
            each = mixed((ids[spread(starts, sizes)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                         + mixed(inner.astype(np.uint64) * np.uint64(2) + np.uint64(salt + 1 + (seed << 32))))
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
            ends = np.cumsum(sizes)
            total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + run[ends] - run[ends - sizes])
        return total

    @staticmethod
    def _same(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, some: np.ndarray, like: np.ndarray) -> bool:
        return np.array_equal(sizes[some], sizes[like]) and np.array_equal(
            ids[spread(starts[some], sizes[some])], ids[spread(starts[like], sizes[like])])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, pair of ids (A's times 2 ** 32 plus B's), and links of the pair in the group: once each."""
        sides = []
        for ids, sizes in ((self.ids_a, self.sizes_a), (self.ids_b, self.sizes_b)):
            group = np.repeat(np.arange(len(sizes)), sizes)
            keys, times = np.unique(group << 32 | ids, return_counts=True)
            sides.append((keys >> 32, keys & 0xFFFFFFFF, times))
        (group, a, times_a), (of, b, times_b) = sides
        width = np.bincount(of, minlength=len(self.sizes_a))
        place = spread((np.cumsum(width) - width)[group], width[group])
        full = np.repeat(np.arange(len(group)), width[group])
        return group[full], a[full] << 32 | b[place], times_a[full] * times_b[place]

    def documents(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs of ids, ascending, and how many documents hold each; ``row`` is each group's document."""
        group, pair, _ = self.pairs()
        pairs, number = np.unique(pair, return_inverse=True)
        width = np.bincount(group, minlength=len(self.sizes_a))
        first = np.cumsum(width) - width
        held = pd.unique(row.astype(np.int64) << 32 | self.number)  # groups of each document, once
        document, group = held >> 32, held & 0xFFFFFFFF
        seen = number[spread(first[group], width[group])]
        once = pd.unique(np.repeat(document, width[group]) << 32 | seen)
        return pairs, np.bincount(once & 0xFFFFFFFF, minlength=len(pairs))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, docs in zip(*(batch.column(c) for c in ("block", "pairs", "docs"))):
            pair = np.frombuffer(pairs.as_buffer(), dtype="<i8")
            held = np.frombuffer(docs.as_buffer(), dtype="<i4")
            for first in range(0, len(pair), 100_000):
                some = pair[first:first + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block.as_py())), pa.array(np.arange(first, first + len(some), dtype=np.int32)),
                     pa.array((some >> 32).astype(np.int32)), pa.array((some & 0xFFFFFFFF).astype(np.int32)),
                     pa.array(held[first:first + 100_000])], ["block", "number", "a", "b", "docs"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block come in order: an answer for each of its pairs, what its numbers stand for, its documents."""
    counts, bests = [], []
    block = weight = None
    for batch in batches:
        order = batch.column("order").to_numpy()
        blocks = batch.column("block").to_numpy()
        edges = np.flatnonzero((np.diff(order) != 0) | (np.diff(blocks) != 0)) + 1
        for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
            some = batch.slice(first, last - first)
            if block != blocks[first]:
                block, counts, bests, weight = blocks[first], [], [], None
            if order[first] == 0:
                counts.append(some.column("count").to_numpy())
                bests.append(some.column("is_best").to_numpy(zero_copy_only=False))
            elif order[first] == 1:
                weight = _Weights(some, np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, bool), *bests]))
                counts, bests = [], []
            else:
                yield from weight.rows(some)


class _Weights:
    """Counts of the groups of a block, and their text."""

    def __init__(self, row: pa.RecordBatch, counts: np.ndarray, bests: np.ndarray):
        sizes_a, ids_a, sizes_b, ids_b = (
            np.frombuffer(row.column(c)[0].as_buffer(), dtype="<i4") for c in ("sizes_a", "ids_a", "sizes_b", "ids_b"))
        groups = _Groups.__new__(_Groups)
        groups.sizes_a, groups.ids_a, groups.sizes_b, groups.ids_b = sizes_a, ids_a, sizes_b, ids_b
        group, pair, times = groups.pairs()
        number = np.unique(pair, return_inverse=True)[1]
        size = len(sizes_a)
        self.total, self.best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(self.total, group, times * counts[number])
        np.add.at(self.best, group, times * bests[number])
        told_a, told_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        self.names = []
        x = y = 0
        for n, m in zip(sizes_a.tolist(), sizes_b.tolist()):
            self.names.append(f"{','.join(told_a[x:x + n])}|{','.join(told_b[y:y + m])}")
            x += n
            y += m

    def rows(self, docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        name = self.names.__getitem__
        numbers, n_groups, n_best, sums, texts, size, first = docs.column("groups"), [], [], [], [], 0, 0
        for row in range(len(docs)):
            own = np.frombuffer(numbers[row].as_buffer(), dtype="<i4")
            n_groups.append(len(own))
            n_best.append(int(self.best[own].sum()))
            sums.append(int(self.total[own].sum()))
            texts.append(";".join(map(name, own.tolist())))
            size += len(texts[-1])
            if size >= _OUT_BYTES or row + 1 == len(docs):
                some = docs.slice(first, row + 1 - first)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("n_a"), some.column("n_b"), pa.array(n_groups, pa.int64()),
                     some.column("n_links"), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), pa.array(texts, pa.string())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
                n_groups, n_best, sums, texts, size, first = [], [], [], [], 0, row + 1

"""Byte-level BPE encoding and decoding, from a file of token ranks.

Bytes are mapped to Latin-1 characters, so that one automaton holds all tokens.  A
piece of text is covered from the left by longest matches.  A token may follow another
only if the two stay as they are when their bytes are merged by rank (memoised); if no
token fits, the last one is taken back for a shorter one, and a position from which no
covering exists is not tried twice.  The covering found is the one the merges give, in
time linear in the piece.  All different pieces of a batch go through these steps side by
side, each at its own position.

Whether two neighbours stay is told from how each token was made: the last merges of both
are undone one by one, the later one first, and no merge over the border may come before
the one undone last.

What a task has built goes when it ends.  Between batches the memo of neighbours stays, in
sorted arrays of at most ``KEPT_PAIRS`` pairs, and the ids of ``KEPT_UNITS`` stretches of
text at most, words mostly: together under 100 MB.

Null and empty texts have no ids.  Texts of any length are encoded whole.  Rows with
equal ids or texts are encoded each.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from mnemoframe.llm.common import chunks, cuttable, spread, text_bytes

KEPT_PAIRS = 1_000_000  # 9 bytes each
KEPT_UNITS = 300_000  # some 200 bytes each
_CHUNK_BYTES = 4 << 20
_LATE = np.int64(1) << 40
_BETWEEN = "Ā"  # stands in no token


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def last_merges(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens that the last merge of each token joins; itself twice for one byte, -1 if no merges make it."""
    size = max(ranks.values(), default=-1) + 1
    left, right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
    for token, i in ranks.items():
        if len(token) == 1:
            left[i] = right[i] = i
            continue
        parts = [token[n:n + 1] for n in range(len(token))]
        while len(parts) > 2:
            rank, at = min((ranks.get(parts[n] + parts[n + 1], i), n) for n in range(len(parts) - 1))
            if rank >= i:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            left[i], right[i] = ranks[parts[0]], ranks[parts[1]]
    return left, right


class Encoder:
    """Exact byte-pair encoding by backtracking over longest matches."""

    def __init__(self, ranks: dict[bytes, int], merges: tuple[np.ndarray, np.ndarray], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self._left, self._right = merges
        made = np.flatnonzero((self._left >= 0) & (self._left != np.arange(len(self._left))))
        joined = self._left[made] << 32 | self._right[made]
        order = np.argsort(joined)
        self._joined, self._joins = joined[order], made[order]
        self.token = [b""] * len(self._left)
        for token, i in ranks.items():
            self.token[i] = token
        self.size = np.array([len(t) for t in self.token], dtype=np.int64)
        self._shorter = np.full(len(self.token) + 1, -1, dtype=np.int64)
        # tokens of one and two bytes are looked up in tables, longer ones found by the automaton
        self._one, self._two = np.full(257, -1, dtype=np.int64), np.full((257, 257), -1, dtype=np.int64)
        self._tokens = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in ranks.items():
            if self._left[i] < 0:
                continue
            if len(token) == 1:
                self._one[token[0]] = i
            elif len(token) == 2:
                self._two[token[0], token[1]] = i
            else:
                self._tokens.add_word(token.decode("latin-1"), i)
            self._shorter[i] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1)
                                     if token[:n] in ranks and self._left[ranks[token[:n]]] >= 0), -1)
        if len(self._tokens):
            self._tokens.make_automaton()
        self._pairs, self._stay = np.zeros(0, np.int64), np.zeros(0, bool)
        self._units: dict[str, int] = {}
        self._ids, self._counts, self._first = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def fit(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """True where merging leaves the two tokens as they are; ``last`` is -1 at the start of a piece."""
        pair = last << 32 | token
        out = last < 0
        at = np.minimum(np.searchsorted(self._pairs, pair), max(len(self._pairs) - 1, 0))
        known = self._pairs[at] == pair if len(self._pairs) else np.zeros(len(pair), dtype=bool)
        out[known] |= self._stay[at[known]]
        new = np.unique(pair[~known & ~out])
        if len(new):
            if len(self._pairs) + len(new) > KEPT_PAIRS:
                self._pairs, self._stay = self._pairs[:0], self._stay[:0]
            stay = self._stays(new >> 32, new & 0xFFFFFFFF)
            place = np.searchsorted(self._pairs, new)
            self._pairs, self._stay = np.insert(self._pairs, place, new), np.insert(self._stay, place, stay)
            rest = ~known & ~out
            out[rest] = stay[np.searchsorted(new, pair[rest])]
        return out

    def _stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.ones(len(left), dtype=bool)
        open_ = np.arange(len(left))
        before = np.full(len(left), _LATE)  # merges over the border from this rank on come too late
        while len(open_) and len(self._joined):
            pair = left << 32 | right
            at = np.minimum(np.searchsorted(self._joined, pair), len(self._joined) - 1)
            merged = (self._joined[at] == pair) & (self._joins[at] < before)
            out[open_[merged]] = False
            later = left > right
            inner, outer = self._right[left], self._left[right]
            byte_l, byte_r = inner == left, outer == right
            undo_l = (later & ~byte_l) | (~later & byte_r & ~byte_l)
            undo_r = ~undo_l & ~byte_r
            before = np.where(undo_l, left, right + 1)
            go = ~merged & (undo_l | undo_r)
            left, right = np.where(undo_l, inner, left)[go], np.where(undo_r, outer, right)[go]
            before, open_ = before[go], open_[go]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        rest = np.flatnonzero(whole < 0)
        ids, counts = self._covered([pieces[n] for n in rest.tolist()])
        total = np.ones(len(pieces), dtype=np.int64)
        total[rest] = counts
        out = np.empty(int(total.sum()), dtype=np.int32)
        starts = np.cumsum(total) - total
        out[starts[whole >= 0]] = whole[whole >= 0]
        out[spread(starts[rest], counts)] = ids
        return out, total

    def _covered(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = _BETWEEN.join(p.decode("latin-1") for p in pieces) + _BETWEEN
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        code = np.frombuffer(text.encode("utf-16-le"), dtype=np.uint16)
        longest = self._one[code]
        two = self._two[code[:-1], code[1:]]
        longest[:-1][two >= 0] = two[two >= 0]
        matches = self._tokens.iter(text) if len(self._tokens) else ()
        found = np.fromiter(chain.from_iterable(matches), dtype=np.int64).reshape(-1, 2)
        # of one start, later ends are longer and come later
        longest[found[:, 0] + 1 - self.size[found[:, 1]]] = found[:, 1]
        del found
        chosen, before = np.full(len(text), -1, dtype=np.int64), np.full(len(text), -1, dtype=np.int64)
        dead = np.zeros(len(text), dtype=bool)
        at, end, last, token = starts.copy(), ends, np.full(len(pieces), -1, dtype=np.int64), longest[starts]
        while len(at):
            found = token >= 0
            ahead = at + np.where(found, self.size[token], 0)
            good = found & ~dead[ahead]
            good[good] = self.fit(last[good], token[good])
            back = ~found
            if back.any():  # take the last token back for a shorter one
                if (last[back] < 0).any():
                    raise ValueError("no tokens cover a piece")
                dead[at[back]] = True
                previous = at[back] - self.size[last[back]]
                chosen[previous] = -1
            chosen[at[good]], before[at[good]] = token[good], last[good]
            token = np.where(good, longest[ahead], np.where(found, self._shorter[token], self._shorter[last]))
            at[back], after = at[back] - self.size[last[back]], np.where(good, token, 0)
            last = np.where(good, chosen[at], last)
            last[back] = before[at[back]]
            at = np.where(good, ahead, at)
            on = at < end
            at, end, last, token = at[on], end[on], last[on], token[on]
        counts = np.add.reduceat((chosen >= 0).astype(np.int64), starts)
        return chosen[chosen >= 0].astype(np.int32), counts

    def encode(self, texts: pa.Array, by_space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end.

        ``by_space``: a piece ends before each space that follows no white space, and between a
        letter and a mark; what lies between such places is split once for all its occurrences.
        """
        data, at = text_bytes(texts)
        begin = _parts(data, at) if by_space else np.zeros(len(data), dtype=bool)
        begin[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(begin)
        units = pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        number = self._known(units.dictionary.to_pylist())
        used = number[units.indices.to_numpy()]
        lengths = self._counts[used]
        of = np.searchsorted(starts, at)
        return self._ids[spread(self._first[used], lengths)], np.concatenate(([0], np.cumsum(lengths)))[of]

    def _known(self, units: list[str]) -> np.ndarray:
        """Numbers of the units; the ids of unit n are those from ``_first[n]`` on, ``_counts[n]`` of them."""
        new = [unit for unit in units if unit not in self._units]
        if len(self._units) + len(new) > KEPT_UNITS:
            self._units, self._ids, self._counts, new = {}, self._ids[:0], self._counts[:0], units
        if new:
            parts = [self.split(unit) for unit in new]
            held = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            ids, counts = self.encode_pieces([p.encode() for p in chain.from_iterable(parts)])
            run, ends = np.concatenate(([0], np.cumsum(counts))), np.cumsum(held)
            self._units.update(zip(new, range(len(self._units), len(self._units) + len(new))))
            self._ids = np.concatenate((self._ids, ids))
            self._counts = np.concatenate((self._counts, run[ends] - run[ends - held]))
            self._first = np.cumsum(self._counts) - self._counts
        return np.fromiter(map(self._units.__getitem__, units), dtype=np.int64, count=len(units))


_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


def _parts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where a piece begins whatever stands around: spaces after no white space, marks after letters."""
    out = cuttable(data, at)
    out[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    return out


class Decoder:
    """Bytes of ids."""

    def __init__(self, token: list[bytes]):
        self.size = np.array([len(t) for t in token], dtype=np.int64)
        self._first = np.cumsum(self.size) - self.size
        self._bytes = np.frombuffer(b"".join(token), dtype=np.uint8)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The bytes of each row; ids of row n are ``ids[at[n]:at[n + 1]]``."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id that the rank file does not have")
        sizes = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))[at]
        data = self._bytes[spread(self._first[ids], sizes)]
        return pa.Array.from_buffers(
            pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Rows ``doc_id, ids array<int>`` for each row of ``docs`` (``doc_id, text``).

    ``path`` is the rank file, a part of the installation of every machine; ``pattern``
    splits a text into the pieces that are encoded one by one.  With ``decoded``, the bytes
    that the ids decode to are added in the same pass.
    """
    merges = last_merges(read_ranks(path))
    by_space = pattern == public_tokenizers.PATTERN  # other patterns might not start a piece there
    fields = [docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    if decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Encoder(read_ranks(path), merges, pattern)
        back = Decoder(made.token)
        for batch in chunks(batches, most=_CHUNK_BYTES):
            ids, at = made.encode(batch.column("text"), by_space)
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))]
            if decoded:
                columns.append(back.decode(ids, at))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (``doc_id, ids``) with ``decoded``, the bytes of the ids.

    Ids that the rank file does not have raise an error; null ids decode to no bytes.
    """
    schema = T.StructType([*encoded.select("doc_id", "ids").schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        token = [b""] * (max(ranks.values(), default=-1) + 1)
        for some, i in ranks.items():
            token[i] = some
        made = Decoder(token)
        for batch in batches:
            for first in range(0, len(batch), 256):
                rows = batch.slice(first, 256)
                column = rows.column("ids")
                ids = column.flatten().to_numpy(zero_copy_only=False)
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), column, made.decode(ids, np.concatenate(([0], np.cumsum(sizes))))],
                    ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)

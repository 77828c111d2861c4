"""License statements in texts: an exact set-similarity join of text blocks with templates.

Words are runs of letters, digits and characters outside ASCII, A-Z in lower case.  A
template of ``w`` words meets the blocks of ``2 w`` words that start at every ``w``-th word
of a document, so that each stretch of ``w`` words lies whole in one of them.  A block is
found if it holds at least ``share`` of the template's different words (containment).

The words of all templates are ordered by how often the whole corpus has them, rarest
first, and blocks are seen as sets of those.  For a template of ``n`` different words, of
which ``c`` must be met:

* prefix: only blocks with one of the template's ``n - c + 1`` rarest words are candidates;
* length: a candidate has at least ``c`` words of the templates;
* position: from the first prefix word that they share, both the template and the block
  have enough words left to share ``c``;
* what remains is counted, and its words are compared as text, so equal hashes do not count.

A template with ``phrase`` set is joined the same way with all its words asked, then its
words must stand one after another; places are counted in the block whose first half
holds their start, so each once.

Null and empty texts have no words and no finds.  Texts are scanned whole, whatever their
length.  Rows with equal ids or texts are scanned each.  An empty table gives an empty
result; a table without any template word has no order to speak of and no finds.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mnemoframe.llm.common import Words, chunks

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
MOST_TEMPLATE_WORDS = 1_000_000  # of all templates together; they travel with each task


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    share: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return _words(self.text)

    def asked(self) -> int:
        """How many of the different words a block must hold."""
        count = len(set(self.words))
        return count if self.phrase else max(1, math.ceil(round(self.share * count, 9)))


def _words(text: str) -> list[str]:
    found = Words(pa.array([text]), lower=True, inside=_INSIDE)
    data = found.data.tobytes()
    return [data[a:b].decode() for a, b in zip(found.starts, found.ends)]


# Phrases whose places are counted
PHRASES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
)

STATEMENTS = (
    Template("apache-2.0", "licensed under the Apache License, Version 2.0"),
    Template("mit", "released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files, to deal in the software without restriction"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("lgpl", "licensed under the GNU Lesser General Public License, version 2.1"),
    Template("mpl-2.0", "this source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0"),
    Template("cc0", "dedicated to the public domain under CC0 1.0 universal"),
)

_FOUND = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first", T.LongType()),
    T.StructField("last", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("phrase", T.BooleanType())])
_ARROW = pa.list_(pa.struct([
    ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64()), ("phrase", pa.bool_())]))


class _Index:
    """The templates' words in their global order, found by hash in batches of words."""

    def __init__(self, templates: tuple[Template, ...], order: list[str]):
        self.templates, self.order = templates, order
        self.words = [t.words for t in templates]
        listed = Words(pa.array(order, pa.string()), inside=np.ones(256, dtype=bool))
        hashes = listed.hashes() if order else np.zeros(0, np.uint64)
        self._by_hash = np.argsort(hashes)
        self._hashes = hashes[self._by_hash]
        rank = {word: n for n, word in enumerate(order)}
        self.ranks = [np.array(sorted({rank[w] for w in words}), dtype=np.int64) for words in self.words]
        self.prefixes = [r[:len(r) - t.asked() + 1] for t, r in zip(templates, self.ranks)]

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the batch's words that a template has, and their ranks."""
        if not len(self._hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        places = np.flatnonzero(self._hashes[at] == hashes)
        return places, self._by_hash[at[places]]


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + STATEMENTS) -> DataFrame:
    """Rows ``doc_id, n_words, found`` for each row of ``docs``.

    ``found`` lists, by label and first word, each place of a phrase and each block that
    meets a template: words ``first`` to ``last`` of the text, ``last`` exclusive, with
    the ``share`` of the template's words that it holds.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    number = {w: n for n, w in enumerate(vocabulary)}
    if not all(t.words for t in templates):
        raise ValueError("a template without words")
    if sum(len(t.words) for t in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have over {MOST_TEMPLATE_WORDS} words")
    counted = {r["rank"]: r["times"] for r in _counts(docs, _Index((), vocabulary)).collect()}  # a row a template word
    order = sorted(vocabulary, key=lambda w: (counted.get(number[w], 0), w))
    index = _Index(tuple(templates), order)
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(_FOUND))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"), lower=True, inside=_INSIDE)
            finds: list[list[dict]] = [[] for _ in range(len(batch))]
            for row, find in _found(words, index):
                finds[row].append(find)
            for some in finds:
                some.sort(key=lambda f: (f["label"], f["first"], f["last"], f["share"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(finds, _ARROW)],
                ["doc_id", "n_words", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _counts(docs: DataFrame, index: _Index) -> DataFrame:
    """How often the corpus has each word of the templates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.order), dtype=np.int64)
        for batch in chunks(batches):
            _, ranks = index.hits(Words(batch.column("text"), lower=True, inside=_INSIDE))
            total += np.bincount(ranks, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["rank", "times"])

    return docs.select("text").mapInArrow(run, "rank long, times long").groupBy("rank").agg(F.sum("times").alias("times"))


def _found(words: Words, index: _Index) -> Iterator[tuple[int, dict]]:
    """``(row, find)`` for all phrases and blocks of a batch."""
    places, ranks = index.hits(words)
    rows = np.searchsorted(words.first, places, side="right") - 1
    inner = places - words.first[rows]  # number of the word in its text
    data = words.data.tobytes()

    def text_of(first: int, last: int) -> list[str]:
        return [data[words.starts[n]:words.ends[n]].decode() for n in range(first, last)]

    for template, listed, own, prefix in zip(index.templates, index.words, index.ranks, index.prefixes):
        asked = template.asked()
        width = len(listed)
        for row, block in _joined(rows, inner, ranks, own, prefix, asked, width):
            low = int(words.first[row]) + block * width
            high = min(low + 2 * width, int(words.first[row + 1]))
            held = text_of(low, high)
            if template.phrase:
                for at in range(min(width, len(held) - width + 1)):
                    if held[at:at + width] == listed:
                        first = block * width + at
                        yield row, {"label": template.label, "first": first, "last": first + width, "share": 1.0, "phrase": True}
                continue
            shared = len(set(held) & set(listed))
            if shared >= asked:
                yield row, {"label": template.label, "first": block * width, "last": block * width + high - low,
                            "share": shared / len(own), "phrase": False}


def _joined(rows: np.ndarray, inner: np.ndarray, ranks: np.ndarray, own: np.ndarray, prefix: np.ndarray,
            asked: int, width: int) -> Iterator[tuple[int, int]]:
    """``(row, block)`` of the blocks that pass the filters and hold ``asked`` of the ranks ``own``."""
    in_prefix = np.isin(ranks, prefix)
    if not in_prefix.any():
        return
    near = np.isin(rows, rows[in_prefix])  # the rest of the batch has no candidate
    rows, inner, ranks, in_prefix = rows[near], inner[near], ranks[near], in_prefix[near]
    span = int(inner.max()) // width + 1

    def blocks(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of each block that holds each of these words, and the word's place among ``some``."""
        number = inner[some] // width
        key = rows[some] * span + number
        earlier = np.flatnonzero(number > 0)
        return np.concatenate((key, key[earlier] - 1)), np.concatenate((np.arange(len(some)), earlier))

    candidates = np.unique(blocks(np.flatnonzero(in_prefix))[0])
    key, at = blocks(np.arange(len(ranks)))
    held = np.isin(key, candidates)
    count = int(ranks.max()) + 1
    pairs = np.unique(key[held] * count + ranks[at[held]])  # sets, in global order of words
    key, rank = pairs // count, pairs % count
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    long_enough = sizes >= asked
    # the first prefix word of each block: its place in the block and in the template
    place = np.arange(len(key)) - np.repeat(starts, sizes)
    first = np.minimum.reduceat(np.where(np.isin(rank, prefix), place, len(key)), starts)
    in_own = np.searchsorted(own, rank[np.minimum(starts + first, len(rank) - 1)])
    enough_left = np.minimum(sizes - first, len(own) - in_own) >= asked
    shared = np.add.reduceat(np.isin(rank, own).astype(np.int64), starts)
    for found in key[starts[long_enough & enough_left & (shared >= asked)]].tolist():
        yield found // span, found % span

"""Token ids in length-delimited binary files, with an offset index for shuffled reads.

A part file is a row of records, each framed as

    length of the payload   unsigned 64-bit
    masked crc32 of these eight bytes   unsigned 32-bit
    payload
    masked crc32 of the payload   unsigned 32-bit

all little-endian; masking turns a checksum by 15 bits and adds a constant, so that
checksums of data that hold checksums stay useful.  A payload is the document id
(signed 64-bit, with a flag byte that says if it is null) and the ids, two or four bytes
each.  Beside each part lies an index of 20-byte entries: id, place of its record in the
part, number of ids.  ``manifest.json`` lists the parts in ascending order of document
ids, with the number of ids before each; it is written last, when all parts are there.

Parts have names of their own for each attempt, so that a repeated task never meets what
a lost one has left; only parts in the manifest count.  Null and empty texts give a
record with the end id alone.  Rows with equal ids keep a record each.  A table without
rows gives a manifest without parts.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage)

from mnemoframe.llm.common import chunks, parallelism, place, range_starts, text_bytes

FORMAT = "token_records"
_HEAD = struct.Struct("<QI")
_OWN = struct.Struct("<?q")
_TAIL = struct.Struct("<I")
_ENTRY = struct.Struct("<qQI")
_MASK = 0xA282EAD8
_KEPT_WORDS = 800_000  # distinct words remembered by a worker; more cost time only


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _TAIL.pack(masked_crc(size)), payload, _TAIL.pack(masked_crc(payload))))


def unframed(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at a place, and the place after it; checks both sums."""
    size, crc = _HEAD.unpack_from(data, at)
    end = at + _HEAD.size + size
    if masked_crc(data[at:at + 8]) != crc or end + _TAIL.size > len(data):
        raise ValueError(f"damaged record length at {at}")
    payload = data[at + _HEAD.size:end]
    if masked_crc(payload) != _TAIL.unpack_from(data, end)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, end + _TAIL.size


@dataclass
class Part(WriterCommitMessage):
    name: str
    least: tuple[bool, int]  # the first id; null comes before all others
    records: int
    tokens: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder)
        name = f"part-{uuid.uuid4().hex}"
        part = Part(name, (False, 0), 0, 0)
        at = 0
        with (store.open_output_stream(f"{folder}/{name}.records") as records,
              store.open_output_stream(f"{folder}/{name}.index") as index):
            for batch in iterator:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    ids = ids.as_py()
                    own = (doc_id is not None, doc_id or 0)
                    count = len(ids) // self.width
                    if not part.records:
                        part.least = own
                    record = framed(_OWN.pack(*own) + ids)
                    records.write(record)
                    index.write(_ENTRY.pack(own[1], at, count))
                    at += len(record)
                    part.records += 1
                    part.tokens += count
        return part

    def commit(self, messages: list[Part | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder)
        before, parts = 0, []
        for part in sorted((p for p in messages if p and p.records), key=lambda p: p.least):
            parts.append({"name": part.name, "records": part.records, "tokens": part.tokens, "start": before})
            before += part.tokens
        with store.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"width": self.width, "tokens": before, "parts": parts}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        for part in filter(None, messages):
            for kind in ("records", "index"):
                store.delete_file(f"{folder}/{part.name}.{kind}")


@dataclass
class _Read(InputPartition):
    name: str
    start: int
    width: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Read]:
        store, folder = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{folder}/manifest.json") as source:
            manifest = json.loads(source.read())
        return [_Read(p["name"], p["start"], manifest["width"]) for p in manifest["parts"]] or [_Read("", 0, 2)]

    def read(self, partition: _Read) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{folder}/{partition.name}.index") as source:
            entries = np.frombuffer(source.read(), dtype=[("doc_id", "<i8"), ("at", "<u8"), ("count", "<u4")])
        start = partition.start
        with store.open_input_file(f"{folder}/{partition.name}.records") as source:
            for first in range(0, len(entries), 512):
                some = entries[first:first + 512]
                low = int(some["at"][0])
                high = int(entries["at"][first + 512]) if first + 512 < len(entries) else source.size()
                source.seek(low)
                data = memoryview(source.read(high - low))
                doc_ids, starts, ids, at = [], [], [], 0
                for count in some["count"]:
                    payload, at = unframed(data, at)
                    known, doc_id = _OWN.unpack_from(payload)
                    found = np.frombuffer(payload[_OWN.size:], f"<u{partition.width}")
                    if len(found) != count:
                        raise ValueError("index and records differ")
                    doc_ids.append(doc_id if known else None)
                    starts.append(start)
                    ids.append(found.astype("<u4").tobytes())
                    start += int(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "ids"])


class TokenRecords(DataSource):
    """``format("token_records")``: writes ``doc_id, ids binary``, reads ``doc_id, start, ids``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids binary"

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options["width"]))


class WordTokenizer:
    """Ids of a tokenizer file that drops white space: words are encoded once and remembered.

    White space always ends a token of such a file, so a text's ids are those of its
    words in a row.  A text that holds the name of an added token, as ``<|endoftext|>``, is left to
    the library whole: it gives the name one id, also inside a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer  # after the setting above

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        # the ids of word n are ids[starts[n]:starts[n] + sizes[n]]
        self._number: dict[str, int] = {}
        self._ids, self._sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        ids, sizes = [self._ids], [self._sizes]
        for first in range(0, len(words), 20_000):
            some = words[first:first + 20_000]
            made = self._tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(made.ids, dtype=np.uint32))
            sizes.append(np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(some)).astype(np.int32))
        self._number.update(zip(words, range(len(self._number), len(self._number) + len(words))))
        self._ids, self._sizes = np.concatenate(ids), np.concatenate(sizes)
        self._starts = np.cumsum(self._sizes, dtype=np.int32) - self._sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin and end."""
        named = np.zeros(len(texts), dtype=bool)
        for name in self._added:
            found = pc.match_substring(texts, name, ignore_case=True)
            named |= found.fill_null(False).to_numpy(zero_copy_only=False)
        if not named.any():
            return self._encode_words(texts)
        plain = pa.array(~named)
        ids, at = self._encode_words(pc.if_else(plain, texts, pa.scalar("", texts.type)))
        counts, places = np.diff(at), at[:-1]
        extra = [np.array(self._tokenizer.encode(texts[n].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
                 for n in np.flatnonzero(named).tolist()]
        sizes = np.array([len(e) for e in extra], dtype=np.int64)
        counts[named] = sizes
        ids = np.insert(ids, np.repeat(places[named], sizes), np.concatenate(extra))
        return ids, np.concatenate(([0], np.cumsum(counts)))

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(_parted(texts))
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self._number) + len(names) > _KEPT_WORDS:
            self._forget()
        known = self._number
        new = [w for w in names if w not in known]
        if new:
            self._learn(new)
        number = np.fromiter(map(known.__getitem__, names), dtype=np.int32, count=len(names))
        used = words.indices.to_numpy()
        lengths = self._sizes[number][used]
        ends = np.cumsum(lengths, dtype=np.int32)
        place = np.repeat(self._starts[number][used] - ends + lengths, lengths)
        place += np.arange(len(place), dtype=np.int32)
        at = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        return self._ids[place], np.concatenate(([0], ends)).astype(np.int64)[at]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


def _parted(texts: pa.Array) -> pa.Array:
    """The texts in lower case (of A-Z), with a space between a letter and a mark after it.

    Such a file ignores case and never joins the two, so the ids are the same; there are
    fewer different words.  An apostrophe may belong to the letters and stays.
    """
    data, at = text_bytes(texts)
    data = _LOWER[data]
    gap = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        gap[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
    gap[at] = False
    places = np.flatnonzero(gap)
    moved = (at + np.searchsorted(places, at)).astype(np.int32)
    return pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(moved), pa.py_buffer(np.insert(data, places, 32)))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def encode(docs: DataFrame, path: str, end_id: int, width: int = 2) -> DataFrame:
    """Rows ``doc_id, ids binary``: ids of each text and the end id, ``width`` bytes each.

    ``width`` must hold the largest id of the tokenizer file.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _tokenizer(path)
        for batch in chunks(batches, most=8 << 20):  # words repeat more in longer stretches
            ids, at = made.encode(batch.column("text"))
            if len(ids) and int(ids.max()) >= 1 << 8 * width:
                raise ValueError(f"an id does not fit in {width} bytes")
            full = np.insert(ids, at[1:], end_id).astype(f"<u{width}")
            ends = (at + np.arange(len(at))) * width
            column = pa.Array.from_buffers(
                pa.large_binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(full)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), column.cast(pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def write(encoded: DataFrame, path: str, keys: DataFrame, width: int = 2) -> None:
    """Write rows ``doc_id, ids binary`` in ascending order of ``doc_id``, one part a task.

    Rows go to parts by ranges of ids that hold about as many rows each; ``keys`` has the
    same ``doc_id`` values and is read for the ranges, so that nothing is encoded twice.
    """
    spark = encoded.sparkSession
    spark.dataSource.register(TokenRecords)
    parts = parallelism(spark)
    starts = range_starts(keys, "doc_id", parts)
    part = place(F.col("doc_id"), starts)
    (encoded.withColumn("part", F.coalesce(part, F.lit(0)).cast("int"))
     .repartitionById(max(1, len(starts)), F.col("part"))
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
     .select("doc_id", "ids")
     .write.format(FORMAT).mode("append").option("path", path).option("width", width).save())


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, ids``: ids as little-endian unsigned 32-bit integers; ``start`` counts
    the ids of all documents before."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format(FORMAT).option("path", path).load()

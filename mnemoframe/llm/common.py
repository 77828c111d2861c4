"""Helpers shared by the training-data operators: tables, shared storage, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session may go without: it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: later plans start there.

    What the job has shuffled is of no more use; Spark deletes it once the driver's JVM
    has collected its handles, which it is asked to do.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def range_starts(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts`` values of the column, ascending, that cut its rows evenly.

    The first is the smallest value.  Empty for a table without values.
    """
    cuts = [i / parts for i in range(parts)]
    row = df.select(
        F.min(column).alias("least"),
        F.percentile_approx(column, cuts, 10 * parts + 1000).alias("cuts")).first()
    return sorted({row["least"], *row["cuts"]}) if row["least"] is not None else []


def place(value: Column, starts: list) -> Column:
    """Number of the range that holds a value: how many of the sorted starts after the first
    are at or below it."""
    return _halved(value, starts[1:], 0)


def _halved(value: Column, cuts: list, before: int) -> Column:
    if not cuts:
        return F.lit(before)
    half = len(cuts) // 2
    return F.when(value < F.lit(cuts[half]), _halved(value, cuts[:half], before)).otherwise(
        _halved(value, cuts[half + 1:], before + half + 1))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = _CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.schema.get_field_index(column)
        ends = _offsets(batch.column(place))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[
        texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the row limits in them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    at = _offsets(texts)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def cuttable(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True at spaces inside a text that follow no white space and do not end the text.

    A character that might be white space in some version of Unicode counts as such.
    """
    out = data == 32
    back = [np.concatenate((np.zeros(n, np.uint8), data[:-n])) if len(data) > n else np.zeros(len(data), np.uint8)
            for n in (1, 2, 3)]
    out &= (back[0] > 32) & (back[0] != 127)
    out &= ~((back[1] == 0xC2) & ((back[0] == 0x85) | (back[0] == 0xA0)))
    out &= ~((back[2] == 0xE2) & ((back[1] == 0x80) | (back[1] == 0x81)))
    out &= ~((back[2] == 0xE1) & ((back[1] == 0x9A) | (back[1] == 0xA0)))
    out &= ~((back[2] == 0xE3) & (back[1] == 0x80)) & ~((back[2] == 0xEF) & (back[1] == 0xBB))
    if len(out):
        out[at[:-1][np.diff(at) > 0]] = False
        out[at[1:][np.diff(at) > 0] - 1] = False
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each, in a row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Words:
    """Words (runs without ASCII white space, or of the bytes given) of a batch of texts.

    ``starts`` and ``ends`` are byte positions in ``data``; words of row r have the
    numbers ``first[r]`` to ``first[r + 1]``, end exclusive; its bytes begin at ``at[r]``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, inside: np.ndarray = ~_SEPARATOR):
        self.data, at = text_bytes(texts)
        self.at = at
        inside = inside[self.data]
        cut = np.zeros(len(self.data) + 1, dtype=bool)
        cut[at] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, at)
        if lower:
            capital = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + capital.astype(np.uint8) * np.uint8(32)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes in all batches."""
        power, inverse = _powers(len(self.data))
        running = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power, out=running[1:])
        return mixed((running[self.ends] - running[self.starts]) * inverse[self.starts])


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _CHUNK_BYTES + (1 << 16))
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position; of what is left at the end too few."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        total = (total + words[i:i + count]) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(total)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For actions within: hand wide rows to Python few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)

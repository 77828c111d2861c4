"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and clean documents under Dirichlet
priors, less a shift that makes ordinary text lose.  One scan over a text finds all
maximal segments of positive score.  Segment scores are calibrated as extreme values
(Karlin and Altschul): ``lambda`` from the token scores of clean text, ``K`` from the
best segments of clean documents.  What a document's segments have above chance for its
length is summed, and a logistic curve turns the sum into a score.

Null and empty texts have no segment and get the score of a document without one, and
equal texts get equal scores.  Without labels of both kinds all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mnemoframe.llm.common import Words, chunks, fold, store

SAMPLE = 20_000  # labelled rows that are learned from, by the order of a hash of the id
SLOTS = 1 << 18
PRIOR = 10.0  # tokens that the prior counts for, shared as the classes are
SHIFT = 0.5
ERRORS = 2.0
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    scores: np.ndarray  # by slot
    rate: float  # lambda
    size: float  # K
    curve: np.ndarray  # offset and slopes of the logistic curve

    def chance(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + found @ self.curve[1:], -30, 30)))


def _tokens(texts: pa.Array) -> tuple[Words, np.ndarray]:
    words = Words(texts, lower=True, inside=_TOKEN)
    return words, (words.hashes() % np.uint64(SLOTS)).astype(np.int64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in one scan (Ruzzo and Tompa)."""
    running = np.cumsum(scores)
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    for at in np.flatnonzero(scores > 0).tolist():
        high = float(running[at])
        start, low = at, high - float(scores[at])
        while True:
            place = len(held) - 1
            while place >= 0 and held[place][2] >= low:
                place -= 1
            if place < 0 or held[place][3] >= high:
                break
            start, low = held[place][0], held[place][2]
            del held[place:]
        held.append((start, at + 1, low, high))
    return [(start, end, high - low) for start, end, low, high in held]


def _found(scores: np.ndarray, rate: float, size: float) -> tuple[float, float, list]:
    """Sum over the segments above chance, the best one, and those segments."""
    level = np.log(max(size, 1e-12) * max(len(scores), 1))
    each = [(a, b, rate * s - level) for a, b, s in segments(scores)]
    above = [x for x in each if x[2] > 0]
    return sum(x[2] for x in above), max((x[2] for x in each), default=-level), above


def _inputs(total: float, best: float) -> tuple[float, float]:
    return np.log1p(total), np.clip(best, -5, 5)


def token_counts(labelled: DataFrame) -> DataFrame:
    """Rows ``slot, label, n``: documents of ``labelled`` (``text, label``) by hashed token.

    A token counts once a document, so that one text does not make its words telling.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, slot = _tokens(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            once = np.unique(row * SLOTS + slot)
            label = batch.column("label").to_numpy()[once // SLOTS]
            key, n = np.unique(once % SLOTS * 2 + label, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(key & 1), pa.array(n)], ["slot", "label", "n"])

    return labelled.select("text", "label").mapInArrow(run, "slot long, label long, n long").groupBy(
        "slot", "label").agg(F.sum("n").alias("n"))


def segment_features(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """``docs`` (``key, text``) with ``total``, ``best`` and, if asked for, the passages above chance.

    A passage is a range of bytes of the UTF-8 text with its score.
    """
    fields = [docs.schema["key"], T.StructField("total", T.DoubleType()), T.StructField("best", T.DoubleType()),
              T.StructField("tokens", T.LongType())]
    if passages:
        fields.append(T.StructField("passages", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType())]))))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, slot = _tokens(batch.column("text"))
            score = model.scores[slot].astype(np.float64)
            rows = []
            for a, b, origin in zip(words.first[:-1], words.first[1:], words.at[:-1]):
                total, best, above = _found(score[a:b], model.rate, model.size)
                rows.append((total, best, int(b - a), [
                    {"start": int(words.starts[a + i] - origin), "end": int(words.ends[a + j - 1] - origin), "score": s}
                    for i, j, s in above]))
            columns = [batch.column("key"), *(
                pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int64())))]
            if passages:
                columns.append(pa.array([r[3] for r in rows], pa.list_(pa.struct([
                    ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("key", "text").mapInArrow(run, schema)


def fit(labelled: DataFrame) -> Model | None:
    """Fit on rows ``text, label, part`` (a bounded sample): token scores on parts 1 to 3, the
    calibration on part 4, whose documents the token scores have not seen."""
    counts = np.zeros((2, SLOTS))
    for row in token_counts(labelled.filter("part < 4")).toArrow().to_pylist():
        counts[row["label"], row["slot"]] = row["n"]
    both = counts.sum(1)
    if not both.all():
        return None
    prior = PRIOR * both / both.sum()
    odds = np.log((counts[1] + prior[1]) / (both[1] + PRIOR - counts[1])) - np.log(
        (counts[0] + prior[0]) / (both[0] + PRIOR - counts[0]))
    # what the log-odds are at least, by their standard error: rare tokens tell little
    error = np.sqrt(1 / (counts[1] + prior[1]) + 1 / (counts[0] + prior[0]))
    scores = (np.where(odds > 0, np.maximum(odds - ERRORS * error, 0), odds) - SHIFT).astype(np.float32)
    share = counts[0] / both[0]
    rate = _rate(share, scores)
    model = Model(scores, rate, 1.0, np.zeros(3))
    keyed = labelled.filter("part = 4").withColumn("key", F.col("label").cast("long"))
    rows = segment_features(keyed, model).toArrow()
    label, best = rows["key"].to_numpy(), rows["best"].to_numpy()
    clean = label == 0
    if clean.any():  # mean of an extreme value: log(K n) / lambda and Euler's constant
        model.size = float(np.exp(best[clean].mean() - 0.5772))
    rows = segment_features(keyed, model).toArrow().to_pydict()
    order = np.lexsort((rows["best"], rows["total"], rows["key"]))
    label = np.array(rows["key"])[order]
    x = np.array([_inputs(t, b) for t, b in zip(rows["total"], rows["best"])]).reshape(-1, 2)[order]
    model.curve = _logistic(x, label, both[1] / both.sum())
    return model


def _rate(share: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1, by halving."""
    used = share > 0
    low, high = 1e-3, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        if (share[used] * np.exp(np.minimum(middle * scores[used], 500))).sum() > 1:
            high = middle
        else:
            low = middle
    return low


def _logistic(x: np.ndarray, label: np.ndarray, share: float) -> np.ndarray:
    """Offset and non-negative slopes of a lightly penalised logistic curve (Newton steps)."""
    design = np.column_stack([np.ones(len(x)), x])
    curve = np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0])
    if len(set(label.tolist())) < 2:
        return np.array([curve[0], 1.0, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ curve, -30, 30)))
        slope = design.T @ (p - label) + 0.1 * np.array([0, *curve[1:]])
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(3)
        curve = curve - np.linalg.solve(bend, slope)
        curve[1:] = np.maximum(curve[1:], 0)
    return curve


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """Learn from at most ``most`` labelled documents that are not held out.

    A label that is null is no label.  The sample is bounded, so its ids go to all tasks.
    """
    rated = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("long").alias("label")).filter(
        (fold(F.col("doc_id")) != 0) & F.col("label").isNotNull() & F.col("id").isNotNull())
    rated = rated.orderBy(F.xxhash64("id"), "id", "label").limit(most)
    return fit(store(
        docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("id"))
        .groupBy(F.coalesce("text", F.lit("")).alias("text"))  # copies count once
        .agg(F.max((F.col("label") > 0).cast("long")).alias("label"), F.min(fold(F.col("id"))).alias("part")),
        "labelled"))


def rate_documents(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted, passages`` for each row of ``docs`` (``doc_id, text``)."""
    model = learn(docs, labels, most)
    held_out = (fold(F.col("key")) == 0).alias("held_out")
    keyed = docs.select(F.col("doc_id").alias("key"), "text")
    if model is None:
        return keyed.select(
            F.col("key").alias("doc_id"), held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
            F.expr("cast(array() as array<struct<start: bigint, end: bigint, score: double>>)").alias("passages"))
    a, b, c = (float(v) for v in model.curve)
    score = 1 / (1 + F.exp(-(a + b * F.log1p("total") + c * F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("best"))))))
    return (
        segment_features(keyed, model, passages=True)
        .withColumn("score", score)
        .select(F.col("key").alias("doc_id"), held_out, "score",
                (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"))

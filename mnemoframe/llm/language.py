"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a linear classifier over hashed byte n-grams
predicts each bit.  A text gets the language with the least loss summed over the bits,
weighted by how well each bit is predicted, and is flagged if the two best are close.

Null texts and texts without a letter get ``und`` and score 0.  Equal texts get equal
predictions.  Without a labelled row all texts get ``und``; with one language, that one.
Texts are used whole, whatever their length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mnemoframe.llm.common import chunks, fold, text_bytes

SAMPLE = 1200  # labelled rows that the classifiers are fitted on, the same number of each language
SLOTS = 4096
ORDERS = (2, 3, 4)
RIDGE = 0.02
KEPT = 0.999  # share of the labelled texts of a size that the highest loss has to spare
LEAST_LOSS = float(np.log(2)) / 2  # and half the loss of bits that say nothing, at least
LEAST_SUPPORT = 20  # labelled texts of a size that set a level for texts of this size or more
CLOSE = 0.2  # probability between the best and the next below which a text is ambiguous
UNKNOWN = "und"
_ROWS = 512
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # slots x bits
    offsets: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    sharpness: float

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return self.decoded(self.losses(features))

    def losses(self, features: np.ndarray) -> np.ndarray:
        """Loss of each language's codeword."""
        return self.lost(features @ self.weights + self.offsets)

    def lost(self, margins: np.ndarray) -> np.ndarray:
        return np.stack([np.logaddexp(0, -self.sharpness * margins * code) @ self.trust for code in self.codes], 1)

    def decoded(self, loss: np.ndarray) -> np.ndarray:
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        return chance / chance.sum(1, keepdims=True)


def codewords(count: int) -> np.ndarray:
    """All splits of the languages in two for up to seven; random ones for more."""
    if count <= 7:
        rest = itertools.product((-1, 1), repeat=count - 1)
        return np.array([(1, *r) for r in rest if -1 in r], dtype=float).reshape(-1, count).T
    bits = int(np.ceil(10 * np.log2(count)))
    draw = np.random.default_rng(count)
    tries = [draw.choice((-1.0, 1.0), (count, bits)) for _ in range(50)]
    return max(tries, key=lambda m: -np.max(m @ m.T - 2 * bits * np.eye(count)))


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, one row per text."""
    gap = max(ORDERS) - 1
    data, at = text_bytes(pc.utf8_lower(texts))
    rows = len(at) - 1
    padded = np.insert(_BYTES[data], np.repeat(at, gap), 32).astype(np.uint32)
    of = np.repeat(np.arange(rows), np.diff(at) + gap) * SLOTS
    counts = np.zeros(rows * SLOTS)
    for n in ORDERS:
        gram = padded[:len(of)].copy()
        for i in range(1, n):
            gram |= padded[i:len(of) + i] << np.uint32(8 * i)
        gram = (gram + np.uint32(n)) * np.uint32(2654435769) >> np.uint32(32 - SLOTS.bit_length() + 1)
        counts += np.bincount(of + gram, minlength=rows * SLOTS)
    counts = counts.reshape(rows, SLOTS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        for first in range(0, batch.num_rows, _ROWS):
            yield batch.slice(first, _ROWS)


def sample(docs: DataFrame, label: Column, most: int = SAMPLE) -> DataFrame:
    """Rows ``text, label``: as many of each label, by the order of a hash of the id."""
    rows = docs.select("doc_id", "text", label.alias("label")).filter(
        "label is not null and text is not null")
    counted = rows.groupBy("label").count().collect()
    each = max(1, most // max(1, len(counted)))
    # by chance of the hash alone, leave some four times as many of each label before ranking
    share = F.create_map(*[x for r in counted for x in (F.lit(r["label"]), F.lit(4 * each / r["count"]))])
    order = Window.partitionBy("label").orderBy("place", "doc_id", F.xxhash64("text"))
    return (
        rows.withColumn("place", F.xxhash64("doc_id"))
        .filter(F.pmod("place", F.lit(1 << 20)) < share[F.col("label")] * (1 << 20) if counted else F.lit(False))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= each).select("text", "label"))


def fit(labelled: DataFrame) -> Model | None:
    """Fit on rows ``text, label`` (a bounded sample); only features reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            made = features(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([r.tobytes() for r in made], pa.binary())], ["label", "made"])

    found = labelled.mapInArrow(run, "label string, made binary").orderBy("label", "made").toArrow()
    if not found.num_rows:
        return None
    languages = sorted(set(found["label"].to_pylist()))
    codes = codewords(len(languages))
    truth = np.searchsorted(languages, found["label"].to_numpy(zero_copy_only=False))
    x = np.frombuffer(b"".join(found["made"].to_pylist()), np.float16).reshape(-1, SLOTS).astype(np.float32)
    y = codes[truth]
    middle, mean = x.mean(0), y.mean(0)
    x = x - middle
    # ridge regression on the bits, with what each row would get if it were left out
    inverse = np.linalg.inv((x @ x.T).astype(np.float64) + RIDGE * len(x) / 100 * np.eye(len(x)))
    dual = inverse @ (y - mean)
    left_out = y - dual / np.diag(inverse)[:, None]
    trust = np.maximum(0, 2 * (np.sign(left_out) == y).mean(0) - 1)
    trust = trust / trust.sum() if trust.sum() > 0 else np.full(len(trust), 1 / max(1, len(trust)))
    weights = x.T @ dual
    model = Model(languages, codes, weights.astype(np.float32), mean - middle @ weights, trust, 1.0)
    fits = {}
    for sharpness in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        model.sharpness = sharpness
        chance = model.decoded(model.lost(left_out))[np.arange(len(truth)), truth]
        fits[sharpness] = np.log(np.maximum(chance, 1e-9)).sum()
    model.sharpness = max(fits, key=fits.get)
    return model


def predict(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of ``docs``: the columns to carry, and ``lang_pred, score, ambiguous, loss, size`` of its ``text``:
    the loss of the codeword it gets (null if ``und``), and the binary logarithm of its bytes of letters."""
    schema = T.StructType([
        *(docs.schema[c] for c in carry), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()),
        T.StructField("loss", T.DoubleType()), T.StructField("size", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            texts = batch.column("text")
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names = np.full(batch.num_rows, UNKNOWN, dtype=object)
            score, close = np.zeros(batch.num_rows), np.ones(batch.num_rows, dtype=bool)
            least = np.full(batch.num_rows, np.nan)
            data, at = text_bytes(texts)
            letters = np.concatenate(([0], np.cumsum(_BYTES[data] != 32)))
            size = np.log2(np.maximum(letters[at[1:]] - letters[at[:-1]], 1)).astype(np.int32)
            if model is not None and known.any():
                loss = model.losses(features(texts))
                chance = model.decoded(loss)
                least[known] = loss.min(1)[known]
                ranked = np.sort(chance, axis=1)
                best = chance.argmax(1)
                names[known] = np.array(model.languages, dtype=object)[best[known]]
                score[known] = ranked[known, -1]
                close = ~known
                if chance.shape[1] > 1:
                    close |= ranked[:, -1] - ranked[:, -2] < CLOSE
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(names, pa.string()), pa.array(score), pa.array(close),
                 pa.array(least, from_pandas=True), pa.array(size)],
                schema.names)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def unlike_all(predicted: DataFrame) -> Column:
    """Whether a predicted text is in none of the learned languages, for a table with ``labelled``, whether a
    row has a label: no letter, or a higher loss than all but a thousandth of the labelled texts of its size (of
    the next smaller size that has enough of them, as more letters tell more)."""
    levels = (
        predicted.filter("labelled and loss is not null").groupBy("size")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("loss", KEPT, 10_000).alias("level")).collect())
    level = F.lit(None).cast("double")
    for r in sorted((r for r in levels if r["n"] >= LEAST_SUPPORT), key=lambda r: r["size"]):
        level = F.when(F.col("size") >= r["size"], max(r["level"], LEAST_LOSS)).otherwise(level)
    return (F.col("lang_pred") == UNKNOWN) | F.coalesce(F.col("loss") > level, F.lit(False))


def identify(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Learn from the rows of ``docs`` (``doc_id, text, lang``) that are not held out, and predict
    all: rows ``doc_id, held_out, lang_pred, score, ambiguous``.

    Rows are held out by ``fold``; languages, sources and ids are no inputs of a prediction.
    """
    model = fit(sample(docs.filter(fold(F.col("doc_id")) != 0), F.col("lang"), most))
    return predict(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")

"""Pipeline stages: each takes ``(spark, docs, sf_dir)`` and applies one operator to ``docs``.

All but the last return the columns of ``documents``; other columns of ``docs`` go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mnemoframe.llm import byte_bpe, jaccard, language, mixing, pii
from mnemoframe.llm.common import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language: null texts, texts without a letter, and texts that fit the best
    language's codeword worse than all but a thousandth of the labelled texts of their size do.

    Ambiguous texts stay, and so do texts shorter than any size (by powers of two of bytes of letters) with
    20 labelled ones.  Up to a thousandth of the clean texts of a size may go.  Learned from the labelled
    rows of ``docs``; where none is labelled, all texts with a letter stay.  With one learned language
    the loss is always 0; with two, part of the texts in others is noticed.
    """
    model = language.fit(language.sample(docs, F.col("lang")))
    if model is None:
        return docs.filter(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    # texts do not come back from Python: what is rejected is found by id and digest
    keyed = docs.select(
        F.struct("doc_id", F.xxhash64("text").alias("twin")).alias("doc_id"), "text", F.col("lang").isNotNull().alias("labelled"))
    predicted = store(language.predict(keyed, model, ("doc_id", "labelled")).select(
        "doc_id", "labelled", "lang_pred", "loss", "size"), "predicted")
    rejected = (
        predicted.filter(language.unlike_all(predicted))
        .select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.twin").alias("twin")).distinct())
    return docs.select(*COLUMNS).join(
        rejected, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("twin")), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by a similarity of 0.8 or more on five-word shingles, keep
    the one with the least id; of rows with that id, one.  Rows without an id or a word stay."""
    linked = jaccard.link(docs, n=5, percent=80)
    kept = linked.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "lang", "source", "n_chars"))
    return (
        docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi")
        .withColumn("_nth", one).filter("_nth = 1").select(*COLUMNS)
        .union(docs.filter("doc_id is null").select(*COLUMNS)))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; ``n_chars`` is that of the new text."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("twin")).alias("doc_id"), "text")
    found = (
        pii.find(keyed).filter(F.size("spans") > 0)
        .select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.twin").alias("twin"), "spans")
        .dropDuplicates(["id", "twin"]))
    text = F.coalesce(F.when(F.col("spans").isNotNull(), pii.redact(F.col("text"), F.col("spans"))), F.col("text"))
    return (
        docs.select(*COLUMNS)
        .join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("twin")), "left")
        .withColumn("text", text)
        .withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
        .select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the words of each source come near its target.

    A document stays as often as the mix takes its words, to the nearest whole number
    (half a document counts as one).  Rows without words take no part in a mix and go.
    """
    times = (
        mixing.mix(docs).filter("taken > 0")
        .select(F.col("doc_id").alias("id"), "twin", F.expr(
            "cast(floor(try_divide(taken, size) + 0.5) as int)").alias("times"))
        .filter("times > 0")
        # equal rows share their copies; any of them stands for all
        .groupBy("id", "twin").agg(F.sum("times").alias("times"))
    )
    one = docs.select(*COLUMNS, F.xxhash64("text").alias("own")).dropDuplicates(["doc_id", "own"])
    return (
        one.join(times, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("twin")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .select(*COLUMNS)
    )


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows ``doc_id, n_tokens, ids, decoded_sha256``: the token ids of each text, and a digest of the
    bytes that they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))

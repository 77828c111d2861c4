"""Document fingerprints of closed syncmers.

A run of ``K`` words is an anchor if the least hash of its words is that of the first or
the last.  Whether a run is an anchor depends on its own words alone, so an edit changes
only the anchors that it touches, and equal passages have equal anchors wherever they
stand.  The fingerprint keeps the ``SIZE`` least hashes of a text's anchors; the likeness
of two fingerprints estimates the share of anchors the texts have in common.

A text with words but without an anchor has the hash of all its words as its only one.
Null, empty and blank texts have an empty fingerprint; two of those are alike (1), one of
them and any other are not (0).  All words of a text are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.llm.common import parallelism, place, range_starts

K = 5
SIZE = 64
_SPACE = "[\\x20\\x09-\\x0D]+"


def anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add ``to``: the anchors of a text column as structs ``hash, at`` (number of the first word)."""
    hashes, runs = f"_{to}_words", f"_{to}_runs"
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE, -1), "")
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(runs, F.arrays_zip(*[
        F.slice(hashes, i + 1, F.greatest(F.size(hashes) - (K - 1), F.lit(0))).alias(str(i)) for i in range(K)]))

    def closed(run: Column) -> Column:
        least = F.least(*[run[str(i)] for i in range(K)])
        return (run["0"] == least) | (run[str(K - 1)] == least)

    def told(run: Column, at: Column) -> Column:
        return F.when(closed(run), F.struct(F.xxhash64(*[run[str(i)] for i in range(K)]).alias("hash"), at.alias("at")))

    whole = F.when(F.size(hashes) > 0, F.array(F.struct(F.xxhash64(hashes).alias("hash"), F.lit(0).alias("at"))))
    found = f"_{to}_found"
    df = df.withColumn(found, F.filter(F.transform(runs, told), lambda a: a.isNotNull()))
    return df.withColumn(to, F.when(F.size(found) > 0, F.col(found)).otherwise(
        F.coalesce(whole, F.array().cast("array<struct<hash:bigint,at:int>>")))).drop(hashes, runs, found)


def fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add ``to``: the sorted ``SIZE`` least anchor hashes of a text column."""
    df = anchors(df, text, to)
    return df.withColumn(to, F.slice(F.sort_array(F.array_distinct(F.col(to)["hash"])), 1, SIZE))


def likeness(a: Column, b: Column) -> Column:
    """Share of the least hashes of both that both have: 0 to 1."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    both = F.array_intersect(F.array_intersect(least, a), b)
    return F.when(F.size(least) == 0, 1.0).otherwise(F.size(both) / F.size(least)).cast("double")


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, parts: int) -> tuple[DataFrame, Window]:
    """Rows ``part, doc_id, text, guest`` in which each document is followed by the next one.

    Documents go to parts by ranges of ids.  The first document of a range is also a
    guest at the end of the range before, the first of all at the very end, so that no
    task needs more than its part.  Null ids come last.  Also gives the order in a part.
    """
    starts = range_starts(docs, "doc_id", parts)
    own = F.coalesce(place(F.col("doc_id"), starts), F.lit(0))
    own = F.when(F.col("doc_id").isNull(), max(0, len(starts) - 1)).otherwise(own)
    seats = [F.struct(own.alias("part"), F.lit(0).alias("guest"))]
    if starts:
        begins = F.col("doc_id").isin(starts)
        seats.append(F.when(begins, F.struct(
            F.when(F.col("doc_id") == starts[0], len(starts) - 1).otherwise(own - 1).alias("part"),
            F.lit(1).alias("guest"))))
    spread = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("seat", F.explode(F.filter(F.array(*seats), lambda s: s.isNotNull())))
        .select("seat.part", "seat.guest", "doc_id", "text"))
    return spread, Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")


def edited(text: Column, following: Column) -> Column:
    """The text with its second half replaced by as much of the start of the one that follows."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def compare(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``, one
    for each row of ``docs`` (``doc_id, text``); fingerprints are arrays of hashes.

    A table of one row is followed by itself.
    """
    spread, order = with_next(docs, parallelism(docs.sparkSession))
    first = F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = spread.withColumn("edited", edited(F.col("text"), F.coalesce(F.lead("text").over(order), first)))
    df = fingerprint(df, "text", "own").withColumn("n_chars", F.length("text").cast("long"))
    own_first = F.first("own").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("next", F.coalesce(F.lead("own").over(order), own_first)).filter("guest = 0")
    df = fingerprint(df, "edited", "other")
    return df.select(
        "doc_id", "n_chars", "edited", F.col("own").alias("fingerprint"), F.col("other").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"))

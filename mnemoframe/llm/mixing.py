"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

The mix is a sequence of slots of ``block`` tokens.  Slot n lies at the golden-ratio
point ``frac(n * phi)``; the source whose share of the cumulative targets holds that
point fills the slot.  The k-th slot of a source takes the k-th block of its stream:
its documents in a shuffled order, laid end to end, up to ``most`` times over.

Rows with null or empty text have size 0 and take nothing.  A null source is a source
of its own, ordered last.  Rows with equal ids are documents of their own.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.llm.common import WORD, store

SHARES = (5, 2, 1)
MOST = 3
SLOTS = 20  # the schedule has at most 2**SLOTS slots, whatever the size of the corpus
GOLDEN = 2654435769  # 2**32 / golden ratio
BUCKETS = 3  # hexadecimal digits of the shuffle key that split a source into parts
CELLS = 4096  # cells of the unit interval in which slots look for their source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, shares=SHARES, most: int = MOST) -> DataFrame:
    """Rows ``source, place, source_size, target``: one per source.

    Targets share the total size by weight; none exceeds ``most`` times its source,
    and what is above goes to the others by weight (the level at which all is shared
    is found in order of the size per weight at which a source is full).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    full_first = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(1))
    weights = F.array(*[F.lit(float(s)) for s in shares])
    one = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name).cast("long"))
        .withColumn("weight", F.element_at(weights, ((F.col("place") - 1) % len(shares) + 1).cast("int")))
        .withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    levels = (
        one.withColumn("total", F.sum("source_size").over(everywhere).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(everywhere))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(full_first), F.lit(0.0)))
                    / (F.col("all_weights") - F.coalesce(F.sum("weight").over(full_first), F.lit(0.0))))
        .withColumn("shared_at", F.min(F.when(
            F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(everywhere)["level"])
    )
    return levels.select(
        "source", "place", "source_size",
        F.round(F.least("cap", F.col("shared_at") * F.col("weight")), 6).alias("target"))


def schedule(targets: DataFrame) -> DataFrame:
    """Rows ``place, rank, block``: the k-th slot of each source and the tokens of a slot."""
    running = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    everywhere = Window.partitionBy(F.lit(1))
    spans = (
        targets.withColumn("all", F.sum("target").over(everywhere))
        .withColumn("total", F.sum("source_size").over(everywhere))
        .withColumn("to", F.try_divide(F.sum("target").over(running), F.col("all")) * 2.0 ** 32)
        .withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("place")), F.lit(0.0)))
        .filter("total > 0 and to > from")
        .withColumn("block", F.ceil(F.col("total") / 2 ** SLOTS))
        .withColumn("slots", F.ceil(F.try_divide(F.col("total"), F.col("block"))))
        .withColumn("cell", F.explode(F.sequence(
            F.floor(F.col("from") / (2 ** 32 // CELLS)),
            F.least(F.floor(F.col("to") / (2 ** 32 // CELLS)), F.lit(CELLS - 1)))))
        .select("place", "from", "to", "block", "slots", "cell")
    )
    points = targets.sparkSession.range(2 ** SLOTS).select(
        F.col("id").alias("slot"), (F.col("id") * GOLDEN % 2 ** 32).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / (2 ** 32 // CELLS)))
    met = (
        points.join(spans, "cell")
        .filter("point >= from and point < to and slot < slots")
        .select("place", "slot", "block", F.floor(F.col("slot") / 4096).alias("part"))
    )
    before = (
        met.groupBy("place", "part").agg(F.count(F.lit(1)).alias("here"))
        .withColumn("before", F.sum("here").over(
            Window.partitionBy("place").orderBy("part")) - F.col("here"))
        .drop("here")
    )
    return (
        met.withColumn("within", F.row_number().over(
            Window.partitionBy("place", "part").orderBy("slot")) - 1)
        .join(before, ["place", "part"])
        .select("place", (F.col("before") + F.col("within")).alias("rank"), "block")
    )


def streams(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document with its place in its source's shuffled stream: ``start`` to ``start + size``.

    Sums run over parts of a source (by leading digits of the shuffle key), then over
    the totals of the parts, so that no task sees a whole source.
    """
    keyed = (
        sized.withColumnRenamed("source", "own")
        .join(targets, F.col("own").eqNullSafe(F.col("source"))).drop("own")
        .withColumn("part", F.substring("shuffled", 1, BUCKETS))
    )
    before = (
        keyed.groupBy("place", "part").agg(F.sum("size").alias("here"))
        .withColumn("before", F.sum("here").over(
            Window.partitionBy("place").orderBy("part")) - F.col("here"))
        .drop("here")
    )
    order = Window.partitionBy("place", "part").orderBy("shuffled", "doc_id", "size", "twin").rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        keyed.withColumn("within", F.sum("size").over(order) - F.col("size"))
        .join(before, ["place", "part"])
        .withColumn("start", F.col("before") + F.col("within"))
        .drop("before", "within", "part")
    )


def mix(docs: DataFrame, shares=SHARES, most: int = MOST) -> DataFrame:
    """Rows ``doc_id, twin, size, source_size, target, taken`` for each row of ``docs``.

    ``docs`` has ``doc_id, text, source``.  ``taken`` counts the words of the document
    in the mix, repeats included; ``twin`` is a digest of the text that tells rows with
    equal ids apart.
    """
    sized = store(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit("mix/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffled"),
        F.xxhash64("text").alias("twin"), F.monotonically_increasing_id().alias("row")), "sized")
    targets = store(source_targets(sized, shares, most), "targets")
    placed = streams(sized, targets)
    # one repeat of a document is a span of its source's stream, cut at block borders
    block = targets.agg(F.ceil(F.sum("source_size") / 2 ** SLOTS).alias("block")).first()["block"] or 1
    spans = (
        placed.filter("size > 0")
        .withColumn("turn", F.explode(F.array(*[F.lit(i).cast("long") for i in range(most)])))
        .select("row", "place", "size",
                (F.col("start") + F.col("source_size") * F.col("turn")).alias("low"))
        .withColumn("high", F.col("low") + F.col("size"))
        .withColumn("rank", F.explode(F.sequence(
            F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    )
    slots = schedule(targets)
    taken = (
        spans.join(slots, ["place", "rank"])
        .groupBy("row").agg(F.sum(
            F.least("high", (F.col("rank") + 1) * block) - F.greatest("low", F.col("rank") * block)
        ).cast("long").alias("taken"))
    )
    return (
        placed.join(taken, "row", "left")
        .select("doc_id", "twin", "size", "source_size", "target",
                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )

"""Links between facts and entities, and between facts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mnemoframe.functions import fixed_values as fv
from mnemoframe.functions.text import keyword_set
from mnemoframe.operators.grouping import many_parts, salted_join, top_k
from mnemoframe.session import stored

ANCHOR_CHARS = 8
ANCHOR_STEP = 4
_MASK_BITS = 28
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
BLOCK_FACTS = 1_024
PACKED_FACTS = 32_768
PACKED_WORDS = 8_000_000
SAMPLE_FACTS = 5_000
WINDOW_FACTS = 1_024
WINDOW_GROWTH = 8
_ROWS_OF_PRODUCT = 256


def _anchored(names: DataFrame) -> DataFrame:
    """Each name with the piece of it that the fewest names of the tenant share; a short name is its own piece."""
    last = F.greatest(F.length("canonical_name") - ANCHOR_CHARS + 1, F.lit(1))
    places = F.array_union(F.sequence(F.lit(1), last, F.lit(ANCHOR_STEP)), F.array(last))
    pieces = names.select("tenant_id", "entity_id", "canonical_name", F.explode(F.transform(
        places, lambda at: F.substr("canonical_name", at, F.lit(ANCHOR_CHARS)))).alias("_piece"))
    shared = pieces.groupBy("tenant_id", "_piece").agg(F.count(F.lit(1)).alias("_names"))
    return pieces.join(shared, ["tenant_id", "_piece"]).groupBy("tenant_id", "entity_id", "canonical_name").agg(
        F.min_by("_piece", F.struct("_names", -F.length("_piece"), "_piece")).alias("_piece"))


def _slots(text: str, tenant: str, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each length, the bits of a mask that the pieces of a text have, two a piece, by the place of the piece."""
    letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    salt = np.uint64(int.from_bytes(hashlib.blake2b(tenant.encode(), digest_size=8).digest(), "little"))
    number = np.zeros(len(letters) + 1, dtype=np.uint64)
    for size in range(1, min(max(lengths, default=0), len(letters)) + 1):
        number = number[:-1] * _PRIME + letters[size - 1:]
        if size in lengths:
            mixed = (number ^ salt) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _PRIME
            yield size, np.stack([mixed >> np.uint64(64 - _MASK_BITS), (mixed >> np.uint64(4)) & np.uint64((1 << _MASK_BITS) - 1)])


def _mask(anchored: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of all pieces, in a mask of a fixed size however many names there are, and the pieces' lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [found.ravel() for tenant, piece in zip(*(batch.column(c).to_pylist() for c in ("tenant_id", "_piece")))
                    for _, found in _slots(piece, tenant, [len(piece)])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bits).astype(np.int64) if bits else [], pa.int64())], ["bit"])

    bits = anchored.select("tenant_id", "_piece").mapInArrow(run, "bit long")
    words = bits.groupBy(F.shiftright("bit", 15).alias("word")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    mask = np.zeros((1 << _MASK_BITS) // 8, dtype=np.uint8)
    for row in words.toLocalIterator():
        some = np.frombuffer(row["bits"], dtype=np.uint8)
        mask[row["word"] * 4096:row["word"] * 4096 + len(some)] = some
    lengths = [r[0] for r in anchored.select(F.length("_piece")).distinct().collect()]  # ANCHOR_CHARS at most
    return mask, sorted(lengths)


def mentioned_entities(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """``tenant_id, fact_id, entity_id`` where a fact's text contains an entity's name.

    Containment is by substring, ignoring case, for names of three or more
    characters; ``user`` counts only as a separate word.  No fact is compared with
    every entity: each name is found through its rarest piece.  Pieces of the texts that no name has
    are left out where the texts lie, by a mask of the names' pieces, and the others are joined and checked.
    """
    names = entities.where((F.length("canonical_name") >= 3) & F.col("tenant_id").isNotNull()
                           & (F.col("canonical_name") != "user"))
    anchored = stored(_anchored(names), "anchored-names")
    mask, lengths = _mask(anchored)
    held = facts.sparkSession.sparkContext.broadcast(mask)
    read = facts.where(F.col("tenant_id").isNotNull() & F.col("content").isNotNull()).select(
        "tenant_id", "fact_id", F.lower("content").alias("_text"))
    schema = T.StructType([*read.drop("_text").schema, T.StructField("_piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            row, pieces = [], []
            for n, (tenant, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tenant_id", "_text")))):
                found = set()
                for size, (one, two) in _slots(text, tenant, lengths):
                    at = np.flatnonzero((bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1)
                    other = two[at]
                    at = at[((bits[other >> np.uint64(3)] >> (other & np.uint64(7)).astype(np.uint8)) & 1) > 0]
                    found.update(text[i:i + size] for i in at.tolist())
                row.extend([n] * len(found))
                pieces.extend(found)
            some = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("tenant_id", "fact_id")), pa.array(pieces, pa.string())], schema.names)

    maybe = read.mapInArrow(run, schema).join(anchored, ["tenant_id", "_piece"]).select(
        "tenant_id", "fact_id", "entity_id", "canonical_name").distinct()
    named = maybe.join(facts.select("tenant_id", "fact_id", "content"), ["tenant_id", "fact_id"]).where(
        F.contains(F.lower("content"), "canonical_name")).select(
        "tenant_id", "fact_id", "entity_id")
    lower = F.lower("content")
    speaking = facts.where(lower.startswith("user ") | lower.contains(" user ")).select(
        "tenant_id", "fact_id")
    users = entities.where(F.col("canonical_name") == "user").select("tenant_id", "entity_id")
    return named.unionByName(salted_join(speaking, users, ["tenant_id"], "fact_id"))


def cross_links(new_facts: DataFrame, facts: DataFrame, links: DataFrame, entities: DataFrame,
                page: int | None = None, per_entity: int | None = None, min_overlap: float = 0.20,
                generic=fv.GENERIC_ENTITIES) -> DataFrame:
    """Typed edges from new facts to facts of a shared entity that are not new.

    Keyword sets whose overlap reaches ``min_overlap`` are linked.  With ``page`` only that many
    newest facts of an entity are looked at, with ``per_entity`` a fact gets that many links through
    an entity, the newest; without, all of them.  A fact needs two keywords to link, a
    scratchpad is no target.  The default relation is ``relates_to``; both ends of the edge
    are the shared entity and the fact ids sit beside it.
    """
    linked = _named_links(links, entities, generic)
    rows = facts.select("tenant_id", "fact_id", "created_at", "tags", "content").join(linked, ["tenant_id", "fact_id"])
    if page is not None:
        rows = top_k(rows, ["tenant_id", "entity_id"], [F.col("created_at").desc(), F.col("fact_id").desc()], page)
    old = _with_words(rows.where(~F.array_contains("tags", "scratchpad")).join(
        new_facts.select("fact_id"), "fact_id", "left_anti"))
    new = _with_words(new_facts.select("tenant_id", "fact_id", "created_at", "content").join(
        linked, ["tenant_id", "fact_id"])).where(F.size("words") >= 2)
    if per_entity is None:
        return _edges(_one_per_pair(keyword_pairs(new, old, min_overlap)))
    return _edges(_one_per_pair(newest_pairs(new, old, min_overlap, per_entity)))


def all_cross_links(facts: DataFrame, links: DataFrame, entities: DataFrame, per_entity: int | None = None,
                    min_overlap: float = 0.20, generic=fv.GENERIC_ENTITIES) -> DataFrame:
    """The edges as if each fact had come after all earlier ones: from every fact to all earlier facts.

    A pair of facts that share several entities is one edge, through the least of them.  Where each fact has one row
    that is told from the entities of both as they meet, and no pair is shuffled.
    """
    linked = _named_links(links, entities, generic)
    words = PackedWords(facts)
    once = per_entity is None and facts.groupBy("fact_id").count().where("fact_id IS NOT NULL AND count > 1").isEmpty()
    if once:
        of = F.array_sort(F.collect_list(F.struct("entity_id", "entity_name")))
        named = linked.groupBy("tenant_id", "fact_id", "entity_id").agg(F.min("entity_name").alias("entity_name"))
        grouped = named.groupBy("tenant_id", "fact_id").agg(of.alias("_of"))
        rows = grouped.select("*", F.posexplode("_of").alias("_at", "_one")).select(
            "tenant_id", "fact_id", "_one.*",
            F.transform(F.slice("_of", F.lit(1), F.col("_at")), lambda e: F.xxhash64(e["entity_id"])).alias("before"))
    else:
        rows = linked.withColumn("before", F.array().cast("array<bigint>"))
    pairs = keyword_pairs(rows, words, min_overlap)
    if once:
        return _edges(pairs)
    if per_entity is not None:
        pairs = top_k(pairs, ["tenant_id", "entity_id", "source_fact_id"], _newest(), per_entity)
    return _edges(_one_per_pair(pairs))


def _named_links(links: DataFrame, entities: DataFrame, generic) -> DataFrame:
    own = entities.where(~F.col("canonical_name").isin(*generic)).select(
        "tenant_id", "entity_id", F.col("canonical_name").alias("entity_name"))
    return links.select("fact_id", "entity_id").distinct().join(own, "entity_id")


def _with_words(rows: DataFrame, *more) -> DataFrame:
    """A fact without a text links with nothing."""
    return rows.where(F.col("content").isNotNull()).select("tenant_id", "entity_id", "entity_name", "fact_id", "created_at", F.transform(
        keyword_set(F.col("content")), lambda w: F.xxhash64(w)).alias("words"), *more)


class PackedWords:
    """A fact's hashed words in little room: ``tenant_id, fact_id, created_at, source, target, common, rare``.

    The words that most facts of a sample have are two bytes each, their place in a table
    of hashes that every task holds; the others stay whole, so nothing is lost, whatever the sample is.
    A fact without a text links with nothing; one with two words is a ``source``, no scratchpad is a ``target``.
    """

    def __init__(self, facts: DataFrame):
        hashed = facts.where(F.col("content").isNotNull() & F.col("created_at").isNotNull()).select(
            "tenant_id", "fact_id", "created_at", F.coalesce(~F.array_contains("tags", "scratchpad"), F.lit(False)).alias("target"),
            F.transform(keyword_set(F.col("content")), lambda w: F.xxhash64(w)).alias("words"))
        nth = max(1, hashed.select("fact_id").count() // SAMPLE_FACTS)
        some = stored(hashed.where(F.pmod(F.xxhash64("fact_id", F.lit("sample")), F.lit(nth)) == 0).select("words"), "sample-words")
        often = (some.select(F.explode("words").alias("word")).groupBy("word").count()
                 .orderBy(F.col("count").desc(), "word").limit(1 << 16).select("word"))
        known = np.sort(np.array([r[0] for r in often.collect()], dtype=np.int64))
        self.known: Broadcast = facts.sparkSession.sparkContext.broadcast(known)
        self.mean = some.agg(F.avg(F.size("words"))).first()[0] or 1.0
        self.rows = self._rows(hashed)

    def _rows(self, hashed: DataFrame) -> DataFrame:
        held = self.known
        schema = T.StructType([
            *(f for f in hashed.schema if f.name != "words"), T.StructField("source", T.BooleanType()),
            T.StructField("common", T.ArrayType(T.ShortType())), T.StructField("rare", T.ArrayType(T.LongType()))])

        def lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
            ends = np.cumsum(np.bincount(row, minlength=rows))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                row, word = _flat(batch.column("words"))
                at = np.searchsorted(known, word)
                common = at < len(known)
                common[common] = known[at[common]] == word[common]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in schema.names[:4]), pa.array(np.bincount(row, minlength=len(batch)) >= 2),
                    lists((at[common] - (1 << 15)).astype(np.int16), row[common], len(batch), pa.int16()),
                    lists(word[~common], row[~common], len(batch), pa.int64())], schema.names)

        return hashed.mapInArrow(run, schema)


def _newest() -> list[Column]:
    return [F.col("created_at").desc(), F.col("target_fact_id").desc()]


def newest_pairs(new: DataFrame, old: DataFrame, min_overlap: float, per_entity: int,
                 first: int = WINDOW_FACTS) -> DataFrame:
    """Of the ``keyword_pairs`` the ``per_entity`` newest of each new fact and entity.

    The old facts of an entity are met from the newest on, in windows of ``first`` and then ever more of them,
    and a new fact that has its pairs meets none of the older windows.
    """
    key = ["tenant_id", "entity_id"]
    source = [*key, "source_fact_id"]
    new, old = stored(new, "new-facts"), stored(old, "old-facts")
    large = stored(old.groupBy(*key).count().where(F.col("count") > first), "large-entities")
    most = large.agg(F.max("count")).first()[0] or 0
    place = F.struct("created_at", "fact_id")
    light = old.select(*key, "created_at", "fact_id").join(large, key, "left_semi")
    cuts, size = [], first
    while size < most:
        cuts.append(top_k(light, key, [F.col("created_at").desc(), F.col("fact_id").desc()], size)
                    .groupBy(*key).agg(F.min(place).alias("_cut")))
        size *= WINDOW_GROWTH
    if cuts:
        every = cuts[0]
        for more in cuts[1:]:
            every = every.unionByName(more)
        every = stored(every.groupBy(*key).agg(F.collect_list("_cut").alias("_cuts")), "windows")
        older = F.size(F.filter("_cuts", lambda cut: place < cut))
        # an entity with fewer facts than a window has the same cut again, and nothing behind it
        old = stored(old.join(every, key, "left").withColumn(
            "_window", F.when(F.col("_cuts").isNull(), 0).otherwise(older)).drop("_cuts"), "old-facts")
    found, open_ = None, new
    for window in range(len(cuts) + 1):
        looked = old.where(F.col("_window") == window).drop("_window") if cuts else old
        got = stored(top_k(keyword_pairs(open_, looked, min_overlap, newest=per_entity), source, _newest(), per_entity), "newest-pairs")
        found = got if found is None else found.unionByName(got)
        if window < len(cuts):
            full = found.groupBy(*source).count().where(F.col("count") >= per_entity).withColumnRenamed("source_fact_id", "fact_id")
            open_ = stored(new.join(large, key, "left_semi").join(full, [*key, "fact_id"], "left_anti"), "open-facts")
            if open_.isEmpty():
                break
    return top_k(found, source, _newest(), per_entity)


def keyword_pairs(left: DataFrame, right: DataFrame | PackedWords, min_overlap: float, newest: int | None = None,
                  rows_at_once: int | None = None) -> DataFrame:
    """``tenant_id, entity_id, entity_name, source_fact_id, target_fact_id, created_at, overlap`` of the facts of an
    entity that share enough keywords; ``created_at`` is the target's.

    The facts of an entity are dealt into blocks by their measured number, and each block
    of the left side meets each of the right in a task's memory, as products of
    word incidences.  With ``newest`` a task need keep only so many of the newest of a left fact.

    With the words of the facts in place of a right side the facts meet each other, two blocks once for both directions: a
    ``source`` links to a ``target`` that comes before it by time, then id, unless they share one of the entities in
    ``before``.  A fact is then moved as often as its entity has blocks, so these are as large as memory allows.
    """
    key = ["tenant_id", "entity_id"]
    among = isinstance(right, PackedWords)
    if rows_at_once is None:
        rows_at_once = min(PACKED_FACTS, int(PACKED_WORDS / max(right.mean, 1)) + 1) if among else BLOCK_FACTS

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        count = F.count(F.lit(1))
        # a large entity is three cells at least, so that it is not one task's
        share = F.greatest(count / rows_at_once, F.least(count / BLOCK_FACTS, F.lit(2.0)))
        return rows.groupBy(*key).agg(F.ceil(share).cast("int").alias(name))

    own = F.pmod(F.xxhash64("fact_id", F.lit("block")), F.col("_own")).cast("int")
    if among:
        both = (left.join(blocks(left, "_own"), key).withColumn("_mine", own)
                .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_own") - 1)))
                .select(*left.columns, (F.col("_mine") > F.col("_other")).cast("int").alias("_side"),
                        F.least("_mine", "_other").alias("_left"), F.greatest("_mine", "_other").alias("_right"))
                .join(right.rows, ["tenant_id", "fact_id"]))
    else:
        counts = blocks(left, "_lefts").join(blocks(right, "_rights"), key)

        def dealt(rows: DataFrame, side: int) -> DataFrame:
            mine, others = ("_lefts", "_rights") if side == 0 else ("_rights", "_lefts")
            out = (rows.join(counts, key).withColumn("_own", F.col(mine)).withColumn("_mine", own)
                   .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(others) - 1))))
            names = ("_mine", "_other") if side == 0 else ("_other", "_mine")
            return out.select(*rows.columns, F.lit(side).alias("_side"), F.col(names[0]).alias("_left"), F.col(names[1]).alias("_right"))

        both = dealt(left, 0).unionByName(dealt(right, 1))
    held = right.known if among else None
    id_type = both.schema["fact_id"].dataType
    schema = T.StructType([
        both.schema["tenant_id"], both.schema["entity_id"], both.schema["entity_name"], T.StructField("source_fact_id", id_type),
        T.StructField("target_fact_id", id_type), both.schema["created_at"], T.StructField("overlap", T.DoubleType())])
    cell = [*key, "_left", "_right"]
    return both.repartition(many_parts(both.sparkSession), *cell).sortWithinPartitions(
        *cell, "_side", F.col("created_at").desc(), F.col("fact_id").desc()).mapInArrow(
        lambda batches: _cells(batches, schema.names, min_overlap, held, newest), schema)


def _cells(batches: Iterator[pa.RecordBatch], names: list[str], least: float, packed: Broadcast | None, newest: int | None) -> Iterator[pa.RecordBatch]:
    """Rows come cell by cell, those of the left side first, the newest first."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("tenant_id", "entity_id", "_left", "_right"))))
        first = 0
        for n, key in enumerate(keys):
            if key != now:
                if n > first:
                    held.append(batch.slice(first, n - first))
                yield from _cell(held, names, least, packed, newest)
                held, first, now = [], n, key
        held.append(batch.slice(first))
    yield from _cell(held, names, least, packed, newest)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each value of the lists and its row."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()


def _words(rows: pa.Table, packed: Broadcast | None) -> tuple[np.ndarray, np.ndarray]:
    if packed is None:
        return _flat(rows.column("words").combine_chunks())
    row, place = _flat(rows.column("common").combine_chunks())
    more, rare = _flat(rows.column("rare").combine_chunks())
    return np.concatenate([row, more]), np.concatenate([packed.value[place.astype(np.int64) + (1 << 15)], rare])


def _incidence(row: np.ndarray, value: np.ndarray, rows: int, cut: int) -> np.ndarray:
    """Rows by the values that rows on both sides of the cut have; without a cut, that two rows have."""
    _, number, times = np.unique(value, return_inverse=True, return_counts=True)
    if cut < rows:
        left = np.bincount(number[row < cut], minlength=len(times))
        met = (left > 0) & (times > left)
    else:
        met = times > 1
    place = np.cumsum(met) - 1
    kept = met[number]
    out = np.zeros((rows, int(met.sum())), dtype=np.float32)
    out[row[kept], place[number[kept]]] = 1
    return out


def _cell(held: list[pa.RecordBatch], names: list[str], least: float, packed: Broadcast | None, newest: int | None) -> Iterator[pa.RecordBatch]:
    """Two blocks, or one with itself, in pieces of which each pair is one product of incidences."""
    rows = pa.Table.from_batches(held) if held else None
    if rows is None or not len(rows):
        return
    cut = int((rows.column("_side").to_numpy() == 0).sum())
    alone = packed is not None and rows.column("_left")[0] == rows.column("_right")[0]
    if cut in (0, len(rows)) and not alone:
        return
    place = None
    if packed is not None:
        places = list(zip(rows.column("created_at").to_pylist(), rows.column("fact_id").to_pylist()))
        number = {place: n for n, place in enumerate(sorted(set(places)))}
        place = np.array([number[p] for p in places])
    for left in range(0, cut, BLOCK_FACTS):
        ends = slice(left, min(left + BLOCK_FACTS, cut))
        for right in range(left if alone else cut, len(rows), BLOCK_FACTS):
            others = slice(right, min(right + BLOCK_FACTS, len(rows)))
            mine = alone and left == right
            some = [rows.slice(s.start, s.stop - s.start) for s in ((ends,) if mine else (ends, others))]
            places = None if place is None else np.concatenate([place[s] for s in ((ends,) if mine else (ends, others))])
            yield from _met(pa.concat_tables(some).combine_chunks(), len(some[0]), mine, places, names, least, packed, newest)


def _met(rows: pa.Table, cut: int, alone: bool, place: np.ndarray | None, names: list[str], least: float,
         packed: Broadcast | None, newest: int | None) -> Iterator[pa.RecordBatch]:
    start = 0 if alone else cut
    row, word = _words(rows, packed)
    sizes = np.bincount(row, minlength=len(rows))
    met = _incidence(row, word, len(rows), cut)
    among = packed is not None
    if among:
        before = _incidence(*_flat(rows.column("before").combine_chunks()), len(rows), cut)
        may_source, may_target = (rows.column(c).to_numpy() for c in ("source", "target"))
    plain = rows.select(["tenant_id", "entity_id", "entity_name", "fact_id", "created_at"])
    for first in range(0, cut, _ROWS_OF_PRODUCT):
        some = slice(first, min(first + _ROWS_OF_PRODUCT, cut))
        smaller = np.minimum(sizes[some, None], sizes[None, start:])
        overlap = np.divide(met[some] @ met[start:].T, smaller, out=np.zeros(smaller.shape), where=smaller > 0, dtype=np.float64)
        passing = overlap >= least
        if among and before.shape[1]:
            passing &= (before[some] @ before[start:].T) == 0
        at, target = np.nonzero(passing)
        found = overlap[at, target]
        if newest is not None:  # the right side's newest come first
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            at, target, found = at[nth < newest], target[nth < newest], found[nth < newest]
        at, target = at + first, target + start
        if among:
            later = place[at] > place[target]
            source, other = np.where(later, at, target), np.where(later, target, at)
            kept = (place[at] != place[target]) & may_source[source] & may_target[other]
            if alone:  # both orders of a pair are in the product
                kept &= later
            at, target, found = source[kept], other[kept], found[kept]
        if len(at):
            source, other = plain.take(pa.array(at)), plain.take(pa.array(target))
            columns = [*(source.column(c) for c in ("tenant_id", "entity_id", "entity_name", "fact_id")),
                       other.column("fact_id"), other.column("created_at"), pa.chunked_array([pa.array(found)])]
            yield from pa.Table.from_arrays(columns, names).to_batches()


def _one_per_pair(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source_fact_id", "target_fact_id").agg(
        F.min(F.struct("entity_id", "tenant_id", "entity_name", "overlap")).alias("_edge")).select(
        "source_fact_id", "target_fact_id", "_edge.*")


def _edges(once: DataFrame) -> DataFrame:
    return once.select(
        "tenant_id", F.col("entity_id").alias("source_id"), F.col("entity_id").alias("target_id"),
        F.lit("relates_to").alias("relation"), edge_type(F.lit("relates_to")).alias("edge_type"),
        F.least(F.col("overlap") + 0.2, F.lit(1.0)).alias("weight"),
        F.col("overlap").alias("confidence"), "entity_name", "source_fact_id", "target_fact_id")


def edge_type(relation: Column) -> Column:
    pairs = [F.lit(x) for kv in fv.RELATION_EDGE_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), relation), F.lit("associative"))

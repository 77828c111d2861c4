"""The training-data queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm import (
    alignment, byte_bpe, fingerprints, jaccard, language, licenses, merkle, mixing, pii, substrings, token_files, toxicity, vectors)
from mnemoframe.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP6_SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, md5('mix/' || doc_id) AS shuffled,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS ss,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3 * ss AS cap FROM s),
l AS (
  SELECT *, cap / weight AS full_at,
    (sum(ss) OVER () - coalesce(sum(cap) OVER b, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, place, ss, round(least(cap, weight * (
      SELECT level FROM l WHERE level <= full_at ORDER BY full_at, place LIMIT 1)), 6) AS target
  FROM l),
spans AS (
  SELECT *, sum(target) OVER (ORDER BY place) / sum(target) OVER () * 4294967296.0 AS upto FROM t),
size_of AS (
  SELECT ceil(sum(ss) / 1048576)::BIGINT AS block,
    ceil(sum(ss) / ceil(sum(ss) / 1048576))::BIGINT AS slots FROM t),
slots AS (
  SELECT place, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank
  FROM (SELECT n AS slot, ((n * 2654435769) % 4294967296)::DOUBLE AS point
        FROM range(1048576) r(n), size_of WHERE n < size_of.slots) p
  ASOF JOIN (SELECT place, coalesce(lag(upto) OVER (ORDER BY place), 0) AS lo, upto FROM spans) x
    ON p.point >= x.lo),
placed AS (
  SELECT d.row, d.doc_id, d.size, t.place, t.ss, t.target,
    sum(d.size) OVER (PARTITION BY t.place ORDER BY d.shuffled, d.doc_id
                      ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT row, place, low, high, unnest(range((low // block)::BIGINT, ((high - 1) // block)::BIGINT + 1)) AS rank
  FROM (SELECT row, place, (start + e * ss)::BIGINT AS low, (start + e * ss + size)::BIGINT AS high
        FROM placed, range(3) r(e) WHERE size > 0) x, size_of),
taken AS (
  SELECT row, sum(least(high, (rank + 1) * block) - greatest(low, rank * block)) AS taken
  FROM cut JOIN slots USING (place, rank), size_of GROUP BY row)
SELECT p.doc_id, p.size::BIGINT AS size, p.ss::BIGINT AS source_size, p.target,
  coalesce(k.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken k USING (row)
"""


@query("op6_source_mix", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("twin")


@query("op10_byte_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_token_files")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    encoded = token_files.encode(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    token_files.write(encoded, path, keys=docs)
    return token_files.read(spark, path).select(
        "doc_id", "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


@query("op2_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rate_documents(
        table(spark, folder, "documents"), table(spark, folder, "labels")).drop("passages")


@query("op1_pii")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(kind):
        return lambda s: s["kind"] == kind

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(F.filter(base, of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query("op8_syncmers")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare(table(spark, folder, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next")


@query("op9_jaccard")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link(table(spark, folder, "documents"))


@query("op5_vectors")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.link(table(spark, folder, "embeddings"))


@query("op3_substrings")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def _values(templates) -> str:
    return ", ".join(
        "('{}', [{}], {}, {})".format(t.label, ", ".join(f"'{w}'" for w in t.words), t.asked(), str(t.phrase).lower())
        for t in templates)


OP12_SQL = rf"""
WITH templates(label, listed, asked, phrase) AS (VALUES {_values(licenses.PHRASES + licenses.STATEMENTS)}),
sized AS (SELECT *, len(listed) AS width, list_distinct(listed) AS set FROM templates),
texts AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
likely AS (SELECT * FROM texts, sized WHERE len(list_intersect(words, set)) >= asked),
blocks AS (
  SELECT row, label, asked, phrase, listed, width, set, b * width AS low, words[b * width + 1:b * width + 2 * width] AS held
  FROM (SELECT *, unnest(range((len(words) + width - 1) // width)) AS b FROM likely)),
places AS (
  SELECT row, label, low + o AS first
  FROM (SELECT *, unnest(range(width)) AS o FROM blocks WHERE phrase)
  WHERE held[o + 1:o + width] = listed),
passages AS (
  SELECT row, label, len(list_intersect(list_distinct(held), set)) / len(set)::DOUBLE AS share
  FROM blocks WHERE NOT phrase AND len(list_intersect(list_distinct(held), set)) >= asked),
base AS (
  SELECT row, count(*) AS n, min(first) AS first_word, max(first) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row),
every AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
  FROM (SELECT row, label, 1.0 AS share FROM places UNION ALL SELECT row, label, share FROM passages) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
  coalesce(share, 0)::DOUBLE AS score
FROM texts LEFT JOIN base b USING (row) LEFT JOIN every e USING (row)
"""


@query("op12_licenses", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    places = F.filter("found", lambda f: f["phrase"])

    def labels(found):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")

    starts = F.transform(places, lambda f: f["first"])
    return licenses.scan(table(spark, folder, "documents")).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(places).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"))


def _told(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ROW = " || ".join(_told(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}"))
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, lang, doc_id, sha256({_ROW.format(text="text")}) AS leaf,
    CASE WHEN crc32 % 3 = 0 THEN sha256({_ROW.format(text=_LOWER)}) ELSE sha256({_ROW.format(text="text")}) END AS told
  FROM (SELECT *, (
    -- crc32 of the decimal id, bit by bit
    SELECT xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
      lambda x: ascii(x)::BIGINT)), lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)),
      lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295)) AS crc32
    FROM documents)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (
  SELECT lang, 0 AS lvl, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 7) // 8
  FROM up WHERE n > 1 GROUP BY lang, lvl, idx // 8),
tops AS (
  SELECT lang, lvl AS levels, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS trees
  FROM up WHERE n = 1),
forest AS (
  SELECT 0 AS lvl, place AS idx, h, trees AS n FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 7) // 8
  FROM forest WHERE n > 1 GROUP BY lvl, idx // 8),
-- each tree's nodes with the forest's above its root: one tree, whose numbers go on from the root's
whole AS (
  SELECT u.lang, u.lvl, u.idx, u.h FROM up u WHERE n > 1
  UNION ALL
  SELECT t.lang, t.levels + f.lvl, f.idx, f.h FROM tops t, forest f),
way AS (
  SELECT row, l.lang, told, s.lvl, CASE WHEN s.lvl < t.levels THEN l.idx // (8 ** s.lvl)::BIGINT
    ELSE t.place // (8 ** (s.lvl - t.levels))::BIGINT END AS idx
  FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
  JOIN (SELECT DISTINCT lang, lvl FROM whole) s ON s.lang IS NOT DISTINCT FROM l.lang
  WHERE s.lvl < t.levels + (SELECT max(lvl) FROM forest)),
siblings AS (
  SELECT row, way.lvl, coalesce(string_agg(h, '' ORDER BY whole.idx) FILTER (whole.idx < way.idx), '') AS before,
    coalesce(string_agg(h, '' ORDER BY whole.idx) FILTER (whole.idx > way.idx), '') AS after
  FROM way JOIN whole ON whole.lang IS NOT DISTINCT FROM way.lang AND whole.lvl = way.lvl AND whole.idx // 8 = way.idx // 8
  GROUP BY row, way.lvl),
proofs AS (
  SELECT row, string_agg(before || after, '' ORDER BY lvl) AS proof,
    list(struct_pack(b := before, a := after) ORDER BY lvl) AS steps FROM siblings GROUP BY row),
folded AS (
  SELECT row, told AS h, 0 AS pos FROM leaves
  UNION ALL
  SELECT row, sha256(steps[pos + 1].b || h || steps[pos + 1].a), pos + 1
  FROM folded JOIN proofs USING (row) WHERE pos < len(steps))
SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
JOIN (SELECT h FROM forest WHERE n = 1) r ON true
LEFT JOIN proofs p USING (row)
JOIN folded f ON f.row = l.row AND f.pos = coalesce(len(p.steps), 0)
"""


@query("op13_merkle", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def leaf(text):
        return merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(lower)).alias("told"))
    proved = merkle.manifest(leaves, "lang", "doc_id")
    return proved.withColumn("folded_root", merkle.folded(F.coalesce("told", "leaf"), F.col("proof"))).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Rule-based fact extraction from message text, all inside one projection per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions import fixed_values as fv
from mnemoframe.functions.text import (
    enriched_segments, java_pattern, normalized_entity_name, normalized_relation, segments,
    strip_role)
from mnemoframe.operators.grouping import first_per_key

_FACT = ("struct<kind:string, content:string, original:string, importance:double, "
         "confidence:double, tags:string>")


# no statement rule can match a line without one of these words
_FIRST_PERSON = java_pattern(r"(?i)\b(?:i|my|they)\b")


def contact_facts(text: Column) -> Column:
    """Emails, phone numbers, links, dates and amounts in order of kind, each once."""
    has_digit = text.rlike("[0-9]")
    possible = {"email": text.contains("@"), "url": text.contains("://")}

    def of_kind(kind: str, prefix: str, tags: str, pattern: str) -> Column:
        # a cheap look for what every match must contain comes before the pattern
        hits = F.when(possible.get(kind, has_digit), F.array_distinct(
            F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0)))).otherwise(
            F.array().cast("array<string>"))
        return F.transform(hits, lambda m: F.struct(
            F.lit(kind).alias("kind"), F.concat(F.lit(prefix), m).alias("content"),
            m.alias("original"), F.lit(0.8).alias("importance"),
            F.lit(0.9).alias("confidence"), F.lit(tags).alias("tags")))

    return F.concat(*[of_kind(*row) for row in fv.CONTACT_PATTERNS]).cast(f"array<{_FACT}>")


def statement(line: Column) -> Column:
    """The personal statement of one line, by the first rule that matches, or null."""
    out = F.when(F.lit(False), F.lit(None).cast(_FACT))
    for pattern, prefix, importance, tags in fv.STATEMENT_RULES:
        said = F.regexp_extract(line, java_pattern(pattern), 1)
        out = out.when(said != "", F.struct(
            F.lit("statement").alias("kind"), F.concat(F.lit(prefix), F.trim(said)).alias("content"),
            line.alias("original"), F.lit(importance).alias("importance"),
            F.lit(0.7).alias("confidence"), F.lit(tags).alias("tags")).cast(_FACT))
    return out


def statement_facts(text: Column) -> Column:
    """Statements of all lines; a repeated content keeps its first line."""
    lines = F.filter(F.split(text, "\n"), lambda raw: raw.rlike(_FIRST_PERSON))
    said = F.transform(lines, lambda raw: statement(F.trim(strip_role(raw))))
    return F.filter(said, lambda s: s.isNotNull())


def first_contents(facts: Column) -> Column:
    contents = F.transform(facts, lambda f: f["content"])
    return F.filter(facts, lambda f, i: F.array_position(contents, f["content"]) == i + 1)


def extract(messages: DataFrame, text: str = "content") -> DataFrame:
    """One row per extracted fact with the message columns (``text`` dropped) beside it.

    Contact facts come first; a statement whose content a contact fact already has
    is dropped.  ``position`` is the order within the message.
    """
    read = messages.withColumn("_contacts", contact_facts(F.col(text))).withColumn(
        "_said", statement_facts(F.col(text)))
    keep = [c for c in messages.columns if c != text]
    merged = read.withColumn("_all", first_contents(F.concat("_contacts", "_said")))
    rows = merged.select(*keep, F.posexplode("_all").alias("position", "_fact"))
    return rows.select(*keep, "position", "_fact.*")


def confidence(messages: DataFrame, facts: DataFrame, key: str,
               entities: DataFrame | None = None) -> DataFrame:
    """Overall confidence per message: best fact, else 0.6 with entities, else 0.5."""
    best = facts.groupBy(key).agg(F.max("confidence").alias("_best"))
    out = messages.select(key).join(best, key, "left")
    named = F.lit(False)
    if entities is not None:
        out = out.join(entities.select(key).distinct().withColumn("_named", F.lit(True)),
                       key, "left")
        named = F.coalesce("_named", F.lit(False))
    return out.select(key, F.coalesce("_best", F.when(named, 0.6).otherwise(0.5))
                      .alias("confidence"))


def named_spans(text: Column) -> Column:
    """Fallback entity finder: runs of two or more capitalised words, each once."""
    return F.array_distinct(F.regexp_extract_all(
        text, F.lit(r"(?<![A-Za-z])[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0)))


def windows(texts: DataFrame, text: str = "content") -> DataFrame:
    """Context windows of each text for a model-based extractor, one row per window."""
    keep = [c for c in texts.columns if c != text]
    parts = texts.withColumn("_parts", segments(F.col(text)))
    return parts.select(*keep, F.inline(enriched_segments(F.col(text), F.col("_parts"))))


def merge_facts(rules: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Model facts, then rule facts whose text (ignoring case) the model did not give."""
    said = model.select(key, F.lower("content").alias("_text")).distinct()
    extra = rules.withColumn("_text", F.lower("content")).join(
        said, [key, "_text"], "left_anti").drop("_text")
    return model.unionByName(extra, allowMissingColumns=True)


def merge_entities(rules: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Entities by normalised name; the last one given wins, empty names drop out."""
    both = rules.withColumn("_side", F.lit(0)).unionByName(model.withColumn("_side", F.lit(1)))
    named = both.withColumn(
        "canonical_name", normalized_entity_name(F.col("canonical_name"))).where(
        F.length("canonical_name") > 0)
    last = [F.col("_side").desc(), F.col("position").desc()]
    return first_per_key(named, [key, "canonical_name"], last).drop("_side")


def distinct_edges(edges: DataFrame, key: str) -> DataFrame:
    """Edges with normalised relation, the first of each (source, relation, target)."""
    named = edges.withColumn("relation", normalized_relation(F.col("relation")))
    return first_per_key(named, [key, "source_name", "relation", "target_name"],
                         [F.col("position")])


def resolve_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Replace entity names by ids; an edge with an unknown end drops out."""
    ids = entities.select("tenant_id", "canonical_name", "entity_id")
    source = ids.select("tenant_id", F.col("canonical_name").alias("source_name"),
                        F.col("entity_id").alias("source_id"))
    target = ids.select("tenant_id", F.col("canonical_name").alias("target_name"),
                        F.col("entity_id").alias("target_id"))
    return edges.join(source, ["tenant_id", "source_name"]).join(
        target, ["tenant_id", "target_name"])


def mark_contradictions(facts: DataFrame) -> DataFrame:
    """Status of each extracted fact from its operation."""
    hit = (F.col("operation") == "contradict") & F.col("contradicts_fact_id").isNotNull()
    hit = F.coalesce(hit, F.lit(False))
    return facts.withColumns({
        "contradiction_status": F.when(hit, "active").otherwise("none"),
        "contradicts_id": F.when(hit, F.col("contradicts_fact_id")),
    })

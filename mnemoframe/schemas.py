"""Declared table schemas and the checks rows must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions import fixed_values as fv

FACTS = """fact_id string, tenant_id string, scope string, scope_id string, session_id string,
 content string, embedding array<float>, lineage_id string, version int, valid_from timestamp,
 valid_until timestamp, importance double, frequency int, last_accessed timestamp,
 decay_score double, contradiction_status string, contradicts_id string, source_type string,
 confidence double, original_content string, extraction_id string, tags array<string>,
 metadata string, event_date timestamp, document_date timestamp, source_chunk string,
 created_at timestamp"""
ENTITIES = """entity_id string, tenant_id string, canonical_name string, entity_type string,
 properties string, embedding array<float>, created_at timestamp"""
EDGES = """edge_id string, tenant_id string, source_id string, target_id string,
 relation string, edge_type string, weight double, confidence double, valid_from timestamp,
 valid_until timestamp, fact_id string, metadata string"""
FACT_ENTITIES = "fact_id string, entity_id string, role string"
EXTRACTIONS = """extraction_id string, tenant_id string, scope string, scope_id string,
 input_type string, status string, facts_created long, entities_created long,
 edges_created long, created_at timestamp"""
ACCESSES = """access_id string, tenant_id string, fact_id string, query string,
 retrieval_method string, similarity_score double, rank_position int, trigger_id string,
 was_useful boolean, feedback_type string, was_corrected boolean, accessed_at timestamp"""
MESSAGES = """tenant_id string, scope string, scope_id string, session_id string,
 turn_number long, role string, content string, extraction_id string, created_at timestamp"""

TABLES = {"facts": FACTS, "entities": ENTITIES, "edges": EDGES,
          "fact_entities": FACT_ENTITIES, "extractions": EXTRACTIONS,
          "memory_accesses": ACCESSES, "session_messages": MESSAGES}

FIELD_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "date": "date"}


def unit_interval(column: str) -> Column:
    return F.col(column).between(0.0, 1.0)


def fact_rules(dim: int | None = None) -> dict[str, Column]:
    """Checks of a fact by name; a row passes when the check is true."""
    rules = {
        "scope": F.col("scope").isin(*fv.SCOPES),
        "content_length": F.length("content").between(1, 50_000),
        "source_chunk_length": F.coalesce(F.length("source_chunk") <= 10_000, F.lit(True)),
        "importance": unit_interval("importance"),
        "interval": F.col("valid_until").isNull() | (F.col("valid_until") >= F.col("valid_from")),
    }
    if dim is not None:
        rules["embedding_dim"] = F.col("embedding").isNull() | (F.size("embedding") == dim)
    return rules


def edge_rules() -> dict[str, Column]:
    return {"edge_type": F.col("edge_type").isin(*fv.EDGE_TYPES), "weight": F.col("weight") >= 0}


def violations(rows: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """``row_id, rule`` for every failed check; a null result is a failure."""
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in rules.items()]))
    return rows.select(row_id, F.explode(failed).alias("rule"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def domain_properties(entities: DataFrame, fields: list[tuple[str, str, bool]]) -> DataFrame:
    """Typed columns of a domain entity type read from its JSON properties.

    ``fields`` lists (name, type, required); ``valid`` tells whether all required
    fields are there.
    """
    schema = ", ".join(f"`{n}` {FIELD_TYPES[t]}" for n, t, _ in fields)
    read = entities.withColumn("_p", F.from_json("properties", schema))
    required = [F.col(f"_p.{n}").isNotNull() for n, _, must in fields if must]
    valid = reduce(lambda a, b: a & b, required, F.lit(True))
    return read.select(*entities.columns, *[F.col(f"_p.{n}").alias(n) for n, _, _ in fields],
                       valid.alias("valid"))

"""The ingest job: raw inputs to facts, entities, links, edges, ledger and usage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions.hashing import input_hash
from mnemoframe.functions.text import normalized_entity_name, search_terms, strip_html
from mnemoframe.functions.vectors import hashing_embedding
from mnemoframe.operators import extraction, linking, mutations
from mnemoframe.operators.vector_search import deduplicate
from mnemoframe.plans.search import Memory
from mnemoframe.session import cut_lineage

SCOPE = ("tenant_id", "scope", "scope_id")


@dataclass(frozen=True)
class Ingested:
    """New rows per table; appending them is up to the caller."""

    facts: DataFrame
    entities: DataFrame
    fact_entities: DataFrame
    edges: DataFrame
    extractions: DataFrame
    usage: DataFrame


def new_inputs(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Inputs not processed before, by (tenant, hash); a failed one may come again."""
    hashed = inputs.withColumn("data", strip_html(F.col("data"))).withColumn(
        "extraction_id", input_hash(F.col("input_type"), F.col("data")))
    done = ledger.where(F.col("status") != "failed")
    return mutations.only_new(done, hashed, "tenant_id", "extraction_id")


def default_embedding(text: Column) -> Column:
    return hashing_embedding(search_terms(text))


def ingest(inputs: DataFrame, memory: Memory, ledger: DataFrame, now: Column,
           embed: Callable[[Column], Column] = default_embedding,
           model_facts: Callable[[DataFrame], DataFrame] | None = None,
           links_page: int | None = None, links_per_entity: int | None = None) -> Ingested:
    """Extract, deduplicate, link and account for a batch of inputs.

    ``inputs`` holds the scope, ``session_id, input_type, data`` and, if the order of the
    inputs counts, ``input_order``: of equal statements of a scope the first stays.  ``model_facts`` is
    the slot for a model-based extractor: it gets the inputs and returns rows like
    the rule-based ones, keyed by ``extraction_id``.
    """
    fresh = new_inputs(inputs, ledger)
    ruled = extraction.extract(fresh, "data")
    found = ruled if model_facts is None else extraction.merge_facts(
        ruled, model_facts(fresh), "extraction_id")
    named = found.withColumns({
        "query_id": F.sha2(F.concat_ws(
            "|", "tenant_id", "extraction_id", F.col("position").cast("string")), 256),
        "embedding": embed(F.col("content")), "operation": F.lit("add"),
        "_order": F.struct("input_order" if "input_order" in inputs.columns else "extraction_id", "position")})
    decided = deduplicate(named, memory.facts, order="_order").where(F.col("operation") != "noop")
    # written once: links, cross links and the ledger all read the new facts
    facts = cut_lineage(mutations.new_facts(decided.select(
        F.col("query_id").alias("fact_id"), *SCOPE, "session_id", "content", "embedding",
        F.col("query_id").alias("lineage_id"), "importance", "confidence",
        F.lit("conversation").alias("source_type"), F.col("original").alias("original_content"),
        "extraction_id", F.split("tags", ",").alias("tags"), now.alias("document_date")), now))

    spans = fresh.select("tenant_id", F.explode(
        extraction.named_spans(F.col("data"))).alias("name"))
    mentioned = spans.select("tenant_id", normalized_entity_name(F.col("name")).alias(
        "canonical_name"), F.lit("concept").alias("entity_type")).where(
        F.length("canonical_name") > 0)
    users = fresh.select("tenant_id", F.lit("user").alias("canonical_name"),
                         F.lit("person").alias("entity_type"))
    known = memory.entities
    missing = mutations.only_new(known, mentioned.unionByName(users), "tenant_id",
                                 "canonical_name", "entity_type")
    entities = missing.withColumns({
        "entity_id": F.sha2(F.concat_ws("|", "tenant_id", "canonical_name", "entity_type"), 256),
        "created_at": now})
    asked = mentioned.unionByName(users).select("tenant_id", "canonical_name").distinct()
    ids = ["tenant_id", "canonical_name", "entity_id"]
    relevant = known.select(*ids).unionByName(entities.select(*ids)).join(
        asked, ["tenant_id", "canonical_name"], "left_semi")
    links = linking.mentioned_entities(facts, relevant).select(
        "fact_id", "entity_id", F.lit("mentioned").alias("role"))
    columns = ["tenant_id", "fact_id", "content", "tags", "created_at"]
    everything = memory.facts.select(*columns).withColumn(
        "fact_id", F.col("fact_id").cast("string")).unionByName(facts.select(*columns))
    all_links = memory.fact_entities.select(
        F.col("fact_id").cast("string").alias("fact_id"), "entity_id").unionByName(
        links.select("fact_id", "entity_id"))
    edges = linking.cross_links(facts, everything, all_links, relevant, links_page, links_per_entity)

    made = facts.groupBy("tenant_id", "extraction_id").agg(
        F.count(F.lit(1)).alias("facts_created"))
    extractions = fresh.select("extraction_id", *SCOPE, "input_type").join(
        made, ["tenant_id", "extraction_id"], "left").withColumns({
            "facts_created": F.coalesce("facts_created", F.lit(0)),
            "status": F.lit("completed"), "created_at": now})
    usage = extractions.groupBy("tenant_id", F.date_trunc("month", now).alias(
        "period_start")).agg(F.count(F.lit(1)).alias("extractions"))
    return Ingested(facts, entities, links, edges, extractions, usage)

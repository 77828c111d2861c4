"""What an agent calls: remember, recall, feedback, status, dismiss, stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.operators import lookups, mutations, profiles, ranking
from mnemoframe.plans.ingest import Ingested, ingest
from mnemoframe.plans.search import Memory, SearchOptions, search
from mnemoframe.session import cut_lineage
from mnemoframe.sources.catalog import MemoryCatalog


def memory_of(catalog: MemoryCatalog) -> Memory:
    return Memory(*[catalog.table(n) for n in ("facts", "entities", "edges", "fact_entities")])


def remember(catalog: MemoryCatalog, inputs: DataFrame, now: Column) -> Ingested:
    """Ingest a batch of inputs and append everything it produced."""
    new = ingest(inputs, memory_of(catalog), catalog.table("extractions"), now)
    edges = new.edges.withColumns({
        "edge_id": F.sha2(F.concat_ws("|", "source_id", "source_fact_id", "target_fact_id"), 256),
        "fact_id": F.col("source_fact_id"), "valid_from": now,
        "metadata": F.to_json(F.struct(
            F.col("source_fact_id").alias("sourceFactId"),
            F.col("target_fact_id").alias("targetFactId"), F.col("entity_name").alias("entity")))})
    # all results are fixed before the first append changes a table they read
    fixed = {"entities": cut_lineage(new.entities),
             "fact_entities": cut_lineage(new.fact_entities), "edges": cut_lineage(edges),
             "facts": new.facts, "extractions": cut_lineage(new.extractions)}
    for name, rows in fixed.items():
        catalog.append(name, rows)
    return new


def recall(catalog: MemoryCatalog, queries: DataFrame, now: Column,
           options: SearchOptions = SearchOptions(), max_tokens: int | None = None) -> DataFrame:
    """Search results with the tenant's priorities first, within a token budget."""
    facts = catalog.table("facts")
    found = search(queries, memory_of(catalog), now, options).join(
        queries.select("query_id", "tenant_id"), "query_id").select(
        "query_id", "tenant_id", "fact_id", "score")
    placed = profiles.place_recalled(profiles.recalled(found, facts))
    if max_tokens:
        placed = ranking.token_budget(placed, max_tokens, keep_first=True, text=F.col("content"))
    return placed


def give_feedback(catalog: MemoryCatalog, feedback: DataFrame, now: Column) -> None:
    """Record feedback on the latest access of each fact and move its importance."""
    accesses = catalog.table("memory_accesses")
    catalog.change("memory_accesses", accesses.join(feedback.select("fact_id"), "fact_id", "left_semi"),
                   lambda rows: mutations.feedback_on_latest(rows, feedback))
    facts = catalog.table("facts")
    moved = mutations.apply_feedback(facts, feedback, now).select(
        "fact_id", F.col("new_importance").alias("importance"),
        F.col("new_decay_score").alias("decay_score"))
    moved = cut_lineage(moved)
    catalog.change("facts", facts.join(moved, "fact_id", "left_semi"),
                   lambda rows: mutations.update_fields(rows, moved, "fact_id", "importance", "decay_score"))


def edit(catalog: MemoryCatalog, edits: DataFrame, now: Column) -> None:
    """New versions of facts (``fact_id, new_fact_id, new_content``); only their partitions are written."""
    facts = catalog.table("facts")
    catalog.change("facts", facts.join(edits.select("fact_id"), "fact_id", "left_semi"),
                   lambda rows: mutations.edit_facts(rows, edits, now))


def set_metadata(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge JSON fields into the metadata of facts (``fact_id, changes`` as JSON)."""
    kind = "map<string,variant>"
    new = changes.select("fact_id", F.from_json("changes", kind).alias("_new"))
    joined = facts.join(new, "fact_id", "left")
    old = F.from_json(F.coalesce("metadata", F.lit("{}")), kind)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("_new"), k))
    merged = F.to_json(F.map_concat(kept, F.col("_new")))
    return joined.withColumn("metadata", F.when(F.col("_new").isNotNull(), merged).otherwise(
        F.col("metadata"))).select(*facts.columns)


def status_changes(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """Metadata changes for ``tenant_id, priority, status, confidence`` updates."""
    labels = profiles.priority_labels(facts).withColumnRenamed("priority_order", "priority")
    return labels.join(updates, ["tenant_id", "priority"]).select(
        "fact_id", F.to_json(F.struct("status", "confidence")).alias("changes"))


def dismissals(keys: DataFrame, now: Column) -> DataFrame:
    """Metadata changes that hide facts from recall."""
    return keys.select("fact_id", F.to_json(F.struct(
        F.lit(True).alias("dismissed"),
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("dismissedAt"))).alias("changes"))


def stats(catalog: MemoryCatalog) -> dict[str, int]:
    """Exact table sizes."""
    return {"facts": catalog.table("facts").where(lookups.valid_at()).count(),
            "entities": catalog.table("entities").count(), "edges": catalog.table("edges").count()}

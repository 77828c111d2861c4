"""The full search: four candidate streams fused into one answer, for many queries."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions import dates, fixed_values as fv
from mnemoframe.operators import graph, keyword_search, lookups, ranking, triggers
from mnemoframe.operators.vector_search import vector_search
from mnemoframe.session import cut_lineage, stored


@dataclass(frozen=True)
class Memory:
    """The tables a search reads."""

    facts: DataFrame
    entities: DataFrame
    edges: DataFrame
    fact_entities: DataFrame
    triggers: DataFrame | None = None


@dataclass(frozen=True)
class SearchOptions:
    limit: int | None = None
    weights: Mapping[str, float] | None = None
    as_of: Column | None = None
    include_history: bool = False
    token_budget: int | None = None
    max_depth: int = fv.DEFAULT_DEPTH
    max_entities: int = fv.DEFAULT_ENTITIES
    half_life_days: float = fv.HALF_LIFE_DAYS
    norm_k: float = fv.FREQUENCY_NORM


def candidates(queries: DataFrame, memory: Memory, options: SearchOptions) -> DataFrame:
    """Vector, keyword, graph and trigger candidates, in that order, reranked."""
    k = lookups.search_limit(options.limit) * fv.FETCH_MULTIPLIER
    facts, as_of = memory.facts, options.as_of
    near = vector_search(queries, facts, k, fv.COMPOUND_MIN_SIMILARITY, as_of,
                         only_searchable=True)
    worded = keyword_search.keyword_search(queries, facts, k, as_of, only_searchable=True)
    linked = graph.graph_search(queries, memory.entities, memory.edges, facts,
                                memory.fact_entities, k, options.max_depth,
                                options.max_entities, as_of)
    streams = [ranking.stream(near, "vector", "similarity"),
               ranking.stream(worded, "keyword", "keyword_score"),
               ranking.stream(linked, "graph", "graph_score")]
    if memory.triggers is not None:
        # small (queries x their triggers) and read three times
        fired = cut_lineage(
            triggers.matched_triggers(queries, memory.triggers, memory.entities))
        surfaced = triggers.surfaced_facts(fired, queries, memory.triggers, facts,
                                           memory.fact_entities)
        # priority first, then the trigger's own parts: one sortable number
        place = (F.lit(1_000_000) - F.col("priority")) * 10 + F.col("part")
        streams.append(ranking.stream(
            surfaced, "trigger", "vector_score", F.col("trigger_id"), place))
    # the one lookup of fact columns for the whole search, onto a few rows per query
    found = stored(ranking.concat_streams(*streams), "candidates")
    rows = ranking.with_fact_fields(found, facts, (*ranking.FACT_FIELDS, "embedding"))
    return ranking.rerank_streams(rows, queries)


def search(queries: DataFrame, memory: Memory, now: Column,
           options: SearchOptions = SearchOptions()) -> DataFrame:
    """Ranked facts per query.

    ``queries`` holds ``query_id, tenant_id, scope, scope_id, query, embedding``.
    The result has one row per kept fact with its six signals, score, rank,
    trigger and contradiction.
    """
    limit = lookups.search_limit(options.limit)
    rows = ranking.merge_candidates(candidates(queries, memory, options),
                                    ranking.FACT_FIELDS)
    references = queries.select("query_id", dates.time_reference(
        F.col("query"), now).alias("time_ref"))
    rows = ranking.score_time(rows, references, now)
    rows = ranking.score_memory(rows, now, options.half_life_days, options.norm_k)
    rows = ranking.fuse(rows, limit, options.weights)
    if not options.include_history:
        rows = ranking.newest_per_lineage(rows)
    rows = ranking.drop_updated(rows)
    if options.token_budget:
        rows = ranking.token_budget(rows, options.token_budget)
    # what is left is small, and known to be once it is written
    return ranking.surface_contradictions(stored(rows, "results"), memory.facts)


def access_records(results: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """Access log rows of a search, to append after answering."""
    return results.join(queries.select("query_id", "tenant_id", "query"), "query_id").select(
        "tenant_id", "fact_id", "query",
        F.when(F.col("triggered_by").isNotNull(), F.lit("trigger"))
        .otherwise(F.lit("fusion")).alias("retrieval_method"),
        F.when(F.col("vector_score") > 0, F.col("vector_score")).alias("similarity_score"),
        F.row_number().over(ranking.Window.partitionBy("query_id").orderBy("rank"))
        .alias("rank_position"),
        F.col("triggered_by").alias("trigger_id"), now.alias("accessed_at"))

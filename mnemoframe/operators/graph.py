"""Bounded traversal of the entity graph and the facts it reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.functions import fixed_values as fv
from mnemoframe.functions.scoring import hop_score
from mnemoframe.functions.text import entity_name_candidates
from mnemoframe.operators.grouping import top_k
from mnemoframe.operators.lookups import valid_at
from mnemoframe.session import cut_lineage, stored


def adjacency(edges: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Both directions of every valid edge as ``tenant_id, node, neighbour``."""
    valid = edges.where(valid_at(as_of) & (F.col("source_id") != F.col("target_id")))
    return valid.select("tenant_id", F.inline(F.array(
        F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour")),
        F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour")))))


def seed_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of the tenant that a query names: ``query_id, tenant_id, entity_id``."""
    names = queries.select("query_id", "tenant_id", F.explode(
        entity_name_candidates(F.col("query"))).alias("canonical_name"))
    named = entities.select("tenant_id", "canonical_name", "entity_id")
    return named.join(names, ["tenant_id", "canonical_name"]).select(
        "query_id", "tenant_id", "entity_id").distinct()


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int = fv.DEFAULT_DEPTH,
             max_entities: int = fv.DEFAULT_ENTITIES, as_of: Column | None = None,
             salts: int = 8, many_seeds: bool = False) -> DataFrame:
    """Entities within ``max_depth`` hops with their least depth, nearest first.

    At most ``max_entities`` per query, in (depth, id) order.  Capping after each
    hop gives the same answer as capping at the end, because deeper entities sort
    after every entity already kept; so the state never exceeds queries x cap
    rows.  A hub's neighbours are spread over ``salts`` tasks, and each task sends
    on only neighbours that can still make the cap (a kept entity shows up at two
    depths at most, hence twice the cap).

    With ``many_seeds`` the edges are written once more, with each node's first twice the cap
    neighbours only: of these at most the cap were reached before, so a later one is behind
    as many new ones and never makes the cap.  The result is the same; it pays where hubs are
    met from many queries, and costs a shuffle of all edges.
    """
    if max_depth < 0 or max_entities < 1:
        raise ValueError("a depth below 0 or no entities")
    cap = max_entities
    links = adjacency(edges, as_of)
    if many_seeds:
        links = stored(top_k(links.distinct(), ["tenant_id", "node"], [F.col("neighbour")], 2 * cap), "links")
    links = links.withColumn(
        "_salt", F.pmod(F.xxhash64("neighbour"), F.lit(salts)).cast("int"))
    nearest_first = [F.col("depth"), F.col("node")]
    state = top_k(seeds.select("query_id", "tenant_id", F.col("entity_id").alias("node"),
                               F.lit(0).alias("depth")), ["query_id"], nearest_first, cap)
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    for hop in range(max_depth):
        frontier = state.withColumn("_salt", F.explode(
            F.when(F.col("depth") == hop, every_salt).otherwise(F.array(F.lit(-1)))))
        reached = frontier.join(links, ["tenant_id", "node", "_salt"], "left").select(
            "query_id", "tenant_id", F.inline(F.array(
                F.struct(F.col("node"), F.col("depth")),
                F.struct(F.col("neighbour").alias("node"), F.lit(hop + 1).alias("depth")))))
        rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(*nearest_first))
        reachable = reached.where(F.col("node").isNotNull()).withColumn("_rank", rank).where(
            F.col("_rank") <= 2 * cap)
        state = top_k(
            reachable.groupBy("query_id", "tenant_id", "node").agg(F.min("depth").alias("depth")),
            ["query_id"], nearest_first, cap)
    return state.withColumnRenamed("node", "entity_id")


def traversed_edges(reached: DataFrame, edges: DataFrame, max_depth: int = fv.DEFAULT_DEPTH,
                    as_of: Column | None = None) -> DataFrame:
    """Edges walked by a traversal: both ends reached, one before the last hop."""
    ends = reached.select("query_id", "tenant_id", "entity_id", "depth")
    valid = edges.where(valid_at(as_of) & (F.col("source_id") != F.col("target_id")))
    source = ends.select("query_id", "tenant_id", F.col("entity_id").alias("source_id"),
                         F.col("depth").alias("_from"))
    target = ends.select("query_id", "tenant_id", F.col("entity_id").alias("target_id"),
                         F.col("depth").alias("_to"))
    return (valid.join(source, ["tenant_id", "source_id"])
            .join(target, ["query_id", "tenant_id", "target_id"])
            .where(F.least("_from", "_to") < max_depth).drop("_from", "_to"))


def facts_per_entity(facts: DataFrame, links: DataFrame, n: int,
                     wanted: DataFrame | None = None) -> DataFrame:
    """Most important open facts of each entity: ``entity_id, tenant_id, fact_id, rank``."""
    rows = facts.where(valid_at() & ~F.array_contains("tags", "raw_chunk")).select(
        "tenant_id", "fact_id", "importance", "created_at")
    linked = links.select("entity_id", "fact_id")
    if wanted is not None:
        linked = linked.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")
    return top_k(rows.join(linked, "fact_id"), ["tenant_id", "entity_id"],
                 [F.col("importance").desc(), F.col("created_at").desc(), F.col("fact_id")],
                 n, rank="rank")


def graph_facts(reached: DataFrame, facts: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Facts of the reached entities scored by nearness, best ``k`` per query.

    An entity contributes max(3, k / number of entities) facts.  Facts are ranked
    once per entity, not once per query.
    """
    count = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    budgeted = reached.withColumn(
        "_budget", F.greatest(F.lit(3), F.ceil(F.lit(float(k)) / count)).cast("int"))
    ranked = facts_per_entity(facts, links, max(3, k), reached)
    scored = (ranked.join(budgeted, ["tenant_id", "entity_id"])
              .where(F.col("rank") <= F.col("_budget"))
              .groupBy("query_id", "fact_id")
              .agg(F.max(hop_score(F.col("depth"))).alias("graph_score")))
    return top_k(scored, ["query_id"], [F.col("graph_score").desc(), F.col("fact_id")], k,
                 rank="position")


def graph_search(queries: DataFrame, entities: DataFrame, edges: DataFrame, facts: DataFrame,
                 links: DataFrame, k: int, max_depth: int = fv.DEFAULT_DEPTH,
                 max_entities: int = fv.DEFAULT_ENTITIES,
                 as_of: Column | None = None) -> DataFrame:
    """Facts near the entities a query names, whatever their scope."""
    # read twice below, and never more than queries x max_entities rows
    reached = cut_lineage(traverse(
        seed_entities(queries, entities), edges, max_depth, max_entities, as_of))
    return graph_facts(reached, facts, links, k)


def graph_view(entities: DataFrame, edges: DataFrame, links: DataFrame,
               types: list[str] | None = None, term: str | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """Nodes with their fact counts, and links whose two ends are shown."""
    counts = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("fact_count"))
    nodes = entities.join(counts, "entity_id", "left").withColumn(
        "fact_count", F.coalesce("fact_count", F.lit(0)))
    if types is not None:
        nodes = nodes.where(F.col("entity_type").isin(types))
    if term:
        nodes = nodes.where(F.lower("canonical_name").contains(term.lower()))
    shown = nodes.select("tenant_id", "entity_id")
    kept = edges.join(shown.withColumnRenamed("entity_id", "source_id"),
                      ["tenant_id", "source_id"], "left_semi")
    kept = kept.join(shown.withColumnRenamed("entity_id", "target_id"),
                     ["tenant_id", "target_id"], "left_semi")
    return nodes, kept

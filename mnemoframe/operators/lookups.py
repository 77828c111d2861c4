"""Lookups of facts, entities, edges, sessions and control rows, set at a time.

A lookup takes a DataFrame of keys instead of one key, so a single plan serves
any number of callers.  Key sets are joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions import fixed_values as fv
from mnemoframe.operators.grouping import keyset_page, top_k

SCOPE = ("tenant_id", "scope", "scope_id")


def in_scope(facts: DataFrame, tenant_id: str, scope: str, scope_id: str) -> DataFrame:
    """Tenant, scope and scope id equality; ``*`` as scope id means any."""
    out = facts.where((F.col("tenant_id") == tenant_id) & (F.col("scope") == scope))
    return out if scope_id == "*" else out.where(F.col("scope_id") == scope_id)


def valid_at(as_of: Column | None = None) -> Column:
    """Open version now, or the version valid at a point (start included, end not)."""
    if as_of is None:
        return F.col("valid_until").isNull()
    return (F.col("valid_from") <= as_of) & (
        F.col("valid_until").isNull() | (F.col("valid_until") > as_of))


def searchable() -> Column:
    """Facts a search may return: not pushed in by the API and not a raw chunk."""
    return (F.col("source_type") != "api") & ~F.array_contains("tags", "raw_chunk")


def by_ids(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is in the key set; order is not defined."""
    return rows.join(keys.select(*on), list(on), "left_semi")


def lineage_versions(facts: DataFrame, lineages: DataFrame) -> DataFrame:
    """All versions of the requested lineages in version order."""
    return by_ids(facts, lineages, "tenant_id", "lineage_id").orderBy(
        "tenant_id", "lineage_id", "version", "created_at", "fact_id")


def scope_pages(facts: DataFrame, requests: DataFrame, include_invalid: bool = True) -> DataFrame:
    rows = facts if include_invalid else facts.where(valid_at())
    return keyset_page(rows, requests, SCOPE, "created_at", "fact_id")


def entity_pages(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """Entities of a tenant, oldest first."""
    return keyset_page(entities, requests, ("tenant_id",), "created_at", "entity_id",
                       newest_first=False)


def entity_fact_pages(facts: DataFrame, links: DataFrame, requests: DataFrame) -> DataFrame:
    """Facts linked to an entity, newest first, closed versions included."""
    linked = links.select("entity_id", "fact_id").join(facts, "fact_id")
    return keyset_page(linked, requests, ("tenant_id", "entity_id"), "created_at", "fact_id")


def entities_of_facts(links: DataFrame, entities: DataFrame, keys: DataFrame) -> DataFrame:
    return by_ids(links, keys, "fact_id").join(entities, "entity_id")


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges touching a node at either end, once per (node, edge).

    Written as two equi-joins; an OR condition would plan a nested loop.
    """
    keys = nodes.select("tenant_id", F.col("entity_id").alias("_node")).distinct()
    outgoing = edges.withColumn("_node", F.col("source_id"))
    incoming = edges.where(F.col("source_id") != F.col("target_id")).withColumn(
        "_node", F.col("target_id"))
    return (outgoing.unionByName(incoming).join(keys, ["tenant_id", "_node"], "left_semi")
            .withColumnRenamed("_node", "entity_id"))


def search_limit(requested: int | None) -> int:
    """The limit asked for, or the default; one that is not positive is an error."""
    limit = fv.DEFAULT_LIMIT if requested is None else requested
    if limit < 1:
        raise ValueError(f"a limit of {limit}")
    return limit


def unextracted(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("extraction_id").isNull())


def active_triggers(triggers: DataFrame) -> DataFrame:
    return triggers.where("active").orderBy(F.col("priority").desc(), "trigger_id")


def subscribed(webhooks: DataFrame, event: Column) -> DataFrame:
    return webhooks.where(F.col("active") & F.array_contains("events", event))


def keys_allowing(api_keys: DataFrame, scope: str, now: Column) -> DataFrame:
    """API keys that are active, unexpired and carry the scope (admin covers all)."""
    allowed = F.array_contains("scopes", scope) | F.array_contains("scopes", "admin")
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return api_keys.where(F.col("active") & live & allowed)


def active_sessions(sessions: DataFrame) -> DataFrame:
    """Newest open session of each scope."""
    return top_k(sessions.where(F.col("ended_at").isNull()), SCOPE,
                 [F.col("started_at").desc(), F.col("session_id").desc()], 1)


def json_field(column: str, field: str) -> Column:
    return F.get_json_object(F.col(column), f"$.{field}")


def with_priority(facts: DataFrame) -> DataFrame:
    return facts.where(json_field("metadata", "priority_order").isNotNull())


def not_dismissed() -> Column:
    return F.coalesce(json_field("metadata", "dismissed"), F.lit("false")) != "true"

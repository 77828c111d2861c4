"""Trigger conditions of any depth as rows, and the facts triggers surface.

A condition is flattened into nodes, level by level.  Its tests are looked up from the
queries' side: words through their first characters, entity types through the tenant's,
vectors by blocks.  Only tests that hold make rows, and rows go up from the innermost
level to the outermost, so a query meets no trigger that it cannot fire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.operators.grouping import salted_join, top_k
from mnemoframe.operators.lookups import SCOPE, valid_at
from mnemoframe.operators.vector_search import similar_pairs, vector_search
from mnemoframe.session import stored

TEMPLATE_MATCHES = 5
FACTS_PER_ENTITY = 10
_STRING = r'"(?:[^"\\]|\\.)*"'
_PIECE = 4  # characters of a word that it is looked up by
_NODE = ("trigger_id", "path")


def condition_errors(triggers: DataFrame) -> DataFrame:
    """``tenant_id, trigger_id, condition`` of the active triggers whose condition is no JSON; they never fire."""
    return triggers.where(F.col("active") & F.col("condition").isNotNull() & F.try_parse_json("condition").isNull()).select(
        "tenant_id", "trigger_id", "condition")


def nesting(condition: Column) -> Column:
    """How deep the braces of a JSON text are nested."""
    braces = F.regexp_replace(F.regexp_replace(condition, _STRING, ""), r"[^{}]", "")
    steps = F.transform(F.split(braces, ""), lambda b: F.when(b == "{", 1).when(b == "}", -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda at, step: F.struct(
        (at["now"] + step).alias("now"), F.greatest(at["most"], at["now"] + step).alias("most")), lambda at: at["most"])


def condition_nodes(triggers: DataFrame) -> tuple[DataFrame, int]:
    """The nodes of all conditions, and the number of their levels.

    A node is a condition or a part of its AND or OR: scope, ``trigger_id``, ``path`` (places
    of the parts on the way to it), ``depth``, ``operator`` with ``parts`` of them, or none and the tests of a leaf:
    ``words``, ``types``, ``text, threshold``.  A non-empty AND decides alone, then a non-empty OR.
    """
    levels = triggers.where("active").agg(F.max(nesting(F.col("condition")))).first()[0] or 0

    def read(path: str, kind: str) -> Column:
        return F.try_variant_get("_condition", f"$.{path}", kind)

    some = triggers.where("active").select(
        *SCOPE, "trigger_id", "text_vectors", F.lit("").alias("path"), F.try_parse_json("condition").alias("_condition"))
    found = []
    for depth in range(max(levels, 1)):
        all_of, any_of = read("AND", "array<variant>"), read("OR", "array<variant>")
        some = some.withColumn("operator", F.when(F.size(all_of) > 0, "AND").when(F.size(any_of) > 0, "OR")).withColumn(
            "_parts", F.when(F.col("operator") == "AND", all_of).when(F.col("operator") == "OR", any_of))
        none = F.array().cast("array<string>")
        leaf = F.col("operator").isNull()
        found.append(some.select(
            *SCOPE, "trigger_id", "path", F.lit(depth).alias("depth"), "operator", F.size("_parts").alias("parts"),
            F.when(leaf, F.concat(F.coalesce(read("topic_match", "array<string>"), none),
                                  F.coalesce(read("keyword_any", "array<string>"), none))).alias("words"),
            F.when(leaf, F.coalesce(read("entity_present", "array<string>"), none)).alias("types"),
            F.when(leaf, read("semantic_similarity.threshold", "double")).alias("threshold"),
            F.when(leaf, F.try_element_at("text_vectors", F.coalesce(
                read("semantic_similarity.text", "string"), F.lit("")))).alias("embedding")))
        some = some.where(F.col("operator").isNotNull()).select(
            *SCOPE, "trigger_id", "text_vectors", "path", F.posexplode("_parts").alias("_place", "_condition")).withColumn(
            "path", F.concat("path", F.lit("."), F.col("_place"))).drop("_place")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return stored(nodes, "condition-nodes"), len(found)


def _leaves_that_hold(queries: DataFrame, nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """``query_id, trigger_id, path, depth`` of the leaves that some test of theirs holds for."""
    leaves = nodes.where(F.col("operator").isNull())
    out = ["query_id", *_NODE, "depth"]
    scoped = queries.select(*SCOPE, "query_id")

    words = leaves.select(*SCOPE, *_NODE, "depth", F.explode(F.array_distinct("words")).alias("word")).where(
        F.col("word").isNotNull()).withColumn("word", F.lower("word")).withColumn("piece", F.substring("word", 1, _PIECE))
    text = F.lower("query")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda at: F.array(
        *[F.substring(text, at, F.lit(n)) for n in range(_PIECE + 1)])))
    cut = queries.select(*SCOPE, "query_id", F.explode(F.array_distinct(pieces)).alias("piece"))
    named = (salted_join(cut, words, [*SCOPE, "piece"], "query_id").drop("piece")
             .join(queries.select("query_id", text.alias("_text")), "query_id")
             .where(F.contains("_text", "word")).select(*out))

    held = entities.select("tenant_id", F.lower("entity_type").alias("type")).distinct()
    typed = (leaves.select(*SCOPE, *_NODE, "depth", F.explode("types").alias("type"))
             .withColumn("type", F.lower("type")).join(held, ["tenant_id", "type"], "left_semi")
             .select(*SCOPE, *_NODE, "depth").distinct())
    present = salted_join(scoped, typed, SCOPE, "query_id").select(*out)

    empty = F.array().cast("array<float>")  # a missing vector is as near as 0
    asked = queries.withColumn("embedding", F.coalesce("embedding", empty))
    compared = leaves.where(F.col("threshold").isNotNull()).select(
        *SCOPE, F.struct(*_NODE, "depth", "threshold").alias("leaf"), F.coalesce("embedding", empty).alias("embedding"))
    close = similar_pairs(asked, compared, SCOPE, "leaf", -1.0).where(
        F.col("similarity") >= F.col("leaf.threshold")).select("query_id", "leaf.trigger_id", "leaf.path", "leaf.depth")
    return named.unionByName(present).unionByName(close).distinct()


def matched_triggers(queries: DataFrame, triggers: DataFrame, entities: DataFrame) -> DataFrame:
    """``query_id, trigger_id, priority`` of the active triggers a query fires.

    Conditions may be nested to any depth.  One that is no JSON, and an empty one, never fires
    and leaves the others alone; ``condition_errors`` lists the former.
    """
    nodes, levels = condition_nodes(triggers)
    held = stored(_leaves_that_hold(queries, nodes, entities), "held-leaves")  # read once a level
    above = nodes.where(F.col("operator").isNotNull()).select(*_NODE, "depth", "operator", "parts")
    level = held.where(F.col("depth") == levels - 1) if levels > 1 else held
    for depth in range(levels - 2, -1, -1):
        met = (level.withColumn("path", F.regexp_replace("path", r"\.[0-9]+$", ""))
               .groupBy("query_id", *_NODE).agg(F.count(F.lit(1)).alias("_met"))
               .join(above.where(F.col("depth") == depth), list(_NODE))
               .where((F.col("operator") == "OR") | (F.col("_met") == F.col("parts"))))
        level = met.select("query_id", *_NODE, "depth").unionByName(held.where(F.col("depth") == depth))
    return level.join(triggers.select("trigger_id", "priority"), "trigger_id").select(
        "query_id", "trigger_id", "priority")


def surfaced_facts(matches: DataFrame, queries: DataFrame, triggers: DataFrame,
                   facts: DataFrame, links: DataFrame, facts_per_entity: int = FACTS_PER_ENTITY,
                   template_matches: int = TEMPLATE_MATCHES) -> DataFrame:
    """Open facts that fired triggers bring in.

    ``query_id, fact_id, trigger_id, priority, part, vector_score``; ``part`` orders
    listed facts, facts of listed entities (the newest open ones of each)
    and the template search (its best, the only part with a score).
    """
    fired = matches.join(
        triggers.select("trigger_id", "fact_ids", "entity_ids", "template_embedding"),
        "trigger_id")
    out = ["query_id", "fact_id", "trigger_id", "priority", "part", "vector_score"]
    tenants = queries.select("query_id", "tenant_id")
    open_ids = facts.where(valid_at()).select("tenant_id", "fact_id")
    listed = (fired.select("query_id", "trigger_id", "priority",
                           F.explode("fact_ids").alias("fact_id"))
              .join(tenants, "query_id").join(open_ids, ["tenant_id", "fact_id"])
              .withColumns({"part": F.lit(0), "vector_score": F.lit(0.0)}).select(*out))
    by_entity = (fired.select("query_id", "trigger_id", "priority",
                              F.explode("entity_ids").alias("entity_id"))
                 .join(tenants, "query_id"))
    wanted = links.join(by_entity.select("entity_id").distinct(), "entity_id", "left_semi")
    newest = top_k(
        facts.where(valid_at()).select("tenant_id", "fact_id", "created_at").join(wanted, "fact_id"),
        ["tenant_id", "entity_id"], [F.col("created_at").desc(), F.col("fact_id").desc()],
        facts_per_entity)
    linked = (salted_join(by_entity, newest, ["tenant_id", "entity_id"], "query_id")
              .withColumns({"part": F.lit(1), "vector_score": F.lit(0.0)}).select(*out))
    templates = (fired.where(F.col("template_embedding").isNotNull())
                 .join(queries.select("query_id", *SCOPE), "query_id")
                 .select(F.struct("query_id", "trigger_id", "priority").alias("query_id"),
                         *SCOPE, F.col("template_embedding").alias("embedding")))
    found = vector_search(templates, facts, template_matches)
    searched = found.select(
        "query_id.query_id", "fact_id", "query_id.trigger_id", "query_id.priority",
        F.lit(2).alias("part"), F.col("similarity").alias("vector_score"))
    return listed.unionByName(linked).unionByName(searched)

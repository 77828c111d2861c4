"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemoframe.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, component`` (the smallest node reachable) for each node of ``edges`` (``a, b``).

    Each round a node takes the least label among its own and its neighbours', then the
    label of that label, until nothing changes.  Rounds are written to the shared folder;
    a node with many edges is reduced where its edges lie before they meet.
    """
    both = store(
        edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a"))
        .toDF("a", "b").distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(
        F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        heard = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a").agg(F.min("component").alias("heard")))
        lowered = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("node").alias("of"), F.col("component").alias("further"))
        stepped = store(
            lowered.join(jump, lowered["component"] == jump["of"], "left")
            .select("node", "before", F.least("component", "further").alias("component")), "labels")
        labels = stepped.select("node", "component")
        if stepped.filter("before <> component").isEmpty():
            return labels

"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest.

    In each round every node takes the smallest label among its neighbours', then the label
    of its label, so that long chains shorten by halves. Messages are reduced before they
    are shuffled, and both sides of every join are plain tables, so a node with very many
    neighbours can be split over tasks. Rounds end when no label changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = (
            both.join(labels, both["a"] == labels["node"])
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("root").alias("heard"))
        )
        lower = stored(labels.join(heard, "node").select("node", F.least("root", "heard").alias("root"), F.col("root").alias("was")))
        over = lower.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        jumped = stored(
            lower.join(over, lower["root"] == over["_node"]).select("node", F.col("_root").alias("root"), "was")
        )
        labels = jumped.select("node", "root")
        if jumped.where("root != was").isEmpty():
            return labels

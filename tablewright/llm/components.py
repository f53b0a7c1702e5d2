"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of the edges ``a, b``; the label is the smallest node of the component.

    Every round hangs each node under its smallest neighbour and goes on with the edges between the roots, which are
    fewer each time; the rounds' tables are then chained. Tables of nodes and edges stay distributed.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parents = stored(parents.select("node", F.least("node", "parent").alias("parent")), "parents")
        labels = parents.withColumnRenamed("parent", "label") if labels is None else stored(
            labels.join(parents, labels["label"] == parents["node"], "left").select(labels["node"], F.coalesce("parent", "label").alias("label")), "labels")
        ends = [parents.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("pa <> pb")
        edges = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label"))
    return labels

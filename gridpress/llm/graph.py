"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; two nodes share a label iff a path joins them.

    ``edges`` has long columns a, b. Each round maps every node to the
    smallest of itself and its neighbours and contracts the edges, so chains
    shrink geometrically when ids are hashes. Each round's tables are written
    to the shared scratch folder; the driver sees no edge.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stage(edges, "edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        to = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "hops")
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            labels = labels.join(to, labels.label == to.a, "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = stage(labels, "labels")
        left = to.select("a", F.col("to").alias("x"))
        right = to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = stage(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels

"""Connected components by distributed union-find, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, uncut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge (null ends and self-edges count as none): root is the
    smallest node reachable. No edges give no rows.

    Each round hooks every node to its smallest neighbour, jumps pointers, and contracts the edges to
    roots; hubs are pre-aggregated before each shuffle and no neighbourhood is ever gathered."""
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = cut(nodes.withColumn("root", F.col("node")))
    while edges.take(1):
        # The smaller end of an edge is the larger one's candidate; smaller ends keep themselves.
        hook = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        for _ in range(2):
            over = hook.select(F.col("node").alias("up"), F.col("up").alias("over"))
            hook = hook.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"))
        hook = cut(hook)
        root = lambda c: F.coalesce(F.col("h.up"), F.col(c))
        h = hook.alias("h")
        moved = edges.join(h, F.col("a") == F.col("h.node"), "left").select(root("a").alias("a"), "b")
        moved = moved.join(h, F.col("b") == F.col("h.node"), "left").select("a", root("b").alias("b")).filter("a <> b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = cut(labels.alias("l").join(h, F.col("l.root") == F.col("h.node"), "left").select("l.node", root("l.root").alias("root")), labels)
        edges = cut(moved, edges)
        uncut(hook)
    uncut(edges)
    return labels

"""Connected components of an undirected graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that can be reached, for every node of ``edges`` (columns a, b; long).

    Every round takes the least label among a node and its neighbours and then jumps to that label's own label, so long
    chains halve. Labels and edges stay in tables; the driver sees the number of changes only. Empty edges: no rows.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = cut(labels)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        took = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        up = labels.select(F.col("node").alias("at"), F.col("component").alias("above"))
        new = cut(took.join(up, took.component == up["at"]).select("node", "before", F.least("component", "above").alias("component")))
        changed = new.filter("component <> before").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels

"""Connected components of a table of links, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import dropped, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of a link; component is the smallest node reachable. Any type with an order will do.

    Each round a node and the node that its label points to take the smallest label next to it, then labels are followed
    one step. Only minima are formed, so nothing grows beyond the links and nodes there are, and rounds grow with the
    logarithm of a chain's length. Joins deal a hub's links by the hub and a large component's nodes by its label;
    adaptive execution splits such partitions. Each round is a written table.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = staged(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    labels = staged(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        near = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("label"))
        near = near.join(labels.select(F.col("node").alias("x"), F.col("label").alias("old")), "x")
        told = labels.select("node", "label").unionByName(near.select(F.col("x").alias("node"), "label")).unionByName(near.select(F.col("old").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
        stepped = told.join(told.select(F.col("node").alias("at"), F.col("label").alias("next")), F.col("label") == F.col("at"))
        after = staged(stepped.join(labels.select("node", F.col("label").alias("old")), "node").select("node", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("changed")), "labels")
        dropped(labels)
        labels = after
    dropped(edges)
    out = labels.select("node", F.col("label").alias("component"))
    out.staged_path = labels.staged_path
    return out

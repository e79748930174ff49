"""Connected components of an edge table, by labels that jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgrain.llm._common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root): root is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label; the old root too gets the smallest label that any
    node under it has found, so whole trees join and rounds grow with the
    logarithm of the longest chain, whatever the order of ids. Labels only
    fall, and rounds go on until none does. Every round is written to the
    shared folder. A node with many edges is summed before the shuffle.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.select("node", "root").join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        hook = step.groupBy(F.col("root").alias("node")).agg(F.min("to").alias("hook"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("jump"))
        least = F.least("to", "jump", "hook")  # hook is null below the roots, which least ignores
        moved = step.join(jump, "to").join(hook, "node", "left").select("node", least.alias("root"), (F.col("root") != least).alias("moved"))
        moved = stored(moved, "labels")
        forget(labels)
        labels = moved
        if labels.filter("moved").isEmpty():
            forget(both)
            return labels.select("node", "root")

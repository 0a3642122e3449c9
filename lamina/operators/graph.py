"""Connected components by the smallest label in reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.sources.scratch import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root of every node of edges (a, b: long); the root is the component's smallest node.

    A round gives each node the smallest label of its neighbours and then its label's own label, so that paths halve.
    Labels are kept in the shared folder between rounds.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("root", "near").alias("new"), "root")
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        moved = stored(hooked.join(jump, "new", "left").select("node", F.coalesce("far", "new").alias("root"), F.col("root").alias("before")), "labels")
        labels = moved.select("node", "root")
        if moved.where("root <> before").isEmpty():
            return labels
    raise ValueError(f"components aren't found after {most_rounds} rounds")

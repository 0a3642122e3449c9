"""Connected components by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import attach, stored

#: Edges that a task contracts at a time.
CHUNK = 1 << 18


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contracted(batches):
    """Edges by stars: each node of CHUNK edges or so with the smallest that they connect it with."""

    def stars(held: list) -> pa.RecordBatch:
        ends = np.concatenate([batch[c].to_numpy() for c in (0, 1) for batch in held])
        nodes, at = np.unique(ends, return_inverse=True)
        root = local_roots(len(nodes), *at.reshape(2, -1))
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node and root of every node that an edge touches. edges: a, b (long), in any number of copies; the root is the component's smallest node.

    Tasks first put stars in place of the edges that they hold. Each round then links every larger neighbour of a node to
    its smallest neighbour, then every smaller one. Neighbours are never gathered: a smallest one is an aggregate that is
    joined back. The aggregate also tells when all that is left are stars (no node has two smaller neighbours, or smaller
    and larger ones), which ends the rounds: none for edges that are stars, a few for shallow trees, the square of the
    logarithm of the size at most. Edges are kept in the shared folder.
    """

    def neighbours(df: DataFrame) -> DataFrame:
        return stored(df.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"), F.count_if(F.col("b") < F.col("a")).alias("smaller")), "neighbours")

    edges = edges.where("a <> b").select("a", "b").mapInArrow(_contracted, "a long, b long")
    edges = stored(edges.distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = neighbours(both)
        if near.where("smaller > 0 and n > 1").isEmpty():
            return near.select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        large = attach(both, near, ["a"], "n", ["low"], ["b"]).where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        small = attach(large, neighbours(large), ["a"], "n", ["low"], ["b"]).select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        edges = stored(small, "edges")
    raise ValueError(f"components aren't found after {most_rounds} rounds")

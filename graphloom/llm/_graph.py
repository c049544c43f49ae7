"""Connected components over DataFrames of edges, by rounds of contraction; nothing comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node that it reaches.

    Nodes are renamed by a bijective hash, so that hooking each node to its smallest neighbour shortens any path in a
    number of rounds that grows with the logarithm of its length. A round hooks, contracts, and keeps only the edges
    between different trees. The tables of each round are written to the shared folder, and removed at
    the end.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("na"), F.col(b).alias("nb"))
    e = stored(e.select(F.xxhash64("na").alias("a"), F.xxhash64("nb").alias("b"), "na", "nb").distinct(), "edges")
    labels = stored(e.select(F.col("a").alias("c"), F.col("na").alias("node")).union(e.select("b", "nb")).distinct(), "labels")
    used = [labels, e]
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("p"))
        up = hooks.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        hooks = stored(hooks.join(up, "p").select("n", F.col("pp").alias("p")), "hooks")
        labels = labels.join(hooks, labels.c == hooks.n, "left").select("node", F.coalesce("p", "c").alias("c"))
        e = e.join(hooks.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a").join(hooks.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b")
        e = stored(e.filter("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        used += [hooks, e]
        if e.isEmpty():
            break
    labels = stored(labels, "labels")
    dropped(*used)
    return labels.join(labels.groupBy("c").agg(F.min("node").alias("component")), "c").select("node", "component")

"""Connected components of a graph that no machine holds, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of each node of ``links`` (a, b): the smallest node that its links reach.

    A large star ties every larger neighbour of a node to the smallest one it knows, a small star every smaller one;
    the number of rounds grows with the logarithm of the longest path. Each round is written to the shared folder, so
    lineage stays short. A node with very many neighbours is one group of a partial aggregation and one row of a join.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(smallest, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        edges = materialise(small.where("a <> b").distinct(), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

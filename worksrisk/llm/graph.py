"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksrisk.session import Staging


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, stage: Staging, name: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node with an edge ``a, b``.

    Alternates large and small stars until nothing changes, so a chain of n nodes takes about
    log n rounds. A node's neighbours are counted and joined, never gathered; joins of hot
    nodes are split by adaptive execution. Each round is staged.
    """
    now = stage.table(f"{name}-0", edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before, i = None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            break
        before, i = state, i + 1
        now, old = stage.table(f"{name}-{i}", _small_star(_large_star(now).distinct()).distinct()), i - 1
        stage.drop(f"{name}-{old}")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

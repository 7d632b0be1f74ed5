"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import stored


def _minima(edges: DataFrame) -> DataFrame:
    """(u, v, m) for each edge seen from both ends; m is the least of u and all its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first: a join of two plain shuffles is one that Spark can split at a node of many neighbours
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v); the label is the least node of its component.

    A large star hangs the greater neighbours of a node on its least
    neighbour, a small star the lesser ones, until nothing changes. A node
    with very many neighbours is a join key on one side only, which Spark
    splits at run time.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        large = _minima(edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each node's edges to lesser ones
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

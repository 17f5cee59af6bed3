"""Connected components by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return tied.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges (u, v) but the smallest of each component, which names it.

    Each turn is written to the shared folder, and turns end when the edges stay
    as they are: stars around the smallest nodes. The number of turns grows with
    the logarithm of the longest path. Minima are aggregated before the shuffle
    and joins are on plain keys, so a node with a third of all edges is one row
    a task here and a split join there; no component is ever gathered.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = saved(edges.select(u.alias("u"), v.alias("v")).where(u != v).distinct(), "edges")
    mark = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    before, seen = None, now.agg(*mark).first()
    while seen != before:
        now = saved(small_star(large_star(now)), "edges")
        before, seen = seen, now.agg(*mark).first()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Connect to the least neighbour: of each node its larger neighbours (large star), or its smaller ones and itself."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    ways = down if small else down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    near = ways.join(least, "u")
    moved = near.select("m", F.col("v").alias("x")) if small else near.where(F.col("v") > F.col("u")).select("m", F.col("v").alias("x"))
    if small:
        moved = moved.unionByName(least.select("m", F.col("u").alias("x")))
    return moved.where(F.col("m") != F.col("x")).select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def _finished(edges: DataFrame) -> bool:
    """Whether distinct edges (a < b) are stars: each b has one a, which is no b itself and so the smallest node."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("below")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("least"))
    return not nodes.agg(F.count_if((F.col("n") > 1) | (F.col("n") > 0) & (F.col("least") == 0))).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b: long); loops and repeats are harmless.

    edges are read several times, so they should be a stored table. Each round is two groupings with map-side minima,
    each with one join, so a node with very many neighbours is no group in one task; the number of rounds grows with
    the logarithm of the longest path.
    """
    now = edges.where(F.col("a") != F.col("b")).select("a", "b")
    while True:
        now = stored(_stars(_stars(now, small=False), small=True), "stars")
        if _finished(now):
            break
    every = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return every.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

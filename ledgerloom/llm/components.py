"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v; the result has that form again."""
    sides = edges.select("u", "v")
    if large:
        sides = sides.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(sides.groupBy("u").agg(F.min("v").alias("m")), "least")  # so that the join has plain shuffles on both sides, of which Spark splits that of a hot node
    met = sides.join(least.hint("merge"), "u").select("u", "v", F.least("u", "m").alias("m") if large else F.col("m"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node of each node's component, for nodes in edges (u, v), u > v.

    Each round is written to the shared folder, so a lost executor costs a round at most. The rounds
    end when the edges are stars and stay so, after a number of rounds that grows with the logarithm of the longest path.
    """
    edges = stored(edges.distinct(), "edges")
    before = None
    while True:
        edges = stored(star(star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())

"""Connected components of an edge table by alternating large and small stars, in DataFrame operations.

Each round joins edges with the least neighbour of their ends, never gathers a node's neighbours, and is written to the
shared folder; rounds end when the edges no longer change. Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node with an edge (a, b); the component is its least node. An error where ``most_rounds``
    rounds do not end it."""
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # What is joined is written first: a join then shuffles both sides itself, and a node with very many neighbours can
        # be split among tasks.
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # Large star: every greater neighbour of u takes the least of u's neighbourhood.
        large = scratch.keep(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: u and its lesser neighbours take the least of them.
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.distinct())
        mark = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        for old in (now, least, large, low):
            scratch.drop(old)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

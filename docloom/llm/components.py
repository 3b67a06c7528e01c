"""Distributed connected components: alternating large-star and small-star rounds.

Nothing is collected but a row count and a checksum per round. Each round is
written to the shared folder, so lineage stays short and a lost executor costs
only the round at hand. The number of rounds grows with the logarithm of the
longest chain. Hubs are met by partial aggregation (minimum per node) and a join
that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node reachable) of every node of ``edges`` (``u, v``; any comparable type).

    Self-loops and null ends are ignored; a node without an edge to another is not listed. An empty table gives an empty table.
    """
    now = materialize(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), "edges", 1)
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_small_star(_large_star(now)), "stars", 1)
        discard(before)
        n = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(n) == mark:
            break
        mark = tuple(n)
    else:
        raise RuntimeError("connected components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

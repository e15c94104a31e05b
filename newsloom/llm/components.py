"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round rewrites the edges so that every node points at a smaller neighbour; when a round changes nothing,
every node points at the smallest node of its component. Rounds are written to shared storage, so that lost
executors cost one round at most. Nothing but the number and a checksum of the edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _least(edges: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour, itself included (a partial aggregate: hubs are summed where they are read).

    It is dealt anew before the join that follows, so that the join's own exchange stands below it on both sides
    and the partition of a hub with many edges can be split.
    """
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition("m", "a")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = down.join(_least(down), "a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b: edges, of a type that can be compared and hashed. Result: node, component (the smallest node reachable); nodes of edges only."""
    now = C.written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if sign == seen or not sign.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen, old = sign, now
        now = C.written(_small_star(_large_star(old)), "stars")
        C.discard(old)

"""Connected components of an edge table, as iterated joins and aggregations.

Each round replaces the edges by shorter ones, in two steps. Large star: every node's larger
neighbours are linked to its smallest neighbour (or itself). Small star: every node's smaller
neighbours and the node are linked to the smallest of them. Links never join two components nor cut
one, and after some rounds (about the logarithm of the diameter) each component is a star around its
smallest node. Rounds go on until the edges stay the same. A hub's links are never gathered: minima
are pre-aggregated, and joins on a hub may be split by adaptive execution. Edges that fill one partition
at most (``FEW``) are kept in one: a round then shuffles nothing, and leaves no file for each pair of
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farglass.runtime import materialise


#: Edges of one partition.
FEW = 50_000


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free hash of an edge table (numeric sum, so it cannot overflow)."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node of its component) for every node of ``edges`` (u, v)."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        # The number of edges never grows: each round puts one in the place of one, and some are equal.
        small_table = state[0] <= FEW
        now = now.coalesce(1) if small_table else now
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = _minima(both).withColumn("m", F.least("u", "m"))
        # u's larger neighbours (v > u) get u's minimum; each stored edge is (larger, smaller).
        large = now.withColumnsRenamed({"u": "w", "v": "u"}).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _minima(large)
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        now = materialise((moved.coalesce(1) if small_table else moved).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

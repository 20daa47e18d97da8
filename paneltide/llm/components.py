"""Connected components by alternating large-star and small-star, as joins over an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.scale import staged

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """For (u, v) the smallest of u and its neighbours, beside every edge. The minimum is combined before
    the exchange; the join back has the same key, and a hot centre is split by the skew join of AQE."""
    low = edges.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(low, edges["u"] == low["_u"]).drop("_u")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, component (the smallest node reachable) for all nodes with an edge.

    A star needs one row a node, so no round holds more rows than edges plus nodes. Rounds end when an
    alternation changes nothing; a path of n nodes takes O(log n) of them. Each round's table is written
    to the shared folder, so a lost executor costs one round at most.
    """
    pairs = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).distinct()
        pairs = staged(small, "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

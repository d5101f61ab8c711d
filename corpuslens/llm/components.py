"""Connected components by alternating stars: no node gathers its neighbours, no list reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first())


def _star(e: DataFrame, large: bool) -> DataFrame:
    both = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = e.unionByName(both) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) of every node of ``edges`` (u, v)."""
    e = cut(edges.select("u", "v").where("u != v").distinct())
    seen = None
    while (now := _digest(e)) != seen and now[0]:
        seen = now
        e = cut(_star(_star(e, True), False))
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

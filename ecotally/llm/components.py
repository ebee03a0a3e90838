"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (u, v); the root is the smallest
    node reachable.

    Alternating large-star and small-star steps; each result is written to
    the shared folder, so the lineage stays short.  Stars around one node are
    joined on that node, where AQE splits a skewed one."""
    cur = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _sum(cur)
    while before[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _sum(cur)
        if now == before:
            break
        before = now
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components by alternating large-star and small-star passes, as DataFrames.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Links stay distributed: each
pass is two aggregations and two joins whose both sides are plain exchanges of written tables, so that
a hub's links are split by adaptive skew handling. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` of each node that has a link; ``root`` is the smallest node of its component.

    Links between a node and itself, repeated links and null ends are ignored. Without links the result is empty.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    cur = materialize(cur, "cc-edges")
    before = None
    while (now := _state(cur)) != before and now[0]:
        before = now
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = materialize(both, "cc-both")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-large")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), "cc-up")
        discard(cur, both, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        cur = materialize(small.where("u <> v").distinct(), "cc-edges")
        discard(large, least)
    return cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

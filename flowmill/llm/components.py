"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node of its component.

    Nulls and loops are left out.  Every round is written to the shared folder; the driver gets one
    checksum a round.  The number of rounds grows with the logarithm of the longest chain.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = cut(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(before)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last:
            break
        last = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

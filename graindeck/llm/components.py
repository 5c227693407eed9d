"""Connected components of a distributed table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one ordered type, nulls and loops ignored. A row (node, component) for each node of a link;
    component is the smallest node reachable. Each round is written, so lineage stays short; rounds grow with the
    logarithm of the longest chain, and go on until no link changes. Nothing but a count and a hash of the links reaches the driver."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v")
        new = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        mark = tuple(new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        dropped(now)
        now = new
        if mark == last:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node of its component.

    Alternates large-star and small-star steps, which at least halve the depth of
    every tree; each pass is two aggregations by node, none holds a component in
    one place.  Loops and repeated edges are harmless; no edges give no rows.
    """
    cur = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: every larger neighbour of u is tied to the least of u's neighbourhood
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small-star: u and its smaller neighbours are tied to the least of them
        small = large.join(low, "u")
        cur = checkpointed(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(cur.select(F.col("v"), F.col("v")).distinct())

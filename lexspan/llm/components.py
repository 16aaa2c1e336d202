"""Connected components of an edge table, by alternating large-star and small-star steps.

Labels and edges stay in DataFrames; each round is cut off by a checkpoint in the shared folder, and the driver sees two
numbers a round. A node is labelled with the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, release


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs, any direction, repeated rows and loops allowed, no nulls. Returns (node, root) for every node that has a link to another."""
    a, b = F.col("a"), F.col("b")
    e = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(hooked.union(small.select("u", "m")).distinct())
        release(edges.sparkSession)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

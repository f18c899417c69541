"""Connected components by alternating large and small stars; no link leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) long -> (node, component): the smallest node of its component, for each node with a link."""
    edges = Stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.df.union(edges.df.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = Stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        down = large.df.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.df.join(down, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges.drop()
        edges = Stored(small, "small")
        large.drop()
        now = tuple(edges.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.df.select(F.col("v"), F.col("v")).distinct())

"""Connected components of a link table, by rounds of joins until no label changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of links (a, b), which are of any orderable type.

    Alternating star rounds: every node's neighbours above it are tied to the smallest neighbour, then those
    below it. The number of rounds grows with the logarithm of the longest path, each is cut to the shared
    folder, and only two numbers of it reach the driver. Self-links and repeated links do no harm; a null node
    has no links.
    """
    edges = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where(F.col("u") != F.col("v")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select("v", "v").distinct())

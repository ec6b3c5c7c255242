"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, forget


def stars(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node that has an edge, ``root`` the smallest node of its component.

    ``edges`` has columns a and b of one orderable type. Each round needs joins and partial
    aggregates only; the rounds grow with the logarithm of the size of a component, not with its
    diameter.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        before, now = now, cut(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small).distinct(), mark[0])
        forget(before)
    raise RuntimeError(f"components not found in {rounds} rounds")

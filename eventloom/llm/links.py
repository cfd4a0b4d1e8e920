"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b), by large-star and small-star rounds.

    Nodes are of any type that has an order. Every round is a written table, and the one before it goes; a round's join may be skewed by a node with many neighbours, which adaptive execution splits.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    state = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first())
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())

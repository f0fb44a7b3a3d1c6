"""Connected components of a link table, by minimum labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .store import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links(a, b)``; component is the smallest id reachable.

    Alternates large-star and small-star: each round replaces links by ones to smaller neighbours, so
    stars around a hot id stay stars, and the number of rounds grows with the logarithm of the longest
    path. Each round is a written table; nothing but a count reaches the driver. A null end or a link
    of an id to itself links nothing.
    """
    edges, state = _observed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large star: every larger neighbour of u is linked to u's smallest neighbour. The smallest ones are written
        # before the join, so that both its sides are plain shuffles, whose hot ids Spark splits over tasks.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: u and its smaller neighbours are linked to the smallest of them. Here u is the larger end, so the links of
        # a hot centre are keyed by its many neighbours.
        lower = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        before = state
        small, state = _observed(lower.select(ends.alias("e")).select("e.*").where("a <> b").distinct(), "small")
        drop_stored(least)
        drop_stored(edges)
        edges = small
        if state == before:
            break
    labels = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _observed(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """The written table, and the number and sums of hashes of its edges: equal where, and but for chance only where, the edges are."""
    seen = Observation()
    one, two = F.xxhash64("a", "b"), F.xxhash64("b", "a")
    sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(one.cast("decimal(38,0)")).alias("y"), F.sum(two.cast("decimal(38,0)")).alias("z")]
    return stored(edges.observe(seen, *sums), name), seen.get

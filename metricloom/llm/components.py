"""Connected components over links that no single task or the driver could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricloom.llm.tables import settle


def stars(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that links (``a`` > ``b``) reach; only nodes with a link, roots left out.

    Alternates two steps until nothing changes: every larger neighbour of a node is linked to the smallest
    neighbour, then every smaller one is. A node's neighbours are never gathered; only their minimum is, which is
    summed up before the shuffle, and joined back to the links.
    """
    current = settle(links.select("a", "b").filter("a > b").distinct(), "links")
    state = None
    while (now := _state(current)) != state:
        state = now
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = settle(down.union(least).distinct(), "links")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

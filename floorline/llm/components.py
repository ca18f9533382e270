"""Connected components by alternating large-star and small-star rounds, all of them joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """``edges`` (u > v). Large star: larger neighbours go to the least one; small star: the smaller ones and u itself."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``links`` (a, b) of longs to (node, root): the least node that each linked node reaches.

    Nodes without a link to another don't come back. A hub is split by skew joins: its links are aggregated before
    they are shuffled and never gathered. Repeated links, loops and an empty table are allowed; nulls are not.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    for _ in range(rounds):
        edges = cut(_stars(cut(_stars(edges, small=False)), small=True))
        # stars only: no node is both a child and a root, and each child has one root
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")

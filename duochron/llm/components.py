"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a join-free aggregation over links, in tables of the shared folder; nothing is gathered on
the driver but a count. A node with many links is halved away in a few rounds, and a node's smallest
neighbour comes from a partially aggregated minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duochron.llm.common import stage, unstage


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: link every larger neighbour to the smallest of a node's neighbours and itself; small: every other neighbour that isn't larger, and the node."""
    both = _both(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: a bigint, b bigint. Returns ``id, root``: the smallest id that each linked id reaches (roots map to themselves)."""
    now = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        # done when every node has one link, and it leads to a node that has no smaller one
        heads = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        open_links = now.join(heads, "a").where("n > 1").select("a").limit(1).unionByName(now.select(F.col("b").alias("a")).join(heads, "a", "left_semi").limit(1))
        if open_links.isEmpty():
            break
        after = stage(_star(_star(now, True), False), "links")
        unstage(now)
        now = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())

"""Connected components of a table of links, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import discard, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's links move to its smallest neighbour: those to larger nodes, or those to smaller ones."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    moved = both.join(least, "a").filter("b > a" if large else "b <= a")
    pairs = moved.select(F.col("b").alias("u"), F.col("low").alias("v"))
    if not large:
        pairs = pairs.union(least.select(F.col("a").alias("u"), F.col("low").alias("v")))
    return pairs.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node of ``links`` (a, b).

    Loops and repeated links do no harm; nodes without a link to another have no row. The number of rounds
    grows with the logarithm of the longest chain. Links stay distributed, each round in a written table.
    """
    at = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_done(at):
        large = stored(_star(at, True), "large-star")
        small = stored(_star(large, False), "small-star")
        discard(at, large)
        at = small
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _is_done(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none of its own."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("other")).union(links.select("b", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("other").alias("other"))
    return sums.agg(F.coalesce(F.max((F.col("own") > 1) | ((F.col("own") > 0) & (F.col("other") > 0))), F.lit(False))).first()[0] is False

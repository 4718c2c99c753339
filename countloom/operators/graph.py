"""Connected components of link tables that may be large."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countloom.session import cut_lineage


def _star(links: DataFrame, wide: bool) -> DataFrame:
    """Tie neighbours to the least one: the larger neighbours of every node, or of each node its smaller ones."""
    if wide:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
        return both.where("b > a").join(root, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a != b").distinct()
    root = links.groupBy("a").agg(F.min("b").alias("root"))
    moved = links.join(root, "a").where("b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(root.select("a", F.col("root").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node of (a, b) is connected to.

    Wide and narrow star steps alternate until every component is one star around its least node, which takes a number
    of steps that grows with the logarithm of its size. Neighbours are only ever minimised over, never gathered. Nulls
    and links of a node to itself are left out; order and repeats do not matter. Each step is a checkpoint.
    """
    now = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(now)
    mark = None
    while True:
        now = cut_lineage(_star(_star(now, True), False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if seen == mark:
            break
        mark = seen
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

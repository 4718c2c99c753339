"""Connected components of a large set of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import stash


def _contract(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b) with a > b: each node's neighbours are tied to its least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    tied = both.join(least, "a")
    moved = (tied.where("b > a") if large else tied).select(F.col("b").alias("x"), "root")
    if not large:
        moved = moved.unionByName(least.select(F.col("a").alias("x"), "root"))
    return moved.where("x != root").select(F.col("x").alias("a"), F.col("root").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node.

    ``links`` has long columns a and b; order and repeats do not matter. Each step ties neighbours to the least one
    (first larger neighbours, then smaller ones), so the links of a component turn into a star in a number of steps
    that grows with the logarithm of its size. Node lists are never gathered: the least neighbour is an aggregate,
    joined back by node, where Spark can split a hot node. Every step is a table in the shared folder.
    """
    now = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stash(now, "links")
    mark = None
    while True:
        now = stash(_contract(stash(_contract(now, True), "links"), False), "links")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).head()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

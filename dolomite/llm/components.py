"""Connected components of an undirected edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dolomite.llm.common import small_or_shuffled, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (src, dst) that is not its component itself.

    Each round first links all larger neighbours of a node to its least neighbour, then all smaller ones; minima are
    pre-aggregated, and written before they are joined, so that a node with many neighbours is broadcast or split.
    Rounds are written to the shared folder, and end when the edges no longer change.
    """
    now = written(edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        before = mark
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = small_or_shuffled(written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m")), "least"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        large = written(large.where("src != dst"), "large-star")
        least = small_or_shuffled(written(large.groupBy("src").agg(F.min("dst").alias("m")), "least"))
        small = large.join(least, "src").where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = written(small.unionByName(least.select("src", F.col("m").alias("dst"))).distinct(), "small-star")

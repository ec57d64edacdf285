"""Graphs as edge tables, in rounds of joins: connected components, and PageRank of graphs too large for one group.

Every round is written, so that a plan holds one round and a lost executor costs one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dolomite.functions.text import unused
from dolomite.sources.writers import materialised


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of edges (src, dst), undirected.

    Each round a node takes the least label among its neighbours', and then that label's own label, so that long chains shorten by halves.
    """
    both = materialised(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both-ways")
    now = materialised(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"), "labels")
    while True:
        near = both.join(now.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        least = now.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("label", F.coalesce("near", "label")).alias("new"), F.col("label").alias("old"))
        of = now.select(F.col("node").alias("new"), F.col("label").alias("further"))
        after = materialised(least.join(of, "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("label"), "old"), "labels")
        if after.where("label != old").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        now = after.select("node", "label")


def page_rank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """id, phrase, score, converged: PageRank of each id's own graph, over undirected weighted edges (id, src, dst, weight).

    A graph is done when its scores change by less than `tolerance` a node, in sum; it then stands still while others go on. Nodes of weight
    0 hand their score on to all of their graph. One that has not converged after all rounds gets degree centrality.
    """
    ways = edges.select("id", "src", "dst", "weight").unionByName(edges.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ways = materialised(ways, "graph")
    nodes = ways.groupBy("id", "src").agg(F.sum("weight").alias("out"), F.count(F.lit(1)).alias("degree"))
    sizes = materialised(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "graph-sizes")
    nodes = materialised(nodes.join(sizes, "id"), "graph-nodes")
    shares = materialised(ways.join(nodes.select("id", "src", "out"), ["id", "src"]).where("out > 0").select("id", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), "graph-shares")
    now = nodes.select("id", F.col("src").alias("node"), "out", "degree", "n", (1 / F.col("n")).alias("score"), F.lit(False).alias("done"))
    for _ in range(rounds):
        moved = now.where("not done")
        given = shares.join(moved.select("id", F.col("node").alias("src"), "score"), ["id", "src"]).groupBy("id", "dst").agg(F.sum(F.col("share") * F.col("score")).alias("given"))
        idle = moved.where("out <= 0").groupBy("id").agg(F.sum("score").alias("idle"))
        new = moved.join(given.withColumnRenamed("dst", "node"), ["id", "node"], "left").join(idle, "id", "left")
        score = (1 - damping) / F.col("n") + damping * (F.coalesce("given", F.lit(0.0)) + F.coalesce("idle", F.lit(0.0)) / F.col("n"))
        new = new.select("id", "node", "out", "degree", "n", F.col("score").alias("before"), score.alias("score"))
        new = materialised(new, "graph-round")
        change = new.groupBy("id").agg((F.sum(F.abs(F.col("score") - F.col("before"))) < tolerance * F.first("n")).alias("done"))
        still = now.where("done")
        now = materialised(still.unionByName(new.drop("before").join(change, "id").select(*still.columns)), "graph-scores")
        if now.where("not done").isEmpty():
            break
    central = F.when(F.col("done"), F.col("score")).otherwise(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)))
    return now.select("id", F.col("node").alias("phrase"), central.alias("score"), F.col("done").alias("converged"))


def in_groups(edges: DataFrame, most: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """edges of ids with at most `most`, and those of the others."""
    (large,) = unused(edges, "large")
    sizes = edges.groupBy(key).agg((F.count(F.lit(1)) > most).alias(large)).where(large)
    return edges.join(sizes, key, "left_anti"), edges.join(sizes.select(key), key, "left_semi")

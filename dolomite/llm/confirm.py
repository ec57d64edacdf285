"""Exact confirmation of candidate components by Jaccard similarity, in tasks of bounded size.

Input: rows (component, node, key, bytes) and the texts by key; links are asked for within a component only. A component of at most
BLOCK nodes and BLOCK_BYTES of text is compared in one task. A larger one is dealt to blocks by the nodes' hash:

1. each block is compared alone, which gives it groups;
2. scouts of each block's largest group, compared in one task (twice a block at most, or one a block), join most of these groups;
3. what lies outside the component's largest group so far is compared, block by block, with every block of the component.

Two nodes of the largest group are joined already and every other link has an end outside it, so step 3 loses none. A task holds two
blocks at most. The work of a component grows with its size times what lies outside its largest group, which is little for copies
of one text, however many. Nodes without shingles link to none. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dolomite.llm.common import released, small_or_shuffled, written
from dolomite.llm.components import components

#: Nodes of a component in a task, and their bytes of text; scouts of a block.
BLOCK, BLOCK_BYTES, SCOUTS = 2_000, 8 << 20, 64


class Forest:
    """Disjoint sets over 0..n-1; a set's root is its least member. Takes whole arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            on = x != y
            a, b, x, y = a[on], b[on], x[on], y[on]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def confirmed(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The root (least place) of each set of hashes under links of Jaccard similarity `least` or more.

    From each set in turn to all it reaches; a set is compared with those not reached yet that share a value with it.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    root = np.full(n, -1)
    value = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    end = np.cumsum(size)
    owner, many = np.repeat(np.arange(n), size), int(value.max()) + 1 if len(value) else 0

    def index():
        on = np.flatnonzero(root[owner] < 0)
        on = on[np.argsort(value[on], kind="stable")]
        return owner[on], np.searchsorted(value[on], np.arange(many + 1)), (root < 0).sum()

    holders, first, indexed = index()
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], todo = seed, [seed]
        while todo:
            at = todo.pop()
            own = value[end[at] - size[at] : end[at]]
            start, length = first[own], first[own + 1] - first[own]
            place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
            who, shared = np.unique(holders[place], return_counts=True)
            near = who[(root[who] < 0) & (shared / (size[who] + size[at] - shared) >= least)]
            root[near] = seed
            todo += near.tolist()
            if 2 * (left := (root < 0).sum()) < indexed:
                if not left:
                    break
                holders, first, indexed = index()
    return root


def crossed(few: list[np.ndarray], many: list[np.ndarray], least: float) -> np.ndarray:
    """The root of each place, of few first and many behind it, under links between the two of similarity `least` or more."""
    n, m = len(few), len(many)
    forest, size = Forest(n + m), np.array([len(x) for x in few + many])
    if not size[:n].sum() or not size[n:].sum():
        return forest.up
    value = np.unique(np.concatenate(few + many), return_inverse=True)[1]
    end = np.cumsum(size)
    held = value[end[n - 1] :]
    order = np.argsort(held, kind="stable")
    holders, first = np.repeat(np.arange(m), size[n:])[order], np.searchsorted(held[order], np.arange(value.max() + 2))
    for at in range(n):
        own = value[end[at] - size[at] : end[at]]
        start, length = first[own], first[own + 1] - first[own]
        place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        who, shared = np.unique(holders[place], return_counts=True)
        near = n + who[shared / (size[n + who] + size[at] - shared) >= least]
        forest.link(np.full(len(near), at), near)
    return forest.roots(np.arange(n + m))


def joined(root: np.ndarray, group: np.ndarray) -> pa.Table:
    """group, to: the groups (a value per place) that the roots of the places join, without those that keep their name."""
    forest, names = Forest(len(root)), np.unique(group, return_index=True, return_inverse=True)
    forest.link(np.arange(len(root)), root)
    forest.link(np.arange(len(root)), names[1][names[2]])
    to = group[forest.roots(names[1])]
    on = to != names[0]
    return pa.table({"group": pa.array(names[0][on]), "to": pa.array(to[on])})


def blocks_of(rows: DataFrame, block: int) -> DataFrame:
    """component, n, blocks: into how many blocks the nodes of a component are dealt."""
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return sizes.select("component", "n", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / BLOCK_BYTES, F.lit(1.0))).cast("int").alias("blocks"))


def confirmed_links(wanted: DataFrame, texts: DataFrame, sets_of: Callable, least: float, block: int = BLOCK, alone_by: Callable = confirmed, across_by: Callable = crossed) -> DataFrame:
    """node, to: every node that is not its group's name itself, with that name (a node of the group).

    wanted: component, node, key, bytes (a row per node); texts: key, text, repeated keys with equal texts; sets_of: a list of texts
    as bytes to their sets of 64-bit values; alone_by, across_by: how a block, and a block with another, is compared.
    """

    def sets(part: pa.Table) -> list[np.ndarray]:
        return sets_of(part.column("text").cast(pa.binary()).to_pylist())

    def freeing(compare: Callable) -> Callable:
        def run(part: pa.Table) -> pa.Table:
            out, size = compare(part), part.nbytes
            released(size)
            return out

        return run

    def alone(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        root, node = alone_by(sets(part), least), part.column("node").to_numpy()
        on = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"node": pa.array(node[on]), "to": pa.array(node[root[on]]), "blocks": pa.array(np.full(len(on), part.column("blocks")[0].as_py(), np.int32))})

    def scouted(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        return joined(alone_by(sets(part), least), part.column("group").to_numpy())

    def across(part: pa.Table) -> pa.Table:
        part = part.sort_by([("outside", "descending"), ("node", "ascending")])
        n, each = int(np.sum(part.column("outside").to_numpy())), sets(part)
        return joined(across_by(each[:n], each[n:], least), part.column("group").to_numpy())

    large = written(blocks_of(wanted, block).where("blocks > 1"), "large-components")
    dealt = wanted.join(small_or_shuffled(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    nodes = texts.join(small_or_shuffled(written(dealt, "candidate-blocks")), "key").dropDuplicates(["node"]).drop("key")
    if large.isEmpty():
        return written(nodes.groupBy("component", "block").applyInArrow(freeing(alone), "node long, to long, blocks int"), "links").drop("blocks")

    nodes = written(nodes, "candidate-texts")
    links = written(nodes.select("component", "block", "blocks", "node", "text").groupBy("component", "block").applyInArrow(freeing(alone), "node long, to long, blocks int"), "links")
    own = nodes.where("blocks > 1").join(small_or_shuffled(links.select("node", F.col("to").alias("group"))), "node", "left").withColumn("group", F.coalesce("group", "node"))
    own = written(own, "block-groups")

    best = own.groupBy("component", "block", "group").count().groupBy("component", "block").agg(F.max_by("group", F.struct("count", "group")).alias("group"))
    place = F.row_number().over(Window.partitionBy("component", "block").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    each = F.greatest(F.lit(1), F.least(F.lit(SCOUTS), F.floor(2 * F.col("n") / (F.col("blocks") * F.col("blocks")))))
    scouts = own.join(small_or_shuffled(written(best, "block-best")), ["component", "block", "group"]).withColumn("place", place).where(F.col("place") <= each)
    joins = written(scouts.select("component", "node", "group", "text").groupBy("component").applyInArrow(freeing(scouted), "group long, to long"), "scouts")

    own = own.join(small_or_shuffled(joins), "group", "left").withColumn("group", F.coalesce("to", "group")).drop("to")
    named = written(own.groupBy("component", "group").agg(F.count(F.lit(1)).alias("count")), "groups")
    main = named.groupBy("component").agg(F.max_by("group", F.struct("count", "group")).alias("main"))
    own = written(own.join(small_or_shuffled(written(main, "main-groups")), "component").withColumn("outside", (F.col("group") != F.col("main")).cast("int")), "placed")
    rest = own.where("outside = 1")
    parts = small_or_shuffled(written(blocks_of(rest, block).select("component", F.col("blocks").alias("parts")), "rest-sizes"))
    wide = ["component", "block", "part", "outside", "node", "group", "text"]
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int").alias("part")
    ours = rest.join(parts, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part, "outside", "node", "group", "text")
    all_of = own.join(parts, "component").select("component", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("outside"), "node", "group", "text")
    met = ours.unionByName(all_of).select(*wide).groupBy("component", "block", "part").applyInArrow(freeing(across), "group long, to long")
    final = components(met.select(F.col("group").alias("src"), F.col("to").alias("dst")))
    of_large = own.select("node", "group").join(small_or_shuffled(final.select(F.col("node").alias("group"), F.col("component").alias("to"))), "group", "left")
    of_large = of_large.select("node", F.coalesce("to", "group").alias("to")).where("node != to")
    return written(links.where("blocks = 1").drop("blocks").unionByName(of_large), "all-links")

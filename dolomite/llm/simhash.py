"""SimHash near-dedup with vantage-point trees.

A text's fingerprint has a bit set where over half of its shingles' XXH64 (seed 42) have it set. Equal fingerprints are one node
(the smallest identifier). Nodes are dealt to shards by a vantage-point tree built on a bounded sample: at each vantage
point those within the median distance go in, the others out. By the triangle bound, a link can cross only if its inner
end lies within RADIUS of the boundary; those points go to both sides, so every linked pair meets in a shard, wherever
it is. Within a shard the same tree goes on down to leaves, whose pairs are compared, and the shard gives a spanning forest
of its links. Components of all forests come from components(). Which points the sample has decides speed alone.

Null and wordless texts have fingerprint zero and link like any other. Rows of one identifier are all fingerprinted. Empty
input gives no rows. A null identifier takes part with the others (nulls are last; alone, its component is null).

Near copies for dedup (NEAR). A SimHash of all shingles moves by about ten bits at a Jaccard similarity of 0.8, too far for a
tree to prune by. So a fingerprint is made of a few shingles chosen by minimum hash, two texts choosing the same with the
probability of their similarity: bit j is bit j of the hash of choice j mod `chosen`. At 0.8 one is within two bits with
probability 0.17, any of 24 with 0.99; the search by trees is the same. What it links is a candidate only: within each component
of candidates all pairs with a shingle in common are compared, and those whose sets of shingles (as 64-bit hashes) reach `least`
link. Large components are compared in blocks (confirm).
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dolomite.llm.common import fresh, released, slices, small_or_shuffled, spread, texts, written
from dolomite.llm.components import components
from dolomite.llm.confirm import Forest, confirmed, confirmed_links

SEED, RADIUS, WORDS = 42, 2, 3
#: Near copies for dedup: five-word shingles; candidates differ in at most two bits in any of 24 fingerprints of twelve chosen shingles
#: each, and links are the candidates whose shingles have a Jaccard similarity of 0.8 or more.
NEAR = {"words": 5, "radius": 2, "tables": 24, "chosen": 12, "least": 0.8}
#: Fingerprints for a shard, and its sample's size per shard. The upper tree has at most MOST_SHARDS shards, so its sample stays
#: under 50 MB; beyond 650 million fingerprints shards grow (16 bytes a fingerprint in a task) and are split there as before.
SHARD, SAMPLE_EACH, MOST_SHARDS, LEAF = 20_000, 24, 1 << 15, 384

#: byte -> its eight bits in the eight bytes of a word.
LANES = sum((((np.arange(256, dtype=np.uint64) >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j)) for j in range(8))


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if len(parts) < words:
        return [xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    line = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(parts) - words])]
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of texts with so many of the hashes each. Bits are counted eight at a time, in bytes of words, 255 hashes at most."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(n) - n, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * 255
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(LANES[columns[:, k]], begin).view(np.uint8).reshape(-1, 8)
        bits = np.add.reduceat(sums.astype(np.int64), first, axis=0) * 2 > n[:, None]
        out[full] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """The hashes for a table: themselves for the first, else shifted and multiplied as by splitmix64."""
    if not table:
        return hashes
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * table % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chosen_fingerprints(hashes: np.ndarray, counts: np.ndarray, tables: int, chosen: int) -> np.ndarray:
    """A row per text, a column per table; zero for texts without shingles."""
    out = np.zeros((len(counts), tables), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begin = np.cumsum(counts[full]) - counts[full]
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, tables * chosen, np.uint64) * np.uint64(2) + np.uint64(1)
    fields = [np.uint64(sum(1 << j for j in range(k, 64, chosen))) for k in range(chosen)]
    turned = np.empty_like(hashes)
    for i, factor in enumerate(odd):
        np.multiply(hashes, factor, out=turned)
        out[full, i // chosen] |= mixed(np.minimum.reduceat(turned, begin), 1) & fields[i % chosen]
    return out


def fingerprinted(docs: DataFrame, words: int = WORDS, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fps (for each table the fingerprint's 64 bits as a long)."""

    def run(batches):
        for b in slices(batches, "text", 1 << 20):
            each = [shingle_hashes(t or b"", words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
            each = np.stack([fingerprints(mixed(flat, t), counts).view(np.int64) for t in range(tables)], 1)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * tables, pa.int32()), pa.array(each.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fps], ["doc_id", "fps"])

    return spread(texts(docs, id_col, text_col)).mapInArrow(run, "doc_id long, fps array<long>")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray, seed: int, radius: int = RADIUS) -> tuple[np.uint64, int]:
    """Of a few candidates the point around which fewest lie just inside the median distance, and that distance."""
    rng = np.random.default_rng(seed)
    some = points if len(points) <= 2000 else points[rng.integers(0, len(points), 2000)]
    best = None
    for v in some[rng.integers(0, len(some), 6)]:
        d = distance(some, v)
        mid = int(np.median(d))
        for cut in (mid - 1, mid, mid + 1):
            inner, band = (d <= cut).sum(), ((d <= cut) & (d > cut - radius)).sum()
            worst = max(inner, len(some) - inner + band)
            if best is None or worst < best[0]:
                best = (worst, v, cut)
    return best[1], best[2]


def grown(sample: np.ndarray, shards: int, radius: int = RADIUS) -> list[tuple]:
    """The upper tree: (vantage point, cut, inner, outer) for nodes, children given as places, or -1 - shard."""
    nodes: list = []
    leaves = 0

    def build(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        if want <= 1 or len(points) < 16:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        v, cut = vantage(points, at, radius)
        d = distance(points, v)
        inner, outer = points[d <= cut], points[d > cut - radius]
        if not len(inner) or not (d > cut).any():
            nodes.pop()
            leaves += 1
            return -leaves
        share = len(inner) / (len(inner) + len(outer))
        left = max(1, round(want * share))
        a = build(inner, left)
        nodes[at] = (int(v), cut, a, build(outer, max(1, want - left)))
        return at

    build(sample, shards)
    return nodes


def dealt(points: np.ndarray, nodes: list[tuple], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of each point and its copies across boundaries."""
    rows, to, work = [], [], [(0 if nodes else -1, np.arange(len(points)))]
    while work:
        at, own = work.pop()
        if at < 0:
            rows.append(own)
            to.append(np.full(len(own), -1 - at))
        elif len(own):
            v, cut, inner, outer = nodes[at]
            d = distance(points[own], np.uint64(v))
            work += [(inner, own[d <= cut]), (outer, own[d > cut - radius])]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(to) if to else np.zeros(0, np.int64)


def linked(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The root (least place) of each point's set under links of at most radius bits."""
    forest, work = Forest(len(points)), [np.arange(len(points))]
    while work:
        own = work.pop()
        if len(own) > LEAF:
            v, cut = vantage(points[own], len(own), radius)
            d = distance(points[own], v)
            inner, outer = own[d <= cut], own[d > cut - radius]
            if max(len(inner), len(outer)) < 0.97 * len(own):
                work += [inner, outer]
                continue
        for i in range(0, len(own), LEAF):
            for j in range(i, len(own), LEAF):
                a, b = own[i : i + LEAF], own[j : j + LEAF]
                x, y = np.nonzero(distance(points[a][:, None], points[b][None, :]) <= radius)
                forest.link(a[x], b[y])
    return forest.roots(np.arange(len(points)))


def searched(alike: DataFrame, radius: int) -> DataFrame:
    """src, dst: of nodes (node, fps), a spanning forest of the links of every table, equal fingerprints among them."""
    flat = alike.select(F.posexplode("fps").alias("table", "fp"), "node")
    points = written(flat.groupBy("table", "fp").agg(F.min("node").alias("node")), "points")
    same = flat.join(points.withColumnRenamed("node", "dst"), ["table", "fp"]).where("node != dst").select(F.col("node").alias("src"), "dst")
    return forest_links(points, alike.count(), radius).unionByName(same)


def forest_links(points: DataFrame, n: int, radius: int) -> DataFrame:
    """src, dst: a spanning forest of the links within each table, n being the number of nodes."""
    shards = min(MOST_SHARDS, -(-n // SHARD))
    most = 4 * SAMPLE_EACH * max(shards, 80)
    # Chosen by hash, so the sample is the same whenever a task runs again.
    near = points.where("table = 0").where(F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.lit(1 << 30)) < int(min(1.0, most / 2 / max(n, 1)) * (1 << 30)))
    rows = near.select("fp").limit(most).toArrow() if shards > 1 else None
    tree = grown(np.sort(rows.column("fp").to_numpy()).view(np.uint64), shards, radius) if rows is not None and rows.num_rows else []

    def deal(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            row, shard = dealt(fp.view(np.uint64), tree, radius)
            table = b.column("table").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(shard, pa.int32()), pa.array(fp[row]), b.column("node").take(pa.array(row))], ["table", "shard", "fp", "node"])

    def join(part: pa.Table) -> pa.Table:
        part = part.sort_by("node").combine_chunks()
        root = linked(part.column("fp").to_numpy().view(np.uint64), radius)
        on = np.flatnonzero(root != np.arange(len(root)))
        node = part.column("node")
        released(part.nbytes)
        return pa.table({"src": node.take(pa.array(on)), "dst": node.take(pa.array(root[on]))})

    return points.where("node is not null").mapInArrow(deal, "table int, shard int, fp long, node long").groupBy("table", "shard").applyInArrow(join, "src long, dst long")


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tables: int = 1, chosen: int | None = None, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (the first table's), component_id: a row per row of docs.

    tables: fingerprints of that many independent hashes; texts link if any of them is within the radius. chosen, least: fingerprints
    of so many chosen shingles give candidates, which link from that Jaccard similarity on.
    """
    if chosen:
        rows = written(rows_grouped(docs, words, radius, tables, chosen, least or 0.0, id_col, text_col), "near-groups")
        first = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return rows.join(first, "component").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    of_docs = written(fingerprinted(docs, words, tables, id_col, text_col), "fingerprints")
    alike = written(of_docs.groupBy("fps").agg(F.min("doc_id").alias("node")), "nodes")
    if tables == 1:
        edges = forest_links(alike.select(F.lit(0).alias("table"), F.col("fps")[0].alias("fp"), "node"), alike.count(), radius)
    else:
        edges = searched(alike, radius)
    found = components(edges)
    of_fps = alike.join(found, "node", "left").select("fps", F.coalesce("component", "node").alias("component_id"))
    return of_docs.join(of_fps, "fps").select("doc_id", F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), "component_id")


def candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """node, component: nodes (node, fps) in components of more than one, linked where any fingerprint is within the radius."""
    found = written(components(searched(nodes, radius)), "candidate-components")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def rows_grouped(docs: DataFrame, words: int, radius: int, tables: int, chosen: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (the text's MD5), fingerprint, component (equal for near copies): a row per row of docs.

    Texts of equal shingles are one node, named by the 64-bit hash of the set.
    """
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    own = texts(docs, id_col, text_col).withColumn("key", F.md5("text"))

    def sets_of(each):
        return [np.unique(np.array(shingle_hashes(t or b"", words), np.uint64)) for t in each]

    def run(batches):
        for b in slices(batches, "text", 1 << 20):
            each = [np.array(shingle_hashes(t or b"", words), np.uint64) for t in b.column("text").cast(pa.binary()).to_pylist()]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            fps = chosen_fingerprints(np.concatenate(each), counts, tables, chosen).view(np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * tables, pa.int32()), pa.array(fps.ravel()))
            node = pa.array([signed(xxh64_intdigest(np.unique(x).tobytes(), SEED)) for x in each], pa.int64())
            size = pc.binary_length(b.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), node, fps, size], ["doc_id", "key", "node", "fps", "bytes"])

    of_rows = written(spread(own).mapInArrow(run, "doc_id long, key string, node long, fps array<long>, bytes long"), "fingerprints")
    nodes = written(of_rows.groupBy("node").agg(F.min("key").alias("key"), F.first("fps").alias("fps"), F.max("bytes").alias("bytes")), "nodes")
    found = written(candidates(nodes.select("node", "fps"), radius), "candidates")
    wanted = written(nodes.select("node", "key", "bytes").join(small_or_shuffled(found), "node"), "candidate-keys")
    links = confirmed_links(wanted, own.select("key", "text"), sets_of, least)
    placed = of_rows.join(small_or_shuffled(links), "node", "left")
    return placed.select("doc_id", "key", F.col("fps")[0].alias("fp"), F.coalesce("to", "node").alias("component"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: dict = NEAR) -> DataFrame:
    """The rows of docs that come first in their group, by identifier (nulls last) and then the text's MD5.

    A row is told by both, so that others of its identifier stay; rows equal in both stay or go together.
    """
    rows = written(rows_grouped(docs, id_col=id_col, text_col=text_col, **near), "near-groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = rows.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = small_or_shuffled(written(first, "first-of-groups"))
    of_id, of_text = fresh(docs, "gone_id", "gone_key")
    gone = rows.join(first, "component").where(place != F.col("first")).select(F.col("doc_id").alias(of_id), F.col("key").alias(of_text)).distinct()
    gone = small_or_shuffled(written(gone, "near-copies"))
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(of_id)) & (F.md5(F.coalesce(F.col(text_col), F.lit(""))) == F.col(of_text)), "left_anti")

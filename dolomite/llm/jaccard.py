"""N-gram Jaccard join: links of texts whose sets of word shingles are alike, by a join over parts of the sets.

A text's set holds the 64-bit hashes of its distinct shingles (words cut at ASCII white space, A-Z lower-cased; fewer words than
a shingle has: the whole sequence as one). Two sets link when share * intersection >= need * union, here 100 and 90. Documents of equal
sets are one node.

1. Sets of n and m values that link differ in at most h = (share - need) (n + m) / (share + need) values. Cut the range of hashes into
   more than h parts: in one at least the two sets hold the same values. Each set is so cut for all h that its partners may have
   (numbers of parts by STEP, so for one or two numbers), and gives a key of each part's values: about nine of them.
2. A part of fewer than WEAK values says little. Where parts are many, a sixteenth more are made, so that as many weak ones may be left out of a
   set and parts that agree remain. A set with more weak parts names each of them together with each part of a second cut.
3. Nodes of one key are tied to the least of them, so that rows grow with the keys alone, not with the square of a group. Components of the
   ties are what is compared further.
4. In blocks of bounded size (confirm) pairs of sets of one prefix and size pass the length bound and the positional bound of their prefixes;
   the members of those that do are expanded and verified by exact intersection.

The other way to candidates (`known` or `heavy` given) is a join over prefixes. Shingles are counted over all documents; the ORDER is rare
before frequent, by steps of 2^(1/4) in their count (told by a table of at most `known` slots of a byte, the greatest of a slot holding for all
in it), ties by hash. In that order two sets that link share a value of their prefixes, p = n - ceil(0.9 n) + 1 values long. With a the least
intersection of sets of n and m values, their prefixes share p - (n - a) values, or as many by m, at least, and what lies behind the last
shared one must make up the rest of a. Nodes that share a value of at most `heavy` holders meet pair by pair, which grows with the square of
the holders; pairs within both bounds are tied. Of a value of more holders and a window of sizes all are tied to the least.

component_id is the least doc_id reachable by links. Null and wordless texts have an empty set and link with nothing: each row is
its own component. Rows of one identifier all take part; equal texts are one node; other columns play no part. Null identifiers come
last (alone, their component is null). Empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dolomite.llm.common import released, slices, small_or_shuffled, spread, texts, written
from dolomite.llm.components import components
from dolomite.llm.confirm import Forest, confirmed_links

#: Words of a shingle; the least similarity as need / share.
WORDS, NEED, SHARE = 3, 90, 100
#: Steps between numbers of parts, values under which a part says little, and parts up to which a weak one is named with a second cut's.
STEP, WEAK, SECOND = 1.1, 3, 64
#: Most slots of counts that the order knows (a byte each in a worker), least count of one, bits of a count's part and of a name in it.
KNOWN, FREQUENT, PART_BITS, NAME_BITS = 1 << 26, 4, 10, 32
#: Most holders of a prefix value that meet pair by pair.
HEAVY = 1_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    from xxhash import xxh64_intdigest

    # Copied first: after a cast of a slice, whose first offset is not 0, ascii_lower of pyarrow 23 reads other bytes.
    plain = pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    bounds = np.asarray(lists.offsets)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    value = np.fromiter((xxh64_intdigest(w, words) for w in distinct), np.uint64, len(distinct))
    there = np.asarray(pc.binary_length(flat)) > 0
    ends = np.concatenate([[0], np.cumsum(there)])[bounds - bounds[0]]
    h = value[np.asarray(coded.indices)[there]]
    odd = np.uint64(0x9E3779B97F4A7C15)
    run = h[: max(len(h) - words + 1, 0)].copy()
    for k in range(1, words):
        run = run * odd + h[k : len(run) + k]
    run = mixed(run)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            out.append(np.array([xxh64_intdigest(h[a:b].tobytes(), words)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n, need: int = NEED, share: int = SHARE):
    """The least size of a set that links with one of n, which is also the least intersection."""
    return -(-need * n // share)


def names(values: np.ndarray) -> np.ndarray:
    return values >> np.uint64(64 - PART_BITS - NAME_BITS)


def slots(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(64 - bits)


def frequent(docs: DataFrame, words: int, known: int) -> np.ndarray:
    """Steps of the counts of frequent shingles, counted over all rows (id, text), by slot: 2^k slots, at most `known`; 0: none is frequent."""

    def part(batches):
        for b in slices(batches, "text", 8 << 20):
            name, n = np.unique(names(np.concatenate(shingle_sets(b.column("text"), words))), return_counts=True)
            parts = (name >> np.uint64(NAME_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(parts, prepend=-1))
            low, count = name.astype(np.uint32), np.minimum(n, 0xFFFF).astype(np.uint16)
            ends = [*cuts[1:], len(name)][: len(cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(parts[cuts], pa.int64()), *(pa.array([x[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary()) for x in (low, count))], ["part", "low", "count"])

    def counted(rows: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("low").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.column("count").to_pylist()])
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        first = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        total = np.add.reduceat(n.astype(np.int64), first) if len(first) else first
        on = total >= FREQUENT
        name = (np.int64(rows.column("part")[0].as_py()) << NAME_BITS) | low[first[on]].astype(np.int64)
        released(rows.nbytes)
        return pa.table({"name": pa.array(name), "n": pa.array(total[on])})

    counts = written(docs.select("text").mapInArrow(part, "part long, low binary, count binary").groupBy("part").applyInArrow(counted, "name long, n long"), "frequent")
    bits = min(max((8 * counts.count()).bit_length(), PART_BITS), known.bit_length() - 1)
    if bits < PART_BITS:
        return np.zeros(0, np.uint8)
    each = 1 << bits - PART_BITS

    def told(rows: pa.Table) -> pa.Table:
        name, n = rows.column("name").to_numpy(), rows.column("n").to_numpy()
        step = np.zeros(each, np.uint8)
        np.maximum.at(step, (name & (1 << NAME_BITS) - 1) >> NAME_BITS + PART_BITS - bits, np.minimum(4 * np.log2(n), 255).astype(np.uint8))
        return pa.table({"part": pa.array([int(name[0]) >> NAME_BITS]), "step": pa.array([step.tobytes()], pa.binary())})

    parts = counts.groupBy(F.shiftright("name", NAME_BITS).alias("part")).applyInArrow(told, "part long, step binary").toArrow()  # 2^PART_BITS rows, a byte a slot
    out = np.zeros((1 << PART_BITS, each), np.uint8)
    for at, step in zip(parts.column("part").to_pylist(), parts.column("step"), strict=True):
        out[at] = np.frombuffer(step.as_buffer(), np.uint8)
    return out.ravel()


def first_values(own: np.ndarray, step: np.ndarray, need: int = NEED, share: int = SHARE) -> np.ndarray:
    """The prefix of a sorted set by the steps of the slots."""
    length = len(own) - needed(len(own), need, share) + 1
    if not len(step):
        return own[:length]
    return own[np.argsort(step[slots(own, len(step).bit_length() - 1)], kind="stable")[:length]]


def prefix(own: np.ndarray, name: np.ndarray, n: np.ndarray, need: int = NEED, share: int = SHARE) -> np.ndarray:
    """The first values of a sorted set in the order."""
    length = len(own) - needed(len(own), need, share) + 1
    at = np.searchsorted(name, mine := names(own))
    known = np.zeros(len(own), bool) if not len(name) else name[np.minimum(at, len(name) - 1)] == mine
    rare = own[~known]
    if len(rare) >= length:
        return rare[:length]
    often, count = own[known], n[at[known]]
    return np.concatenate([rare, often[np.lexsort((often, count))]])[:length]


class Groups:
    """Sets of one block in an order of their own: prefixes, groups of identical prefixes and size, and who holds a prefix value."""

    def __init__(self, sets: list[np.ndarray], need: int, share: int):
        self.need, self.share = need, share
        self.size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        code, end = rank[code], np.cumsum(self.size)
        self.sets = [np.sort(code[z - s : z]) for z, s in zip(end, self.size, strict=True)]
        self.mark = np.zeros(len(often), bool)
        lengths = np.where(self.size, self.size - needed(self.size, need, share) + 1, 0)
        self.prefixes = [x[:k] for x, k in zip(self.sets, lengths, strict=True)]

    def index(self, on: np.ndarray) -> None:
        """Groups the sets numbered by `on`, which alone are found from here on."""
        found: dict[tuple[int, bytes], list[int]] = {}
        for i in on[self.size[on] > 0].tolist():
            found.setdefault((int(self.size[i]), self.prefixes[i].tobytes()), []).append(i)
        self.members = [np.array(x) for x in found.values()]
        of = [self.prefixes[x[0]] for x in self.members]
        self.group_size = np.array([self.size[x[0]] for x in self.members], np.int64)
        length = np.array([len(p) for p in of], np.int64)
        value = np.concatenate(of) if of else np.zeros(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.holder = np.repeat(np.arange(len(of)), length)[order]
        self.place = (np.arange(len(value)) - np.repeat(np.cumsum(length) - length, length))[order]

    def linked(self, at: int, open_: np.ndarray) -> np.ndarray:
        """Those of the indexed sets marked in open_ that link with set `at`."""
        own, n = self.prefixes[at], int(self.size[at])
        if not n or not len(self.value):
            return np.zeros(0, np.int64)
        first, last = np.searchsorted(self.value, own), np.searchsorted(self.value, own, "right")
        length = last - first
        where = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        who, mine, theirs = self.holder[where], np.repeat(np.arange(len(own)), length), self.place[where]
        groups, spot, shared = np.unique(who[::-1], return_index=True, return_counts=True)
        spot = len(who) - 1 - spot  # the last value that both prefixes hold
        size = self.group_size[groups]
        least = -(-self.need * (n + size) // (self.need + self.share))
        near = (self.share * np.minimum(n, size) >= self.need * np.maximum(n, size)) & (shared + np.minimum(n - mine[spot], size - theirs[spot]) - 1 >= least)
        if not near.any():
            return np.zeros(0, np.int64)
        them = np.concatenate([self.members[g] for g in groups[near]])
        them = them[open_[them]]
        if not len(them):
            return them
        self.mark[self.sets[at]] = True
        held = np.concatenate([self.sets[i] for i in them])
        starts = np.cumsum(self.size[them]) - self.size[them]
        both = np.add.reduceat(self.mark[held].astype(np.int64), starts)
        self.mark[self.sets[at]] = False
        return them[self.share * both >= self.need * (n + self.size[them] - both)]


def joined_sets(sets: list[np.ndarray], need: int = NEED, share: int = SHARE) -> np.ndarray:
    """The root (least place) of each set's component under the links. Every set in turn, then all that it reaches."""
    groups, n = Groups(sets, need, share), len(sets)
    root, open_ = np.full(n, -1), np.ones(n, bool)
    groups.index(np.arange(n))
    indexed = n
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], open_[seed], todo = seed, False, [seed]
        while todo:
            near = groups.linked(todo.pop(), open_)
            root[near], open_[near] = seed, False
            todo += near.tolist()
            if 2 * (left := int(open_.sum())) < indexed:
                if not left:
                    break
                groups.index(np.flatnonzero(open_))
                indexed = left
    return root


def crossed_sets(few: list[np.ndarray], many: list[np.ndarray], need: int = NEED, share: int = SHARE) -> np.ndarray:
    """The root of each place, of few first and many behind it, under the links between the two."""
    n, m = len(few), len(many)
    groups, forest, open_ = Groups([*few, *many], need, share), Forest(n + m), np.ones(n + m, bool)
    groups.index(np.arange(n, n + m))
    for at in range(n):
        near = groups.linked(at, open_)
        forest.link(np.full(len(near), at), near)
    return forest.roots(np.arange(n + m))


def steps(most: int) -> list[int]:
    """The numbers of parts that sets are cut into, up to the first that is at least `most`."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return out


def cut(own: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A key of the values in each of so many equal ranges of hashes (own: sorted), and how many they are."""
    ends = np.searchsorted((own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(own ^ np.uint64(0x2545F4914F6CDD1D)))])
    name = mixed(np.uint64(parts << 32) + np.arange(parts).astype(np.uint64))
    return mixed((sums[ends[1:]] - sums[ends[:-1]]) ^ name), np.diff(ends)


def part_keys(own: np.ndarray, need: int = NEED, share: int = SHARE) -> np.ndarray:
    """Keys of a sorted set: any other set that links with it has one of them too. None where equal sets alone link."""
    n = len(own)
    if (share - need) * n < need:
        return np.zeros(0, np.uint64)
    least, most = ((share - need) * (n + m) // (share + need) + 1 for m in (needed(n, need, share), share * n // need))
    out = []
    for parts in (x for x in steps(most) if x >= least):
        spare = parts // 16
        key, held = cut(own, parts + spare)
        weak = held < WEAK
        out.append(key[~weak])
        if weak.sum() > spare:
            if parts <= SECOND:
                second = cut(np.sort(mixed(own)), parts)[0]
                out.append(mixed(key[weak][:, None] ^ mixed(second)[None, :]).ravel())
            else:
                out.append(key[weak])
    return np.concatenate(out)


def tied_by_parts(nodes: DataFrame) -> DataFrame:
    """node, component of nodes (node, keys) tied to others by a key. Each row of a key is tied to its least node: as many ties as keys."""
    each = nodes.select("node", F.explode("keys").alias("key"))
    ties = each.withColumn("first", F.min("node").over(Window.partitionBy("key"))).where("node != first")
    return components(ties.select(F.col("node").alias("src"), F.col("first").alias("dst")).distinct())


def candidates(nodes: DataFrame, need: int = NEED, share: int = SHARE, heavy: int = HEAVY) -> DataFrame:
    """node, component of nodes (node, size, prefix) tied to others by the values of their prefixes and sizes within the bound."""
    # A smaller set than this links with its equals alone.
    one = nodes.where((share - need) * F.col("size") >= need).select("node", "size", F.posexplode("prefix").alias("pos", "value"))
    # Most values are one node's alone.
    shared = written(one.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "shared-values")
    both = written(one.join(small_or_shuffled(shared), "value"), "shared-prefixes")

    few = both.where(F.col("holders") <= heavy)
    a, b = (few.select("value", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "pos")]) for x in "ab")
    near = (F.col("node_a") < F.col("node_b")) & (share * F.least("size_a", "size_b") >= need * F.greatest("size_a", "size_b"))
    met = a.join(b, "value").where(near).groupBy("node_a", "node_b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("shared"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b"))
    least = F.expr(f"({need} * (size_a + size_b) + {need + share - 1}) div {need + share}")  # values of the intersection
    met = met.withColumn("least", least)
    # A prefix's length less the values of its set that the other need not hold.
    bound = lambda x: F.col("least") - F.expr(f"({need} * size_{x} + {share - 1}) div {share}") + 1
    rest = F.least(F.col("size_a") - F.col("last_a"), F.col("size_b") - F.col("last_b")) - 1
    ties = met.where((F.col("shared") >= F.least(bound("a"), bound("b"))) & (F.col("shared") + rest >= F.col("least"))).select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"))

    # Sizes within the bound are in one window or in two that meet.
    base = float(np.log(share / need) * (1 + 1e-9))
    band = F.floor(F.log(F.col("size")) / base).cast("int")
    many = both.where(F.col("holders") > heavy).select("node", "value", F.explode(F.array(band, band + 1)).alias("window"))
    first = written(many.groupBy("value", "window").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last").drop("last"), "least-nodes")
    stars = many.join(small_or_shuffled(first), ["value", "window"]).where("node != first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    return components(ties.unionByName(stars).distinct())


def joined(docs: DataFrame, words: int = WORDS, need: int = NEED, share: int = SHARE, known: int | None = None, id_col: str = "doc_id", text_col: str = "text", block: int | None = None, heavy: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of docs. block: nodes of a component that one task compares.

    known, heavy: candidates by prefixes in place of parts.
    """
    from xxhash import xxh64_intdigest

    spark = docs.sparkSession
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    own = texts(docs, id_col, text_col)
    prefixes = known is not None or heavy is not None
    held = "prefix" if prefixes else "keys"
    order = spark.sparkContext.broadcast(frequent(spread(own), words, KNOWN if known is None else known) if prefixes else None)

    def run(batches):
        step = order.value
        for b in slices(batches, "text", 4 << 20):
            sets = shingle_sets(b.column("text"), words)
            first = [x if not len(x) else first_values(x, step, need, share) if prefixes else part_keys(x, need, share) for x in sets]
            size = [len(x) for x in sets]
            node = pa.array([signed(xxh64_intdigest(x.tobytes(), 1)) if len(x) else None for x in sets], pa.int64())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(size, pa.int64()), node, values, pc.binary_length(b.column("text")).cast(pa.int64())], ["doc_id", "key", "size", "node", held, "bytes"])

    keyed = own.withColumn("key", F.md5("text"))
    rows = written(spread(keyed).mapInArrow(run, f"doc_id long, key string, size long, node long, {held} array<long>, bytes long"), "shingle-sets")
    order.destroy()
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes"), F.first("size").alias("size"), F.first(held).alias(held)), "nodes")
    found = written(candidates(nodes, need, share, HEAVY if heavy is None else heavy) if prefixes else tied_by_parts(nodes), "candidate-nodes")
    placed = nodes.select("node", "key", "bytes").join(small_or_shuffled(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    alone = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    several = written(alone.where("n > 1").select("component"), "components-compared")
    wanted = written(placed.join(small_or_shuffled(several), "component").select("component", "node", "key", "bytes"), "nodes-compared")

    def sets_of(each: list) -> list[np.ndarray]:
        return shingle_sets(pa.array(each, pa.large_binary()).cast(pa.large_string()), words)

    links = confirmed_links(
        wanted, keyed.select("key", "text"), sets_of, need / share, **({"block": block} if block else {}),
        alone_by=lambda sets, _: joined_sets(sets, need, share), across_by=lambda few, many, _: crossed_sets(few, many, need, share),
    )
    named = rows.select("doc_id", "size", "node").join(small_or_shuffled(links), "node", "left").withColumn("node", F.coalesce("to", "node"))
    least = written(named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least-documents")
    out = named.join(small_or_shuffled(least), "node", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))

"""The grouped prefix join against all pairs, its edges, and its parts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from dolomite.llm import jaccard, queries

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 4))) for _ in range(120)]


def shingles(text: str | None) -> frozenset:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def brute(rows) -> dict[int, tuple[int, int]]:
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed: int, n: int = 160) -> list[tuple[int, str | None]]:
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.7:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(words))
                rng.choice([lambda: words.insert(at, rng.choice(WORDS)), lambda: words.__setitem__(at, words[at].upper()), lambda: len(words) > 1 and words.pop(at)])()
        else:
            words = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 11, 12, 13, 30, 80, 200]))]
        rows.append((i * 7 % 1009, rng.choice([" ", "  ", "\n"]).join(words)))
    return [*rows, (5000, None), (5001, ""), (5002, " \t"), (5003, "one two"), (5004, "ONE  two"), (5005, "one two three")]


def got(frame) -> dict[int, tuple[int, int]]:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize("seed, block", [(1, None), (3, 3)])
def test_links_equal_all_pairs(spark, seed, block):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard.joined(docs, block=block, known=0 if block == 3 else jaccard.KNOWN)) == brute(rows)


def test_sizes_at_the_bound(spark):
    """Nine of ten shingles link, eight of nine don't; ninety of a hundred do by one shingle."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base[:11])), (2, " ".join(base[:12])), (3, " ".join(base[20:30])), (4, " ".join(base[20:31])), (5, " ".join(base[100:192])), (6, " ".join(base[100:202])), (7, " ".join(base[210:301])), (8, " ".join(base[210:312]))]
    out = got(jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows) and out[2][1] == 1 and out[4][1] == 4 and out[6][1] == 5 and out[8][1] == 8


def test_large_group_of_near_copies_and_chains(spark):
    rng = random.Random(8)
    base, rows = [rng.choice(WORDS) + str(i) for i in range(150)], []
    for i in range(90):
        words = list(base)
        words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(1000 + k, " ".join(chain[3 * k : 3 * k + 120])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard.joined(docs, block=16)) == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string, node string, component string, key int, gid int, value int"
    assert jaccard.joined(spark.createDataFrame([], schema)).collect() == []
    twice = spark.createDataFrame([(4, "a b c d", "", "", 1, 1, 1), (4, "a b c d", "", "", 1, 1, 1), (9, "A b c d", None, None, None, None, None), (None, "a b c d", "", "", 1, 1, 1), (None, None, "", "", 1, 1, 1), (3, None, "", "", 1, 1, 1)], schema)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(twice).collect()))) == sorted(map(str, [(4, 2, 4), (4, 2, 4), (9, 2, 4), (None, 2, 4), (None, 0, None), (3, 0, 3)]))
    long = " ".join(f"{i % 977} {i}" for i in range(60_000))
    assert got(jaccard.joined(spark.createDataFrame([(1, long), (2, long + " end"), (3, "no")], "doc_id long, text string"))) == {1: (119_998, 1), 2: (119_999, 1), 3: (1, 3)}


def test_sets_and_prefixes():
    sets = jaccard.shingle_sets(pa.array(["a b c a b c", None, "x  y", "\xa0a b c\n", "A B C"]))
    assert [len(x) for x in sets] == [3, 0, 1, 1, 1] and sets[4][0] in sets[0] and sets[3][0] not in sets[0]
    own = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, np.uint64))
    name = np.sort(jaccard.names(own[:48]))
    assert set(jaccard.prefix(own, name, np.arange(48))) >= set(own[48:].tolist()) and len(jaccard.prefix(own, name, np.arange(48))) == 6
    rng = np.random.default_rng(2)
    for _ in range(20):
        pool = [np.sort(rng.choice(60, rng.integers(9, 30), replace=False)).astype(np.uint64) for _ in range(6)]
        many = [np.unique(np.append(p, rng.integers(0, 80))) for p in pool for _ in range(3)] + [np.zeros(0, np.uint64)]
        roots = jaccard.joined_sets(many)
        up = list(range(len(many)))
        for _ in many:
            for i, x in enumerate(many):
                for j, y in enumerate(many):
                    both = len(np.intersect1d(x, y))
                    if both and 100 * both >= 90 * (len(x) + len(y) - both):
                        up[i] = up[j] = min(up[i], up[j])
        assert roots.tolist() == up
        assert len(set(jaccard.crossed_sets(many[:4], many[4:]))) >= len(set(up))


def test_sets_of_a_slice():
    """Tasks cut batches of long texts into slices (slices of 4 MB): a text's set is the same in any of them."""
    column = pa.array([f"Word {i} of Text{i} É and more {i % 3}" for i in range(62)])
    whole = jaccard.shingle_sets(column)
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        for a, n in ((0, 20), (20, 20), (40, 22)):
            got = jaccard.shingle_sets(column.cast(kind).slice(a, n))
            assert [x.tolist() for x in got] == [x.tolist() for x in whole[a : a + n]]


def test_texts_over_several_slices(spark):
    """Six megabytes of texts in one task, each twice."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(12_000))
    docs = spark.createDataFrame([(i, text(i % 30)) for i in range(60)], "doc_id long, text string").coalesce(1)
    assert {i: c for i, (n, c) in got(jaccard.joined(docs)).items() if n == 11_998} == {i: i % 30 for i in range(60)}


@pytest.mark.parametrize("heavy", [2, 1000])
def test_pairs_and_stars(spark, heavy):
    """Whether values bring nodes together pair by pair or by their least holder, no link is lost."""
    rows = corpus(17, 220)
    assert got(jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), heavy=heavy)) == brute(rows)


def test_a_shared_value_alone_ties_nothing(spark):
    """A chain of different sets, each sharing one rare value with the next one, stays apart before any text is compared."""
    rows = [(i, 100, [i * 10 + k for k in range(10)] + [(i + 1) * 10]) for i in range(300)] + [(900, 100, [*range(1, 11), 7000])]
    found = jaccard.candidates(spark.createDataFrame(rows, "node long, size long, prefix array<long>"))
    assert {r.node: r.component for r in found.collect()} == {900: 0}


def test_linked_sets_share_a_key():
    """Of every size, with as many differences as a link allows; keys grow with the set."""
    rng = np.random.default_rng(4)
    for n in [*range(9, 60), 90, 150, 200, 333, 1_000, 2_500]:
        for _ in range(30 if n < 200 else 4):
            own = np.unique(rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1))
            gone = int(rng.integers(0, n - jaccard.needed(n) + 1))
            more = int(rng.integers(0, max(100 * (n - gone) // 90 - n, 0) + 1))
            other = np.unique(np.append(own[rng.permutation(n)[gone:]], rng.integers(0, 1 << 63, more, np.uint64)))
            both = len(np.intersect1d(own, other))
            if 100 * both < 90 * (n + len(other) - both) or not gone + more:
                continue
            keys = [jaccard.part_keys(x) for x in (own, other)]
            assert len(np.intersect1d(*keys)) and len(keys[0]) < n
    assert not len(jaccard.part_keys(np.arange(8, dtype=np.uint64)))


def test_ties_grow_with_the_keys(spark):
    """400 near copies of one text: no join makes their 79,800 pairs before texts are compared; sets of other texts stay apart."""
    sets = jaccard.shingle_sets(pa.array([" ".join(f"w{k}" if k != 40 else f"x{i}" for k in range(150)) for i in range(400)] + [" ".join(f"{i}y{k}" for k in range(150)) for i in range(20)]))
    rows = [(i, jaccard.part_keys(x).view(np.int64).tolist()) for i, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, keys array<long>")
    assert {r.node: r.component for r in jaccard.tied_by_parts(nodes).collect()} == {i: 0 for i in range(1, 400)}
    made = []
    keep, jaccard.components = jaccard.components, lambda ties: made.append(ties) or ties
    try:
        jaccard.tied_by_parts(nodes)
    finally:
        jaccard.components = keep
    assert made[0].count() < 4_000 and "Join" not in made[0]._jdf.queryExecution().optimizedPlan().toString()


def test_query_reads_every_document(spark, tmp_path):
    rows = corpus(11, 60)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op11_jaccard(spark, str(tmp_path))) == brute(rows)

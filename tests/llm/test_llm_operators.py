"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dolomite.llm import bpe, components, exact_dedup, langid, packing, pii, quality, simhash, suffix_dedup, token_store, warc
from dolomite.llm.common import new_folder
from dolomite.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `at` int, shard int, kept boolean, norm string, node string"
random.seed(5)
WORDS = ["".join(random.choice("abcdeèüß") for _ in range(random.randint(1, 7))) for _ in range(90)]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", ".\n"]) if rng.random() < 0.1 else "") for _ in range(n))


BASE = prose(120, 1)
TEXTS: list[tuple[int | None, str | None]] = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Hello  World\x1c, it's 12345 't \n\n x"), (5, "HELLO"), (6, "hello"), (6, "hello"), (7, "ÉCOLE"), (8, "école"),
    (9, "a" * 5000), (10, BASE), (11, BASE.upper()), (12, BASE + " tail"), (13, prose(300, 2) + BASE + prose(50, 3)), (14, "spam ham " * 400),
    (15, prose(6000, 4)), (16, "x" * 400 + prose(40, 9)), (17, "🙂 日本語 " * 40), (18, "ab" * 700), (19, BASE), (None, "no identifier"), (20, "l1\nl2\nl1\n\n l1\n#*$%&|<>"), (21, "one two"),
]


def frame(spark, rows=TEXTS, langs=None):
    return spark.createDataFrame([(d, t, (langs or {}).get(d), "s", 1, "clash", 0, 0, False, "clash", "clash") for d, t in rows], SCHEMA).repartition(3)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_empty_tables(spark):
    none = frame(spark, [])
    path = tokenizer_file("word_bpe_49k.json")
    for df in (bpe.round_trip(none, tokenizer_file("byte_bpe_multi_50k.tiktoken"), "."), quality.judged(none), pii.report(none), exact_dedup.exact_groups(none), simhash.near_groups(none), suffix_dedup.deduplicated(none), langid.predicted(none), packing.pack(none, path)):
        assert df.count() == 0
    folder = new_folder(spark, "t")
    token_store.write_store(none, folder, path, 1)
    assert token_store.read_store(spark, folder).count() == 0
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{folder}w")
    assert warc.read_archive(spark, f"{folder}w").count() == 0 == warc.reconstruct(spark, f"{folder}w").count()


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for d, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    docs = frame(spark)
    assert rows_of(bpe.round_trip(docs, path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    coded = bpe.encode(docs, path, pattern)
    assert rows_of(coded, "doc_id", "ids") == sorted([(d, library.encode_ordinary(t or "")) for d, t in TEXTS], key=repr)
    assert rows_of(bpe.decode(coded, path, pattern), "doc_id", "bytes") == sorted([(d, bytearray((t or "").encode())) for d, t in TEXTS], key=repr)


def test_bpe_long_matches_merge_as_short_ones():
    import public_tokenizers

    codec = bpe.Codec(tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for seed in range(30):
        word = "".join(random.Random(seed).choice("abcé") for _ in range(200))
        assert codec.merge_matrix([word.encode()], 512)[0].tolist() == codec.merge_long(word.encode()).tolist()


def test_warc(spark):
    pages = [(5, "http://x/ y", "<p>é</p>"), (3, "http://z\r\n/", "<p>é</p>"), (9, None, None), (2, "u", ""), (4, "v", "solo"), (4, "v", "solo"), (7, "w", "x" * 100_000), (8, "w", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "clash", b"clash") for p in pages], "page_id long, url string, html string, digest string, payload binary")
    folder = new_folder(spark, "warc")
    warc.write_archive(df, folder)
    first: dict[str, int] = {}
    for i, _, h in pages:
        first[h or ""] = min(i, first.get(h or "", i))
    b32 = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(i, len((h or "").encode()), b32(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages]
    assert rows_of(warc.read_archive(spark, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.open_archive(spark, folder)[1].count() == len({h or "" for _, _, h in pages})
    by = {i: (h or "").encode() for i, _, h in pages}
    for r in warc.reconstruct(spark, folder).collect():
        ((fields, exact, block),) = warc.parse_records(bytes(r.record))
        assert fields["warc-type"] == r.record_type and block.endswith(by[r.page_id] if r.record_type == "response" else b"\r\n\r\n") and exact.endswith(b"\r\n\r\n")


def test_warc_files(spark, tmp_path):
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    assert [(r.record, bytes(r.block)) for r in warc.read_warc_files(spark, str(tmp_path)).orderBy("file", "record").collect()] == [(0, b"abc"), (1, b"abc")] * 2


def test_suffix_dedup(spark):
    got = Counter((r.doc_id, r.n_bytes, tuple((s.lo, s.hi) for s in r.removed), bytes(r.kept)) for r in suffix_dedup.deduplicated(frame(spark)).collect())
    data = [(t or "").encode() for _, t in TEXTS]
    want: Counter = Counter()
    for (d, _), b, spans in zip(TEXTS, data, suffix_dedup.brute_force(data), strict=True):
        cut = b"".join(b[x:y] for x, y in zip([0, *(h for _, h in spans)], [*(lo for lo, _ in spans), len(b)], strict=True))
        want[d, len(b), tuple(spans), cut] += 1
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_random(spark, seed):
    rng = random.Random(seed)
    parts = [bytes(rng.choice(b"ab ") for _ in range(rng.randint(20, 500))).decode() for _ in range(6)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + str(i)) for i in range(25)]
    data = [t.encode() for _, t in rows]
    want = {i: spans for (i, _), spans in zip(rows, suffix_dedup.brute_force(data), strict=True)}
    assert {r.doc_id: [(s.lo, s.hi) for s in r.removed] for r in suffix_dedup.deduplicated(frame(spark, rows)).collect()} == want


def test_segments_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    passage = prose(90, 31)
    data = [(prose(700, 32) + passage + prose(300, 33)).encode(), ("y" + passage).encode()]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "key": [0, 0], "text": data})
    windows = [(int(r["doc"]), int(r["lo"]) + k, int(r["gram"])) for rows, _ in suffix_dedup.listed(batch) for r in rows for k in range(r["n"])]
    assert sorted(w[:2] for w in windows) == [(d, i) for d, b in ((1, data[0]), (2, data[1])) for i in range(len(b) - suffix_dedup.SPAN + 1)]


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        out = list(suffix_dedup.merged([iter([(p, s[p:], None) for p, s in zip(suffix_dedup.front_coded(r), r, strict=True)]) for r in runs]))
        want = sorted(s for r in runs for s in r)
        assert [s for _, s, _ in out] == want and [p for p, _, _ in out] == suffix_dedup.front_coded(want)


def test_quality(spark):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for d, t in TEXTS:
        w, seen, dup = word.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(inside), failed))
    got = quality.judged(frame(spark))
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    kept = {r.doc_id for r in got.collect() if r.kept}
    assert {10, 12, 13, 15} <= kept and 14 not in kept
    assert {r.doc_id for r in quality.passing(frame(spark)).collect()} == kept


def test_longest_matches():
    rng = random.Random(1)
    texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 40))] for _ in range(20)] + [[1] * 33]
    flat, bounds = np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)])
    got = quality.longest_matches(flat, bounds)
    for t, a in zip(texts, bounds, strict=False):
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                n = 0
                while j != i and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                    n += 1
                best = max(best, n)
            assert got[a + i] == best


def library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_equal_the_library():
    from dolomite.llm.wordbpe import token_ids

    texts = [t for _, t in TEXTS] + ["Ａb ﬁ école H̱ İstanbul ΑΣ", "<|endoftext|> don't I'LL x\x85y\xa0z", "a\x1cb «q» ½ 1²3", "ÀÉÿ ß×÷"]
    texts += ["a<|endoftext|>b", "<|startoftext|>", "x<|startoftext|><|endoftext|>\n y<|endoftext|", "it<|endoftext|>'s e<|endoftext|>\u0301", "<|ENDOFTEXT|> <|endof text|>", " <|endoftext|> ", "<|<|endoftext|>|>"]
    ids, bounds = token_ids(pa.array(texts, pa.string()), tokenizer_file("word_bpe_49k.json"))
    encode = library_ids()
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encode(t) for t in texts]


def test_token_store(spark):
    folder, encode = new_folder(spark, "store"), library_ids()
    token_store.write_store(frame(spark), folder, tokenizer_file("word_bpe_49k.json"), 1)
    got = rows_of(token_store.read_store(spark, folder), "start", "doc_id", "n_tokens", "ids_crc32")
    got.sort()
    want = {d: encode(t) + [1] for d, t in TEXTS}
    at = 0
    for (start, d, n, c), expected in zip(got, sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d)), strict=True):
        assert (start, d, n, c) == (at, expected, len(want[d]), crc(want[d]))
        at += n
    assert {r.doc_id: r.ids for r in token_store.fetch(spark, folder, [13, 2]).collect()} == {13: want[13], 2: want[2]}


def test_packing(spark):
    encode = library_ids()
    got = packing.pack(frame(spark), tokenizer_file("word_bpe_49k.json"), 0, 256).collect()
    want: Counter = Counter()
    for d, t in TEXTS:
        ids = encode(t) + [0]
        for k in range(0, len(ids), 256):
            want[d, k // 256, k, len(ids[k : k + 256]), crc(ids[k : k + 256])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert len(by) <= 1.05 * sum(r.length for r in got) / 256 + 2


def test_packing_plan():
    rng = np.random.default_rng(0)
    for top in (3, 60, 600):
        count = Counter(rng.integers(1, 301, 40 * top).tolist())
        plan, bound = packing.solve(count, 300)
        used: Counter = Counter()
        for config, n in plan.items():
            assert sum(x * k for x, k in config) <= 300
            used.update({x: k * n for x, k in config})
        assert used == count and bound <= sum(plan.values()) <= 1.03 * bound + 5


def test_simhash(spark):
    import xxhash

    word, prints = re.compile(r"[^\x20\x09-\x0D]+"), []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in TEXTS:
        w = word.findall((t or "").translate(lower))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints):
            if (a ^ b).bit_count() <= 2 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = [(d, f"{p:016x}", min((x for (x, _), h in zip(prints, group, strict=True) if h == g and x is not None), default=None)) for (d, p), g in zip(prints, group, strict=True)]
    assert rows_of(simhash.near_groups(frame(spark)), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_near_copies_of_five_word_shingles(spark):
    rng, rows = random.Random(8), []
    for i in range(60):
        w = prose(300, 500 + i).split()
        rows.append((i, " ".join(w)))
        if i < 40:  # one word of 300 differs
            w[rng.randrange(300)] = "zzz"
            rows.append((1000 + i, " ".join(w)))
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(frame(spark, rows), **simhash.NEAR).collect()}
    assert all(groups[i] == i for i in range(60))
    assert sum(groups[1000 + i] == i for i in range(40)) >= 38
    assert {r.doc_id for r in simhash.one_of_each_group(frame(spark, rows)).collect()} == {d for d, c in groups.items() if d == c}


def shingle_sets(rows, n=5):
    return {d: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for d, t in rows for w in [t.split()]}


def test_pipeline_drops_near_copies_from_a_similarity_of_0_8(spark):
    import corpus_pipeline

    rng, rows = random.Random(18), []
    for i in range(80):
        w = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows.append((i, " ".join(w)))
        at = rng.sample(range(2, 78), (2, 4, 6, 8)[i % 4])  # changes lie five words apart: five shingles each
        for k in at:
            w[5 * k] = "zzz"
        rows.append((1000 + i, " ".join(w)))
        for k in [k for k in range(2, 78) if k not in at][: 22 - len(at)]:
            w[5 * k] = "yyy"
        rows.append((2000 + i, " ".join(w)))
    sets = shingle_sets(rows)
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    close = [i for i in range(80) if jaccard(i, 1000 + i) >= 0.8]
    assert len(close) == 80 and min(jaccard(i, 1000 + i) for i in close) < 0.83 and max(jaccard(i, 2000 + i) for i in range(80)) < 0.8
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert set(range(80)) <= kept
    assert sum(1000 + i not in kept for i in close) >= 78
    assert sum(2000 + i in kept for i in range(80) if jaccard(1000 + i, 2000 + i) < 0.8) == sum(jaccard(1000 + i, 2000 + i) < 0.8 for i in range(80))


def test_languages_of_long_documents_are_learned(spark):
    rows = [(i, ("xa xo xu " if i % 2 else "ße ßi ßä ") * (langid.CHARS if i % 2 else 20)) for i in range(40)]
    texts, langs = langid.training(frame(spark, rows, {i: "long" if i % 2 else "short" for i, _ in rows}), "doc_id", "text", "lang")
    assert set(langs) == {"long", "short"} and max(map(len, texts)) == langid.CHARS


def test_near_copies_go_by_row(spark):
    a, b, c, d = (prose(200, 900 + i) for i in range(4))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, c + " tail"), (None, d), (None, d + " tail"), (None, b + " tail"), (4, None), (5, "")]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each_group(frame(spark, rows)).collect()]
    assert {(1, a), (2, b), (4, None)} <= set(kept) and len(kept) == 5
    assert sum(i == 3 for i, _ in kept) == 1 and sum(i is None for i, _ in kept) == 1


def test_confirmed_links_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    sets = [rng.choice(60, rng.integers(1, 40), replace=False).astype(np.uint64) for _ in range(120)]
    sets += [np.unique(np.append(s[:-1], np.uint64(99))) for s in sets[:60]] + [s[: max(1, len(s) - 2)] for s in sets[:60]]
    truth = simhash.Forest(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(np.intersect1d(a, b))
            if n / (len(a) + len(b) - n) >= 0.8:
                truth.link(np.array([i]), np.array([j]))
    assert (simhash.confirmed([np.unique(s) for s in sets], 0.8) == truth.roots(np.arange(len(sets)))).all()


def test_large_components_are_confirmed_in_blocks(spark, monkeypatch):
    from dolomite.llm import confirm

    rng, texts = random.Random(21), []
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    for _ in range(150):  # copies of one text, most within 0.8 of it, some of one another only
        w = list(base)
        for k in rng.sample(range(40), rng.choice((1, 1, 2, 3, 5))):
            w[5 * k] = f"z{rng.randrange(9)}"
        texts.append((1, " ".join(w)))
    for i in range(25):  # a chain, each but its neighbours too far; pairs; texts of their own
        texts.append((1, " ".join(f"c{4 * i + j}" for j in range(60))))
        own = [f"p{i}-{j}" for j in range(50)]
        texts += [(1, " ".join(own)), (1, " ".join([*own, "tail"])), (1, " ".join(f"q{i}-{j}" for j in range(30))), (2 + i % 2, " ".join([*own, "end"]))]
    texts += [(4, "one two three"), (4, ""), (5, " ".join(base))]
    texts = list(dict.fromkeys(texts))
    sets_of = lambda each: [np.unique(np.array(simhash.shingle_hashes(t, 5), np.uint64)) for t in each]
    sets = [set(x.tolist()) for x in sets_of([t.encode() for _, t in texts])]
    truth = confirm.Forest(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i][0] == texts[j][0] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                truth.link(np.array([i]), np.array([j]))
    want = truth.roots(np.arange(len(texts)))
    wanted = spark.createDataFrame([(c, i, f"k{i}", len(t)) for i, (c, t) in enumerate(texts)], "component long, node long, key string, bytes long")
    keyed = spark.createDataFrame([(f"k{i}", t) for i, (_, t) in enumerate(texts)] * 2, "key string, text string")
    for block, most in ((10, 1 << 30), (60, 1 << 30), (1000, 20_000), (1000, 1 << 30)):
        monkeypatch.setattr(confirm, "BLOCK_BYTES", most)
        links = confirm.confirmed_links(wanted, keyed, sets_of, 0.8, block).collect()
        name = {r.node: r.to for r in links}
        assert len(name) == len(links) and all(n != t for n, t in name.items())
        got = [name.get(i, i) for i in range(len(texts))]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))
    assert confirm.confirmed_links(wanted.limit(0), keyed, sets_of, 0.8).collect() == []


def test_vantage_trees_find_every_link():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    points[:2000] = points[2000:4000] ^ (np.uint64(1) << rng.integers(0, 63, 2000).astype(np.uint64))
    points[5000:] = points[0] ^ np.uint64(1) << rng.integers(0, 63, 1000).astype(np.uint64) ^ rng.integers(0, 8, 1000).astype(np.uint64)
    points = np.unique(points)
    truth = simhash.Forest(len(points))
    for i in range(0, len(points), 500):
        x, y = np.nonzero(simhash.distance(points[i : i + 500, None], points[None, :]) <= 2)
        truth.link(x + i, y)
    want = truth.roots(np.arange(len(points)))
    assert (simhash.linked(points) == want).all()
    row, shard = simhash.dealt(points, simhash.grown(points[::7], 8))
    whole = simhash.Forest(len(points))
    for k in np.unique(shard):
        own = np.sort(row[shard == k])
        whole.link(own, own[simhash.linked(points[own])])
    assert len(np.unique(shard)) > 4 and (whole.roots(np.arange(len(points))) == want).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randint(400, 480), rng.randint(400, 480)) for _ in range(50)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in found.collect()} == {x: root(x) for x in up if root(x) != x}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


PII = [
    (1, None), (2, ""), (3, "mail a.b@c-d.org, and x@y or @z.com a@b.c_q@d.e"), (4, "at 10.0.0.255 or 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 99999999999.1.1.1"),
    (5, "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 41111111111111111111111 1"), (6, "call +49 (0)30 1234-567. or +1 2 +1234567890123456"), (7, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not DE88370400440532013000"),
    (8, "é🙂 x@y.zz 🙂 1.1.1.1"), (9, "my card 378282246310005 here and 378282246310006"), (10, "number 378282246310005 there"), (11, "a" * 3000 + "@b.c " + "1" * 3000), (12, "x@y.z " * 300), (12, "x@y.z " * 300),
]


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(t: str) -> list[str]:
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0])]


def test_pii(spark):
    got = pii.report(frame(spark, PII)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(PII)
    for d, t in PII:
        spans, r = base_spans(t or ""), by[d]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), d
        assert r.spans.split(",")[: len(spans)] == (spans or r.spans.split(",")[:0])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(k + ":") for s in spans) for k in pii.BASE]
    assert [s for s in by[7].spans.split(",") if s.startswith("iban")] == ["iban:5:32", "iban:37:59"]
    assert by[9].spans == "shortcard:8:23" and by[10].spans == ""


def test_redaction(spark):
    by = {r.doc_id: r.text for r in pii.redacted(frame(spark, PII)).collect()}
    assert by[8] == "é🙂 [EMAIL] 🙂 [IP]" and by[1] is None and by[2] == "" and by[10] == PII[9][1]
    assert by[12] == "[EMAIL] " * 300


def test_exact_dedup(spark):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for d, t in TEXTS:
        groups[low(t)].append(d)
    want = []
    for d, t in TEXTS:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(exact_dedup.exact_groups(frame(spark)), *columns) == sorted(want, key=repr)
    # A digest of one digit: nearly every hit is no copy, and only the bytes tell.
    from pyspark.sql import functions as F

    weak = exact_dedup.exact_groups(frame(spark), digest=lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1), files_per_batch=1)
    assert rows_of(weak, *columns) == sorted(want, key=repr)
    left = exact_dedup.distinct_documents(frame(spark))
    assert sorted([r.doc_id for r in left.collect()], key=repr) == sorted({d for d, k, *_ in want if d == k}, key=repr)
    assert left.columns == frame(spark).columns


def test_language(spark):
    alphabets = {"en": "etaoin", "de": "ärünös", "fr": "éçàlue"}
    rng, rows, langs = random.Random(6), [], {}
    for i in range(240):
        lang = rng.choice([*alphabets])
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 60)))))
        langs[i] = lang
    rows += [(900, None), (901, ""), (902, "123 !"), (903, "x"), (903, "x"), (904, "eta \U0010ffff oin"), (None, "etaoin")]
    got = langid.predicted(frame(spark, rows, langs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in langs:
            assert r.lang_pred == langs[r.doc_id]
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == dict.fromkeys((900, 901, 902), ("und", 0.0))
    assert {r.lang_pred for r in langid.predicted(frame(spark, rows)).collect()} == {"und"}
    assert {r.lang_pred for r in langid.predicted(frame(spark, rows, dict.fromkeys(range(240), "en"))).collect()} == {"und", "en"}


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(i, prose(200 + i, 1000 + i), "en", "s", 1) for i in range(30)] + [(90, prose(210, 1010), "en", "s", 1), (91, "tiny", "en", "s", 1), (92, prose(100, 7) + " x@y.org", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    own = docs
    for name, stage in c.STAGES[:-1]:
        own = stage(spark, own, "")
        assert own.columns == docs.columns, name
    left = {r.doc_id: r.text for r in own.collect()}
    assert set(left) == {*range(30), 90, 92} - {10} and left[92].endswith("[EMAIL]")
    assert {r.doc_id for r in c.packed(spark, own, "").collect()} == set(left)
    none = docs.limit(0)
    for _, stage in c.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_word_cache_restarts_and_repeats():
    from dolomite.llm.wordcache import WordCache, flattened

    rng, calls = np.random.default_rng(1), []

    def many(words):
        calls.append(len(words))
        return flattened([[*w.encode()] for w in words])

    for bounds in ({}, {"most": 7}, {"most_bytes": 60}):
        cache = WordCache(many, **bounds)
        for _ in range(20):
            words = ["", *(f"w{x}é" for x in rng.integers(0, 30, 12))]
            texts = [words[:4], [], words[4:]]
            ids, at = cache.encode_lists(texts, pa.string())
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*"".join(t).encode()] for t in texts]
        ids, at = cache.encode_lists([[], []], pa.string())
        assert not len(ids) and at.tolist() == [0, 0, 0]
    assert 0 not in calls


def test_slices_hold_every_row():
    from dolomite.llm.common import slices

    texts = ["", None, "x" * 5000, "é", "y" * 300, "z" * 2000] * 3
    batch = pa.record_batch({"text": pa.array(texts), "n": pa.array(range(len(texts)))})
    got = list(slices([batch, batch.slice(0, 0), batch], "text", 1000))
    assert [x for b in got for x in b.column("text").to_pylist()] == texts * 2 and len(got) > 6

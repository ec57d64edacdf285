"""The registered queries on a small table against brute force, and edges of the operators: clashing names, long texts, scripts."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from dolomite.llm import exact_dedup, langid, pii, queries, simhash, suffix_dedup

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abcdefghilmnopqrstuv") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose(70, 99)
TEXTS = [(i, prose(30 + 17 * i, i)) for i in range(12)] + [(20, prose(60, 1) + " " + PASSAGE + " " + prose(9, 2)), (21, PASSAGE), (22, None), (23, ""), (24, prose(5000, 5)), (25, prose(30, 0)), (26, "Write to a@b.org or +49 30 1234567"), (27, "one<|endoftext|>two <|startoftext|> " + prose(20, 6))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    langs = {i: ("xx", "yy")[i % 2] for i in range(12)}
    spark.createDataFrame([(i, t, langs.get(i), "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "u", "<p>"), (2, "v", "<p>"), (3, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def ids_of(text: str | None, end: int) -> list[int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_query_gives_a_row_for_each_document(spark, folder):
    for name, query in queries.QUERIES.items():
        if name not in ("op2_warc", "op10_packing", "op12_conversations", "op13_codebook"):
            assert sorted(r.doc_id for r in query(spark, folder).collect()) == [i for i, _ in sorted(TEXTS)], name


def test_op2_rows(spark, folder):
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in queries.op2_warc(spark, folder).collect()}
    assert got == {1: (3, "response", None), 2: (3, "revisit", 1), 3: (0, "response", None)}


def test_op3_columns(spark, folder):
    data = [(t or "").encode() for _, t in TEXTS]
    want = {}
    for (i, _), b, spans in zip(TEXTS, data, suffix_dedup.brute_force(data), strict=True):
        kept, at = b"", 0
        for lo, hi in spans:
            kept, at = kept + b[at:lo], hi
        want[i] = (len(b), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op3_suffix_dedup(spark, folder).collect()} == want
    assert want[21][1] == len(PASSAGE)


def test_op5_starts(spark, folder):
    at = 0
    for r in sorted(queries.op5_token_store(spark, folder).collect(), key=lambda r: r.doc_id):
        ids = ids_of(dict(TEXTS)[r.doc_id], 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op10_at_2048(spark, folder):
    by, seen = defaultdict(list), set()
    for r in queries.op10_packing(spark, folder).collect():
        ids = ids_of(dict(TEXTS)[r.doc_id], 0)
        assert r.start == 2048 * r.piece and r.length == min(2048, len(ids) - r.start) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        by[r.sequence_id].append((r.offset, r.length))
        seen.add((r.doc_id, r.piece))
    assert seen == {(i, k) for i, t in TEXTS for k in range(-(-len(ids_of(t, 0)) // 2048))}
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_columns_of_any_name(spark):
    rows = [(1, "Same text of words", 7), (2, "same TEXT of words", 8), (3, "mail x@y.org", 9)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, gone_id int, gone_digest int, GONE_KEY int, pii int, digest int")
    for left, want in ((exact_dedup.distinct_documents(docs), [2, 3]), (simhash.one_of_each_group(docs), [1, 3]), (pii.redacted(docs), [1, 2, 3])):
        got = left.orderBy("doc_id").collect()
        assert left.columns == docs.columns and [r.doc_id for r in got] == want and [r.gone_id for r in got] == [6 + i for i in want] and {r.pii for r in got} == {3}


def test_many_spans_of_a_long_text(spark):
    n = 30_000
    docs = spark.createDataFrame([(1, "x@y.zz " * n), (2, "é" * 100_000 + " 1.1.1.1")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_email, r.spans[-15:]) for r in pii.report(docs).collect()}
    assert got[1][0] == n and got[1][1].endswith(f"{7 * n - 7}:{7 * n - 1}") and got[2][1].endswith("100001:100008")
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()} == {1: "[EMAIL] " * n, 2: "é" * 100_000 + " [IP]"}
    assert time.time() - began < 120


def test_account_numbers_with_something_behind(spark):
    texts = ["AT61 1904 3002 3457 3201 2024 konto", "ES91 2100 0418 4502 0005 1332 CALL", "DE88 3704 0044 0532 0130 00"]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {0: "iban:0:24", 1: "iban:0:29", 2: ""}


def test_scores_by_sets_of_ngrams():
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(30))
    alphabets = {"a": "etaoin", "b": "etäöün", "c": "漢字仮名交文", "d": "абвгде"}
    texts = [make(x) for x in alphabets.values() for _ in range(25)]
    langs = [k for k in alphabets for _ in range(25)]
    model = langid.fit(texts, langs)
    vocabulary = {}
    for n, table in enumerate(model.grams, 1):
        for code in np.flatnonzero(table >= 0):
            vocabulary[tuple(int(code) // langid.ALPHABET ** (n - 1 - k) % langid.ALPHABET for k in range(n))] = int(table[code])

    def present(text: str) -> set[int]:
        code = [int(model.letters[ord(c)]) for c in text.lower()]
        return {vocabulary[g] for n in (1, 2, 3) for i in range(len(code) - n + 1) if (g := tuple(code[i : i + n])) in vocabulary}

    marks = [t for k in alphabets for t in [x for x, y in zip(texts, langs, strict=True) if y == k][: langid.LANDMARKS]]
    for text in [make(x) for x in alphabets.values()] + ["x", "漢"]:
        own = present(text)
        kernel = [len(own & present(m)) / (max(1, len(own)) * len(present(m))) ** 0.5 for m in marks]
        z = [langid.SHARPNESS * (sum(k * model.weights[j, i] for j, k in enumerate(kernel)) + model.bias[i]) for i in range(len(model.languages))]
        e = np.exp(np.array(z) - max(z))
        assert model.scores([text])[0] == pytest.approx(e / e.sum(), abs=2e-3)
    for k, letters in alphabets.items():
        assert all(model.languages[int(model.scores([make(letters)])[0].argmax())] == k for _ in range(10))


def test_scripts_stay_apart():
    points = [ord(c) for c in "漢字仮名"]
    model = langid.fit(["abc " * 5] * 4 + ["def " * 5] * 4, ["x"] * 4 + ["y"] * 4)
    assert len({int(model.letters[p]) for p in points}) > 1 and all(langid.OWN > int(model.letters[ord(c)]) for c in "abcdef ")


def test_op3_rows_of_one_identifier_and_checksum(spark):
    """Rows without identifier whose texts share a CRC-32 keep apart."""
    rng = random.Random(3)
    passage, filler = prose(60, 77)[:260], "".join(rng.choice("abcdefgh ") for _ in range(400))
    a, b = passage + filler, "".join(rng.choice("ijklmnop ") for _ in range(660))
    tails = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1_500_000))
    ends = {zlib.crc32((x := a + next(tails)).encode()): x for _ in range(100_000)}
    other = next(x for t in tails if zlib.crc32((x := b + t).encode()) in ends)
    texts = [passage + " elsewhere " + filler[::-1], ends[zlib.crc32(other.encode())], other]
    data = [t.encode() for t in texts]
    got = suffix_dedup.deduplicated(spark.createDataFrame([(1, texts[0]), (None, texts[1]), (None, texts[2])], "doc_id long, text string")).collect()
    want = []
    for text, spans in zip(data, suffix_dedup.brute_force(data), strict=True):
        want.append((len(text), spans, b"".join(text[x:y] for x, y in zip([0, *(z for _, z in spans)], [*(z for z, _ in spans), len(text)], strict=True))))
    assert sorted((r.n_bytes, [(x.lo, x.hi) for x in r.removed], bytes(r.kept)) for r in got) == sorted(want) and [len(s) for _, s, _ in want] == [1, 1, 0]


def test_op8_many_rows_without_identifier(spark, tmp_path):
    """Linear in rows that share a locator: half of them have a copy."""
    n = 30_000
    spark.createDataFrame([(None, f"text {k // 2}") for k in range(n)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    rows = exact_dedup.exact_groups(spark.read.parquet(f"{tmp_path}/documents.parquet")).groupBy("group_size").count().collect()
    assert [tuple(r) for r in rows] == [(2, n)] and time.time() - began < 120

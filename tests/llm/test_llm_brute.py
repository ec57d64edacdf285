"""Verdicts and models against versions written straight from their definitions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from dolomite.llm import bpe, langid, quality, warc
from dolomite.llm.queries import tokenizer_file

RNG = random.Random(31)
WORDS = [f"w{i}" for i in range(300)]


def repetition(text: str | None) -> tuple[int, float, int, bool]:
    """words, covered share of word characters, longest repeat (from 5 words on), kept: over all pairs of places."""
    words = (text or "").split()
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    long, window = set(), set()
    for i, k in enumerate(best):
        long |= set(range(i, i + k)) if k >= quality.MIN_REPEAT else set()
        window |= set(range(i, i + 5)) if k >= 5 else set()
    share = sum(len(words[i]) for i in long) / max(1, sum(map(len, words)))
    longest = max(best, default=0)
    failed = n < 10 or 100 * len(window) > 20 * n
    return n, share, longest, not failed and share <= quality.MAX_COVERED and longest <= quality.MAX_LONGEST


def repeating(seed: int) -> str:
    """Text with none, few, many or long repeats, around the limits of the verdict."""
    rng = random.Random(seed)
    words = rng.choices(WORDS, k=rng.choice([5, 9, 10, 60, 250, 400]))
    for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
        size = rng.choice([4, 5, 9, 10, 11, 30, 59, 60, 61, 62])
        a = rng.randrange(len(words))
        at = rng.randrange(len(words) + 1)
        words[at:at] = words[a : a + size]
    return " ".join(words)


def test_quality_verdicts_equal_all_pairs(spark):
    rows = [(i, repeating(i)) for i in range(160)]
    rows += [(200, None), (201, ""), (202, " ".join(WORDS[:10])), (203, " ".join(WORDS[:9])), (204, "x " * 50)]
    base = RNG.choices(WORDS, k=700)
    rows += [(300 + k, " ".join([*base, *base[:k]])) for k in (59, 60, 61, 62)]  # the longest repeat allowed, and one more
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    verdicts = set()
    for i, text in rows:
        n, share, longest, kept = repetition(text)
        assert (got[i].n_words, got[i].kept) == (n, kept), i
        assert got[i].covered == pytest.approx(share) and got[i].longest_repeat == (longest if longest >= 5 else got[i].longest_repeat)
        verdicts.add((kept, got[i].base_failed))
    assert verdicts == {(True, False), (False, True), (False, False)}
    assert [got[i].kept for i in (359, 360, 361, 362)] == [True, True, False, False]


def plain_scores(texts: list[str], langs: list[str], asked: list[str]) -> np.ndarray:
    """Nystroem features of the presence kernel over sets of n-grams, weighted ridge regression with an intercept by least squares."""

    def grams(t: str) -> set[str]:
        t = t.lower()
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    sets = [grams(t) for t in texts]
    df: dict[str, int] = {}
    for s in sets:
        for g in s:
            df[g] = df.get(g, 0) + 1
    vocabulary = {g for g, n in df.items() if n >= 2}
    assert len(vocabulary) <= langid.VOCABULARY
    sets = [s & vocabulary for s in sets]

    def kernel(a, b):
        return len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))

    languages = sorted(set(langs))
    marks = [i for x in languages for i in [k for k, y in enumerate(langs) if y == x][: langid.LANDMARKS]]
    value, vector = np.linalg.eigh(np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks]))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    feature = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ root
    weight = np.array([1 / langs.count(x) for x in langs])
    weight = np.sqrt(weight / weight.sum())
    left = np.vstack([np.hstack([feature, np.ones((len(texts), 1))]) * weight[:, None], np.hstack([np.sqrt(langid.RIDGE / len(texts)) * np.eye(root.shape[1]), np.zeros((root.shape[1], 1))])])
    target = np.array([[1.0 if x == y else -1.0 for y in languages] for x in langs]) * weight[:, None]
    solved = np.linalg.lstsq(left, np.vstack([target, np.zeros((root.shape[1], len(languages)))]), rcond=None)[0]
    own = np.array([[kernel(grams(t) & vocabulary, sets[j]) for j in marks] for t in asked]) @ root
    z = langid.SHARPNESS * (own @ solved[:-1] + solved[-1])
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def test_language_model_equals_its_definition():
    letters = {"xx": "abcdefgh ", "yy": "fghijklm ", "zz": "aeiouklm "}
    rng = random.Random(4)
    text = lambda lang: "".join(rng.choices(letters[lang], k=rng.randint(20, 90)))
    langs = [rng.choice(["xx", "xx", "yy", "zz"]) for _ in range(90)]
    texts = [text(x) for x in langs]
    asked = [text(x) for x in ("xx", "yy", "zz") for _ in range(12)] + ["q", "aaaa"]
    model = langid.fit(texts, langs)
    assert model.languages == ["xx", "yy", "zz"]
    assert np.allclose(model.scores(asked), plain_scores(texts, langs, asked), atol=2e-3)


def test_more_languages_than_can_be_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LEARNED", 3)
    rows = [(i, f"text of language {i % 5} {'abcde'[i % 5] * 9}", f"l{i % 5}") for i in range(60)] + [(100 + i, "abc", "l4") for i in range(9)]
    texts, langs = langid.training(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len(texts) == 3 and len(set(langs)) == 3 and "l4" in langs


@pytest.mark.parametrize("pattern", [r"\S+ ?|\s", r"\w+ \w+|.|\n", r"[\s\S]{1,5}"])
def test_other_patterns_equal_the_library(pattern):
    import base64

    import pyarrow as pa
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["a b  c d", "", None, " x", "two words and three\nmore", "é ü 中文 ok", "x" * 400 + " y"]
    ids, bounds = bpe.codec(path, pattern).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t or "") for t in texts]


def test_most_pages_of_one_payload(spark, tmp_path):
    rows = [(i, f"u{i}", None if i % 3 else f"<p>{i}") for i in range(600)]
    folder = f"{tmp_path}/warc"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), folder)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, folder).collect()}
    assert got == {i: (0, "response" if i == 1 else "revisit", None if i == 1 else 1) if i % 3 else (3 + len(str(i)), "response", None) for i in range(600)}

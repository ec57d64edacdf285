"""Quality rules: repetition by suffix arrays over words.

A text's symbols are its words. For a batch of texts one suffix array is built by prefix doubling, whole batches at a
time, re-sorting only suffixes that still share their prefix with another (texts never compare equal to each other).
Longest common prefixes of neighbours come from the ranks kept of every doubling. The deepest common-prefix interval
of a suffix gives the longest repeat that starts there; the union of these spans is the union of all maximal repeats'.
A text is rejected if repeats of MIN_REPEAT words or more cover over MAX_COVERED of its word characters, or if its
longest repeat has over MAX_LONGEST words, or by the base rules (under 10 words; over 20 % of words in repeated 5-word windows).

Null text: no words, rejected. A row per input row, repeated rows too. Columns other than the two named play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dolomite.llm.common import slices, spread, texts

MIN_WORDS, WINDOW, MAX_WINDOW_PERCENT = 10, 5, 20
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.25, 60
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered double, longest_repeat long"


def longest_matches(symbols: np.ndarray, bounds: np.ndarray, least: int = 1) -> np.ndarray:
    """For each place the length of the longest string from there that also starts elsewhere in its own text.

    symbols: of all texts, one after another; bounds: of the texts. Lengths under `least` may be given as 0.
    """
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][text]
    key = text.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    levels, active, h = [rank.astype(np.int32)], order[np.repeat(size, size) > 1], 1
    while len(active):
        after = active + h
        inside = after < end[active]
        tail = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        key = rank[active] * (n + 1) + tail
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(starts, len(key)))
        old_starts = np.flatnonzero(np.diff(old, prepend=old[0] - 1))
        shift = np.repeat(old_starts, np.diff(np.append(old_starts, len(old))))
        rank[active] = old + np.repeat(starts, size) - shift
        active = active[np.repeat(size, size) > 1]
        levels.append(rank.astype(np.int32))
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    # Pairs whose common prefix reaches the largest power of two up to `least`; only these are measured.
    level = min(len(levels) - 1, max(0, least.bit_length() - 1))
    pair = np.flatnonzero(levels[level][a] == levels[level][b])
    a, b = a[pair], b[pair]
    common = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        common[same] += 1 << k
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(length: np.ndarray) -> np.ndarray:
    """Places inside any span [i, i + length[i])."""
    place = np.arange(len(length))
    return np.maximum.accumulate(np.where(length > 0, place + length, 0)) > place if len(length) else np.zeros(0, bool)


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of a string array."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(column)
    values, cuts = lists.values.slice(lists.offsets[0].as_py()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    values = values.slice(0, int(cuts[-1]))
    real = np.asarray(pc.binary_length(values)) > 0
    bounds = np.concatenate([[0], np.cumsum(real)])[cuts]
    words = values.filter(pa.array(real))
    chars = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words)).astype(np.int64))])
    match = longest_matches(np.asarray(words.cast(pa.large_binary()).dictionary_encode().indices).astype(np.int64), bounds, WINDOW)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])[bounds[1:]] - np.concatenate([[0], np.cumsum(x)])[bounds[:-1]]
    long = covered(np.where(match >= MIN_REPEAT, match, 0))
    word_chars = chars[bounds[1:]] - chars[bounds[:-1]]
    symbols, lines = [], []
    for t in column.cast(pa.large_binary()).to_pylist():
        symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
        filled = [x for x in t.split(b"\n") if x.strip()]
        lines.append(len(filled) - len(set(filled)))
    longest = np.zeros(len(column), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(column)), np.diff(bounds)), match)
    return {
        "n_words": np.diff(bounds),
        "word_chars": word_chars,
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": total(covered(np.where(match >= WINDOW, WINDOW, 0))),
        "covered": total(np.where(long, np.diff(chars), 0)) / np.maximum(word_chars, 1),
        "longest_repeat": longest,
    }


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed, kept"""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_WINDOW_PERCENT * m["n_words"])
    return failed, ~failed & (m["covered"] <= MAX_COVERED) & (m["longest_repeat"] <= MAX_LONGEST)


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept."""

    def run(batches):
        for b in slices(batches, text_col, 1 << 20):
            yield b.filter(pa.array(verdict(measured(b.column(text_col)))[1]))

    return spread(docs).mapInArrow(run, docs.schema)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the measures, base_failed and kept. longest_repeat below 5 words is approximate (0 or exact)."""

    def run(batches):
        for b in slices(batches, "text", 1 << 20):
            m = measured(b.column("text"))
            failed, kept = verdict(m)
            out = {"doc_id": b.column("doc_id")} | m | {"base_failed": failed, "kept": kept}
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[k], pa.Array) else pa.array(x) for k in names], names)

    return spread(texts(docs, id_col, text_col)).mapInArrow(run, SCHEMA)

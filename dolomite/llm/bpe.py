"""Byte-level BPE: encoding and decoding by a file of ranks.

Texts are split by the tokenizer's pattern; each distinct match of a batch is a row of a padded matrix of byte
tokens, rows bucketed by length. In a round every row merges its leftmost pair of least rank: pair ranks come from an
open-addressing hash table of (left, right), the merged column is closed up, and rows without a pair left are
taken out (compaction). A match longer than LONG bytes is a matrix of its own, in which a round merges all equal pairs that one by
one would come next, so that its rounds do not grow with its length. Distinct matches are kept in a bounded cache of the worker.

Null text is empty and gives no ids. A row per input row, repeated rows too; other columns play no part.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dolomite.llm.common import slices, spread, texts
from dolomite.llm.wordcache import Coded, WordCache, gathered

#: Bytes of a match up to which it shares a matrix with others and merges one pair a round.
LONG = 256
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> rank, by open addressing with linear probing; all operations on whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 2))) + 1)
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at, todo = self.slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]  # of several for one slot the last stays
            won = self.keys[at] == key[todo]
            self.ranks[at[won]] = rank[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where there is no such pair; ids below 0 are padding."""
        key = (left.astype(np.int64) << 32) | right
        at = self.slot(key)
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = at[todo]
        while len(todo):
            seen = self.keys[at]
            hit = seen == key[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (seen != -1)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


#: Strings on both sides of a space, by which a pattern shows whether a match begins at it: letters of several scripts and cases, digits, signs, marks.
BESIDE = ("a", "Zebra", "don't", "'s", "é", "Straße", "ΑΒγ", "中文", "あ", "7", "1234", "½", ".", "!?", '"', "_x", "(a)", "a\u0301", "\u0301", "€", "😀", "\u200d", "\x00", "-")


def begins_at_spaces(pattern) -> bool:
    """Whether a pattern's matches of a text are those of its parts, cut before each single space: of every two strings of BESIDE, and of three."""
    cut = lambda parts: pattern.findall(parts[0]) + [m for p in parts[1:] for m in pattern.findall(" " + p)]
    groups = [*((x, y) for x in BESIDE for y in BESIDE), *((x, y, x) for x, y in zip(BESIDE, BESIDE[1:]))]
    return all(pattern.findall(" ".join(g)) == cut(g) for g in groups)


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.ranks = regex.compile(pattern), ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        known = sorted((r, t) for t, r in ranks.items())
        self.piece_size = np.zeros(known[-1][0] + 1, np.int64)
        self.piece_size[[r for r, _ in known]] = [len(t) for _, t in known]
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.pieces = np.frombuffer(b"".join(t for _, t in known), np.uint8)
        self.cuts = begins_at_spaces(self.pattern)
        self.matches = WordCache(self.merge)
        self.chunks = WordCache(lambda new: self.split([" " + x for x in new]))

    def split(self, chunks: list[str]) -> Coded:
        ids, bounds = self.matches.encode_lists([self.pattern.findall(c) for c in chunks], pa.string())
        return ids, bounds[:-1], np.diff(bounds)

    def merge(self, words: list[str]) -> Coded:
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        widths = np.where(size <= 8, size, np.where(size <= 32, -(-size // 4) * 4, 2 ** np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)))
        flat, starts, sizes, used = [], np.zeros_like(size), np.zeros_like(size), 0
        for width in np.unique(widths[size <= LONG]):
            rows = np.flatnonzero((widths == width) & (size <= LONG))
            step = max(1, (1 << 21) // max(1, int(width)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                ids, n = self.merge_matrix([data[i] for i in part], int(width))
                flat.append(ids)
                starts[part], sizes[part] = used + np.cumsum(n) - n, n
                used += len(ids)
        for i in np.flatnonzero(size > LONG):
            flat.append(self.merge_long(data[i]))
            starts[i], sizes[i] = used, len(flat[-1])
            used += len(flat[-1])
        return np.concatenate([np.zeros(0, np.int32), *flat]), starts, sizes

    def merge_matrix(self, data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows, and each row's number of them."""
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), np.uint8).reshape(len(data), width)
        size = np.fromiter(map(len, data), np.int64, len(data))
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], np.int32(-1))
        done = np.full((len(data), width), -1, np.int32)
        row = np.arange(len(data))
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(data), max(0, width - 1))
        while len(row):
            n, width = ids.shape
            if width < 2:
                done[row, :width] = ids
                break
            at = rank.argmin(axis=1)  # the first of equals: the leftmost
            best = rank[np.arange(n), at]
            on = best != NONE
            if not on.all():
                done[row[~on], :width] = ids[~on]
                ids, rank, row, at, best = (x[on] for x in (ids, rank, row, at, best))
            every, columns = np.arange(len(row)), np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            ids[every, at] = best
            rank = np.take_along_axis(rank, columns[:-1] + (columns[:-1] > at[:, None]), 1)
            for pair, ok in ((at - 1, at > 0), (at, at < width - 2)):
                r, p = every[ok], pair[ok]
                rank[r, p] = self.pairs.get(ids[r, p], ids[r, p + 1])
        real = done >= 0
        return done[real], real.sum(axis=1)

    def merge_long(self, data: bytes) -> np.ndarray:
        """A matrix of one row, whose equal pairs of least rank are merged in one round where that is the same as one by one.

        It is unless a pair met on the way (the merged one with what is beside it then) has a lesser rank: then the leftmost
        alone is merged.
        """
        ids = self.byte[np.frombuffer(data, np.uint8)]
        rank = np.append(self.pairs.get(ids[:-1], ids[1:]), NONE)  # of each token with the next
        while (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of pairs that overlap every other one, from the left
            new = np.full(len(at), best, np.int32)
            behind = np.append(ids, -1)[np.minimum(at + 2, len(ids))]
            before = np.where(np.diff(at, prepend=-2) == 2, best, np.where(at > 0, ids[at - 1], -1))
            if len(at) > 1 and min(self.pairs.get(new, behind).min(), self.pairs.get(before, new).min()) <= best:
                at = at[:1]
            ids[at] = best
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, rank, at = ids[left], rank[left], at - np.arange(len(at))
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[near] = self.pairs.get(ids[near], np.append(ids, -1)[near + 1])
        return ids.astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and bounds of a string array's texts (null: empty).

        A single space between two other characters begins a match, so texts are cut there and the pieces, each with
        its space, encoded once; a text with any other white space beside a space is split as a whole. So is every text
        where the pattern's matches don't begin at spaces.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.cuts:
            flat, start, size = self.split(texts.to_pylist())
            return flat, np.append(start, len(flat))
        odd = np.asarray(pc.match_substring_regex(texts, r"(?:^|[\s\x0b\x1c-\x1f\x{85}\p{Z}]) | (?:$|[\s\x0b\x1c-\x1f\x{85}\p{Z}])"))
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        cuts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        values = lists.values.slice(lists.offsets[0].as_py(), int(cuts[-1]))
        first = values.take(pa.array(cuts[:-1])).to_pylist() if len(texts) else []
        rest = np.ones(len(values), bool)
        rest[cuts[:-1]] = False
        a, ends = self.chunks.encode(values.filter(pa.array(rest)), cuts - np.arange(len(cuts)))
        whole = iter(texts.filter(pa.array(odd)).to_pylist())
        b, heads, head_size = self.split([next(whole) if o else f for o, f in zip(odd, first, strict=True)])
        # Each text is its head (first piece, or all of an odd text) and then its other pieces.
        start = np.stack([heads, len(b) + ends[:-1]], 1).ravel()
        ids, at = gathered(np.concatenate([b, a]), start, np.stack([head_size, np.diff(ends)], 1).ravel())
        return ids, np.concatenate([[0], at[1::2]])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat bytes and bounds."""
        size = self.piece_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pieces[np.repeat(self.piece_start[ids] - (ends - size), size) + np.arange(total)], np.concatenate([[0], ends])[bounds]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def lists(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: each whole text's ids."""

    def run(batches):
        for b in slices(batches, "text"):
            ids, bounds = codec(path, pattern).encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists(ids, bounds, pa.int32())], ["doc_id", "ids"])

    return spread(texts(docs, id_col, text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes, of a frame with doc_id and ids."""

    def run(batches):
        for b in batches:
            ids = [np.asarray(x, np.int64) for x in b.column("ids").to_pylist()]
            bounds = np.cumsum([0, *map(len, ids)])
            data, at = codec(path, pattern).decode(np.concatenate([np.zeros(0, np.int64), *ids]), bounds)
            data = data.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([data[i:j] for i, j in zip(at, at[1:])], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes within a batch, so no ids travel."""
    import hashlib

    def run(batches):
        for b in slices(batches, "text"):
            own = codec(path, pattern)
            ids, bounds = own.encode(b.column("text"))
            data, at = own.decode(ids, bounds)
            ids, data = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
            sha = lambda x, cuts, w: [hashlib.sha256(x[w * i : w * j]).hexdigest() for i, j in zip(cuts.tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(sha(ids, bounds, 4), pa.string()), pa.array(sha(data, at, 1), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(texts(docs, id_col, text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

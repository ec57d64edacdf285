"""Suffix dedup: removes every byte covered by a SPAN-byte string that also starts anywhere else in the corpus.

Windows of SPAN bytes are not sorted one by one. Each window has an anchor, the leftmost least hash of its GRAM-byte
strings, so equal windows have equal anchors, and a run of neighbouring windows shares one. Three steps:

1. Every task lists its texts' runs: hash of the anchor's gram, hash of the run's whole string. By the gram's hash
   they meet. Runs whose whole string seems to occur more than once (both hashes agree) are candidates as they are, from
   their first byte on; where one gram has several strings (the ends of repeats, near copies), one run of each is a candidate by
   its suffixes. Hashes choose candidates and partitions alone: nothing is removed but by its bytes.
2. Candidates are sorted by a distributed merge sort. A task sorts its own and writes front-coded runs (common prefix
   with the one before, and the rest); these are exchanged, and a loser tree merges them by the lengths of the
   prefixes already known, so that no known prefix is compared again. The merged order comes with the common prefixes of
   neighbours. Whole strings are equal to the one before if they share all of it. Of the others' suffixes, from the anchor
   on, windows are equal if they share SPAN - o bytes there and their reversed heads share o bytes before it; both are read
   off the sorted orders, for each distance o.
3. The spans found go back to their texts, and what is left is joined up.

Memory: a task holds the runs of its share of grams, and of windows in step 2. Before the exchange each batch compares the
bytes of strings that it holds several times, and hands on one of them. Two strings under equal hashes are an error, no result. Nulls are empty texts; texts under SPAN bytes stay as they
are. Rows are told apart by 96 bits of a SHA-256 of identifier and text, so repeated rows count as occurrences of each other.
Empty input: no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dolomite.llm.common import slices, spread, written

SPAN, GRAM = 200, 48
REACH = SPAN - GRAM + 1  # grams in a window
SEGMENT, LISTED, BATCH, BLOCK = 1 << 20, 1 << 20, 3 << 20, 32
COLLISION = "two strings have equal hashes: run again with other seeds"
FIELDS = (("gram", "<u8"), ("string", "<u8"), ("doc", "<i8"), ("key", "<u4"), ("lo", "<u4"), ("n", "u1"), ("off", "u1"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# Step 1: runs of windows that share an anchor.


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an odd base and its inverse modulo 2^64, and a random word for each byte."""
    base = 0x9E3779B97F4A7C15 | 1
    rows = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for r in rows:
        r[0] = 1
        np.cumprod(r, out=r)
    return rows[0], rows[1], np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Of each width neighbours; len(x) - width + 1 values."""
    n = len(x)
    rows = np.full(-(-n // width) * width, x.max(), x.dtype)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first window, last window, anchor, gram hash of each run in the pieces of data."""
    raw = np.frombuffer(data, np.uint8)
    up, down, word = powers(max(LISTED + SEGMENT + SPAN, len(raw)))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(word[raw] * up[: len(raw)], out=total[1:])
    gram = (total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1]
    place = np.arange(len(gram), dtype=np.uint64)
    least = sliding_minimum((gram & ~np.uint64((1 << 24) - 1)) | place, REACH) & np.uint64((1 << 24) - 1)
    inside = np.zeros(len(least) + 1, np.int8)  # windows within one piece
    first, last = bounds[:-1], bounds[1:] - SPAN
    inside[first] += 1
    inside[last[last >= first] + 1] -= 1
    keep = np.flatnonzero(np.cumsum(inside[:-1]))
    anchor = least[keep].astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(keep, prepend=-2) != 1))
    begin, end = keep[new], keep[np.append(new[1:], len(keep)) - 1]
    return begin, end, anchor[new], gram[anchor[new]]


def listed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The runs of a batch's texts, as arrays of FIELDS, and their strings."""
    from xxhash import xxh3_64_intdigest

    held, rows, size = [], [], 0

    def flush() -> tuple[np.ndarray, list[bytes]]:
        data, bounds = b"".join(held), np.cumsum([0, *map(len, held)])
        begin, end, anchor, gram = anchored_runs(data, bounds)
        piece = np.searchsorted(bounds, begin, "right") - 1
        out = np.zeros(len(begin), [*FIELDS])
        info = np.array(rows, np.int64).reshape(-1, 3)[piece]
        out["gram"], out["doc"], out["key"], out["lo"] = gram, info[:, 0], info[:, 1], begin - bounds[piece] + info[:, 2]
        out["n"], out["off"] = end - begin + 1, anchor - begin
        seeds = (out["n"].astype(np.int64) << 8 | out["off"]).tolist()
        strings = [data[a:b] for a, b in zip(begin.tolist(), (end + SPAN).tolist())]
        out["string"] = np.fromiter(map(xxh3_64_intdigest, strings, seeds), np.uint64, len(out))
        return out, strings

    for doc, key, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "key", "text")], strict=True):
        for s in range(0, len(text) - SPAN + 1, SEGMENT):
            held.append(text[s : s + SEGMENT + SPAN - 1])
            rows.append((doc, key, s))
            size += len(held[-1])
            if size >= LISTED:
                yield flush()
                held, rows, size = [], [], 0
    if held:
        yield flush()


def packed(rows: np.ndarray) -> bytes:
    import zstandard

    columns = [np.diff(rows[f], prepend=0).astype("<i8") if f == "doc" else rows[f] for f, _ in FIELDS]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(rows)) + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    (n,), at = struct.unpack_from("<q", data), 8
    out = np.zeros(n, [*FIELDS])
    for f, kind in FIELDS:
        column = np.frombuffer(data, kind, n, at)
        out[f] = np.cumsum(column) if f == "doc" else column
        at += column.nbytes
    return out


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def ranges(rows: np.ndarray) -> pa.RecordBatch:
    lo = rows["lo"].astype(np.int64)
    return range_batch(rows["doc"], rows["key"].astype(np.int64), lo, lo + rows["n"] - 1 + SPAN)


def range_batch(doc, key, lo, hi) -> pa.RecordBatch:
    """Spans, those of one text that touch or overlap already joined."""
    order = np.lexsort((lo, key, doc))
    doc, key, lo, hi = doc[order], key[order], lo[order], hi[order]
    if len(lo):
        text = starts(doc, key)
        base = np.repeat(np.arange(len(text)), np.diff(np.append(text, len(lo)))).astype(np.int64) << 40
        reach = np.maximum.accumulate(base + hi)
        new = np.ones(len(lo), bool)
        new[1:] = base[1:] + lo[1:] > reach[:-1]
        at = np.flatnonzero(new)
        doc, key, hi, lo = doc[at], key[at], (reach - base)[np.append(at[1:], len(lo)) - 1], lo[at]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), -1), pa.int32()), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["part", "doc_id", "key", "lo", "hi"])


# Step 2: front-coded runs and the loser tree.


def front_coded(strings: list[bytes]) -> list[int]:
    """Of sorted strings: each one's common prefix with the one before."""
    out, before = [], b""
    for s in strings:
        out.append(common(before, s, 0))
        before = s
    return out


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of a and b, which is known to be `known` at least."""
    n = min(len(a), len(b))
    while known + 32 <= n and a[known : known + 32] == b[known : known + 32]:
        known += 32
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merged(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Of front-coded sorted runs (common prefix, rest, value): (common prefix with the one before, string, value), sorted.

    A loser tree over the runs. Each run's head carries its common prefix with the last string put out: of two heads the
    one with the longer prefix is less, at no comparison; with equal ones comparison begins behind it, and the loser
    keeps the prefix it shares with the winner. A run's next head has that prefix from its front coding.
    """
    k = len(runs)
    heads: list[bytes | None] = [None] * k
    share, value = [0] * k, [None] * k

    def advance(i: int) -> None:
        got = next(runs[i], None)
        if got is None:
            heads[i], share[i] = None, -1
        else:
            p, rest, value[i] = got
            heads[i], share[i] = (heads[i] or b"")[:p] + rest, p

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = share[a], share[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = heads[a], heads[b]
        h = common(s, t, x)
        if h == len(s) or (h < len(t) and s[h] < t[h]):
            share[b] = h
            return a, b
        share[a] = h
        return b, a

    for i in range(k):
        advance(i)
        share[i] = min(share[i], 0)  # against the empty string that came before all
    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size
    level = [i if i < k else -1 for i in range(size)]
    at = size
    while len(level) > 1:  # first round: winners go up, losers stay
        up = []
        at //= 2
        for j in range(0, len(level), 2):
            a, b = level[j], level[j + 1]
            w, lost = (a, b) if b < 0 else (b, a) if a < 0 else play(a, b)
            losers[at + j // 2] = lost
            up.append(w)
        level = up
    winner = level[0] if k else -1
    while k and share[winner] >= 0:
        yield share[winner], heads[winner], value[winner]
        leaf = winner
        advance(leaf)
        node = (leaf + size) // 2
        while node:
            if losers[node] >= 0:
                winner, losers[node] = play(winner, losers[node])
            node //= 2


def coded_run(suffixes: list[bytes], heads: list[bytes], meta: np.ndarray) -> bytes:
    """A sorted front-coded run; heads (what is before the anchor, reversed) and meta go with their suffixes."""
    import zstandard

    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    strings = [suffixes[i] for i in order]
    shared = front_coded(strings)
    rest, before = [s[p:] for s, p in zip(strings, shared, strict=True)], [heads[i] for i in order]
    columns = [np.array(shared, "<u2"), np.array([*map(len, rest)], "<u2"), np.array([*map(len, before)], "<u2"), meta[order]]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(order)) + b"".join(c.tobytes() for c in columns) + b"".join(rest) + b"".join(before))


META = np.dtype([("doc", "<i8"), ("key", "<u4"), ("lo", "<u4"), ("n", "u1"), ("off", "u1"), ("alone", "u1")])


def decoded_run(data: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, np.void]]]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    (n,), at = struct.unpack_from("<q", data), 8
    shared, rest, before = np.frombuffer(data, "<u2", 3 * n, at).reshape(3, n).tolist()
    meta = np.frombuffer(data, META, n, at + 6 * n)
    r = at + 6 * n + meta.nbytes
    b = r + sum(rest)
    for i in range(n):
        yield shared[i], data[r : r + rest[i]], (data[b : b + before[i]], meta[i])
        r += rest[i]
        b += before[i]


def equal_windows(suffixes: list[bytes], shared: np.ndarray, heads: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """candidate x distance o: whether the window that begins o bytes before the anchor occurs among the others too, and
    whether it is not the first of its equals.

    suffixes sorted; shared: common prefixes of neighbours. Suffixes of one gram are neighbours that share GRAM bytes.
    """
    n = len(suffixes)
    group = np.cumsum(shared < GRAM)
    order = np.array(sorted(range(n), key=lambda i: (group[i], heads[i])), np.int64)
    ranked = [heads[i] for i in order]
    left = np.array(front_coded(ranked), np.int64)
    new = np.diff(group[order], prepend=-1) != 0
    long_left = np.array([*map(len, heads)])
    long_right = np.array([*map(len, suffixes)])
    found, later = np.zeros((n, REACH), bool), np.zeros((n, REACH), bool)
    off, least = meta["off"].astype(np.int64), meta["off"].astype(np.int64) - meta["n"] + 1
    several = np.bincount(group)[group] > 1
    of_left = np.empty(n, np.int64)
    for o in range(REACH):
        on = np.flatnonzero(several & (o <= off) & (o >= least) & (long_left >= o) & (long_right >= SPAN - o))
        if len(on) < 2:
            continue
        of_right = np.cumsum(shared < SPAN - o)
        of_left[order] = np.cumsum(new | (left < o))
        key = of_right[on] * (n + 1) + of_left[on]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        later[on[by[1:][same]], o] = True
        found[on[by[:-1][same]], o] = True
    return found | later, later


def merged_ranges(blobs: list[bytes]) -> pa.RecordBatch:
    """The spans of a partition's candidates, from its runs."""
    shared, suffixes, values = [], [], []
    for p, s, v in merged([decoded_run(b) for b in blobs]):
        shared.append(p)
        suffixes.append(s)
        values.append(v)
    heads, meta = [v[0] for v in values], np.array([v[1] for v in values], META)
    return found_ranges(equal_windows(suffixes, np.array(shared, np.int64), heads, meta)[0], meta)


def equal_ranges(blobs: list[bytes]) -> pa.RecordBatch:
    """The spans of a partition's whole strings, each of which must equal another's bytes."""
    meta, new, before = [], [], 0
    for p, s, v in merged([decoded_run(b) for b in blobs]):
        new.append(not p == len(s) == before)
        before = len(s)
        meta.append(v[1])
    rows, first = np.array(meta, META), np.flatnonzero(new)
    if (np.diff(np.append(first, len(rows))) < 2).any():
        raise ValueError(COLLISION)
    return ranges(rows[rows["alone"] == 1])


def found_ranges(found: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
    row, o = np.nonzero(found & (meta["alone"] == 1)[:, None])
    lo = meta["lo"][row].astype(np.int64) + meta["off"][row] - o
    return range_batch(meta["doc"][row], meta["key"][row].astype(np.int64), lo, lo + SPAN)


def dealt_runs(suffixes: list[bytes], heads: list[bytes], meta: np.ndarray, parts: int) -> tuple[pa.RecordBatch, dict[int, bytes]]:
    """What candidates of one task show by themselves, and the rest as a front-coded run for each partition.

    A window found twice here is repeated; one of its equals goes on. The others go by blocks of BLOCK distances to the
    partition of the bytes that all windows of the block share, which are nearly a window long: so a frequent gram in many
    surroundings is spread over partitions.
    """
    from xxhash import xxh3_64_intdigest

    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    suffixes, heads, meta = [suffixes[i] for i in order], [heads[i] for i in order], meta[order]
    found, later = equal_windows(suffixes, np.array(front_coded(suffixes), np.int64), heads, meta)
    o = np.arange(REACH)
    off, least = meta["off"].astype(np.int64), meta["off"].astype(np.int64) - meta["n"] + 1
    on = (o <= off[:, None]) & (o >= least[:, None]) & ~later
    edge = np.zeros((len(on), REACH + 1), bool)
    edge[:, 1:] = on
    begins = on & (~edge[:, :-1] | (o % BLOCK == 0))
    row, first = np.nonzero(begins)
    ends = np.zeros_like(on)
    ends[:, :-1] = on[:, :-1] & (~on[:, 1:] | ((o[:-1] + 1) % BLOCK == 0))
    ends[:, -1] = on[:, -1]
    last = np.nonzero(ends)[1]
    by: dict[int, tuple[list, list, list]] = {}
    for i, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True):
        block = a // BLOCK
        right = SPAN - min((block + 1) * BLOCK, REACH) + 1
        core = heads[i][: block * BLOCK][::-1] + suffixes[i][:right]
        kept = by.setdefault(xxh3_64_intdigest(core, block) % parts, ([], [], []))
        m = meta[i]
        kept[0].append(suffixes[i][: SPAN - a])
        kept[1].append(heads[i][:b])
        kept[2].append((m["doc"], m["key"], m["lo"] + m["off"] - b, b - a + 1, b, m["alone"]))
    return found_ranges(found, meta), {k: coded_run(s, h, np.array(m, META)) for k, (s, h, m) in by.items()}


# The operator.


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans (array of lo, hi) of the texts (doc_id and key: a row's name; text as bytes) that have any."""
    n = partitions(docs)

    def list_runs(batches):
        for b in slices(batches, "text", BATCH):
            for rows, strings in listed(b):
                # A string that this batch holds several times is known to be repeated: one of it goes on.
                order = np.lexsort((rows["string"], rows["gram"]))
                rows = rows[order]
                first = starts(rows["gram"], rows["string"])
                count = np.diff(np.append(first, len(rows)))
                many = np.repeat(count > 1, count)
                if many.any():
                    if any(strings[i] != strings[j] for i, j in zip(order[many].tolist(), order[np.repeat(first, count)[many]].tolist())):
                        raise ValueError(COLLISION)
                    yield pa.RecordBatch.from_arrays([*(r := ranges(rows[many])).columns, pa.nulls(len(r), pa.binary())], schema=moved)
                    rows, known = rows[first], count > 1
                else:
                    known = np.zeros(len(rows), bool)
                part = (rows["gram"] >> np.uint64(20)) % np.uint64(n)
                for k, mark in ((0, known), (1, ~known)):
                    own = np.flatnonzero(mark)
                    own = own[np.lexsort((rows["doc"][own], part[own]))]
                    cut = starts(part[own]) if len(own) else []
                    blobs = [packed(rows[own[i:j]]) for i, j in zip(cut, [*cut[1:], len(own)])]
                    to = part[own[cut]].astype(np.int32) if len(own) else []
                    if len(blobs):
                        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.nulls(len(to), pa.int64()), pa.nulls(len(to), pa.int64()), pa.array([k] * len(to), pa.int64()), pa.nulls(len(to), pa.int64()), pa.array(blobs, pa.binary())], schema=moved)

    moved = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("blob", pa.binary())])
    moved_ddl = "part int, doc_id long, key long, lo long, hi long, blob binary"
    listing = written(spread(docs).mapInArrow(list_runs, moved_ddl), "runs")

    def meet(batches):
        got, known = [], []
        for b in batches:
            for k, blob in zip(b.column("lo").to_pylist(), b.column("blob").to_pylist(), strict=True):
                got.append(unpacked(blob))
                known.append(np.full(len(got[-1]), k == 0))
        if not got:
            return
        rows, known = np.concatenate(got), np.concatenate(known)
        order = np.lexsort((rows["string"], rows["gram"]))
        rows, known = rows[order], known[order]
        first = starts(rows["gram"], rows["string"])
        count = np.diff(np.append(first, len(rows)))
        again = (count > 1) | np.logical_or.reduceat(known, first)
        many = np.repeat(count > 1, count)
        yield candidates(rows[many], rows["string"][many], ~known[many], True)
        gram = starts(rows["gram"][first])
        several = np.repeat(np.diff(np.append(gram, len(first))) > 1, np.diff(np.append(gram, len(first))))
        one = rows[first[several]]
        yield candidates(one, one["gram"], ~again[several], False)

    found = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("alone", pa.bool_()), ("whole", pa.bool_())])
    found_ddl = "part int, doc_id long, key long, lo long, n int, off int, alone boolean, whole boolean"

    def candidates(rows: np.ndarray, by: np.ndarray, alone: np.ndarray, whole: bool) -> pa.RecordBatch:
        """alone: nothing else reports it yet."""
        to = ((by >> np.uint64(20)) % np.uint64(n)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array(rows["doc"]), pa.array(rows["key"].astype(np.int64)), pa.array(rows["lo"].astype(np.int64)), pa.array(rows["n"].astype(np.int32)), pa.array(rows["off"].astype(np.int32)), pa.array(alone), pa.array(np.full(len(rows), whole))], schema=found)

    met = written(listing.where("blob is not null").select("part", "lo", "blob").repartitionById(n, F.col("part")).mapInArrow(meet, found_ddl), "met")
    wanted = met.groupBy("doc_id", "key").agg(F.collect_list(F.struct("part", "lo", "n", "off", "alone", "whole")).alias("runs"))

    def code(batches):
        for b in slices(batches, "text", BATCH):
            suffixes, heads, meta = [], [], []
            wholes: dict[int, tuple[list, list]] = {}
            for doc, key, text, runs in zip(*[b.column(c).to_pylist() for c in ("doc_id", "key", "text", "runs")], strict=True):
                for r in runs:
                    lo, middle = r["lo"], r["lo"] + r["off"]
                    if r["whole"]:
                        own = wholes.setdefault(r["part"], ([], []))
                        own[0].append(text[lo : lo + r["n"] - 1 + SPAN])
                        own[1].append((doc, key, lo, r["n"], r["off"], r["alone"]))
                        continue
                    suffixes.append(text[middle : lo + r["n"] - 1 + SPAN])
                    heads.append(text[lo:middle][::-1])
                    meta.append((doc, key, lo, r["n"], r["off"], r["alone"]))
            own, coded = dealt_runs(suffixes, heads, np.array(meta, META), n)
            # Spans known already pass through the exchange, spread by their text.
            yield pa.RecordBatch.from_arrays([pa.array(own.column("key").to_numpy() % n, pa.int32()), *own.columns[1:], pa.nulls(len(own), pa.binary())], schema=moved)
            strings = {k: coded_run(x, [b""] * len(x), np.array(m, META)) for k, (x, m) in wholes.items()}
            for kind, blobs in ((0, coded), (1, strings)):
                k = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array([*blobs], pa.int32()), *[pa.nulls(k, pa.int64())] * 2, pa.array([kind] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([*blobs.values()], pa.binary())], schema=moved)

    def merge(batches):
        blobs: tuple[list, list] = ([], [])
        for b in batches:
            yield b.filter(b.column("blob").is_null()).select(["doc_id", "key", "lo", "hi"])
            for kind, blob in zip(b.column("lo").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if blob is not None:
                    blobs[kind].append(blob)
        for own, work in zip(blobs, (merged_ranges, equal_ranges), strict=True):
            if own:
                yield work(own).select(["doc_id", "key", "lo", "hi"])

    runs = docs.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "text", "runs").mapInArrow(code, moved_ddl)
    sorted_ranges = runs.repartitionById(n, F.col("part")).mapInArrow(merge, "doc_id long, key long, lo long, hi long")
    whole = listing.where("blob is null").select("doc_id", "key", "lo", "hi")
    return whole.unionByName(sorted_ranges).groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (array of lo, hi: maximal, in order), kept (the remaining bytes): a row per row of docs."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    doc = F.col(id_col).cast("long")
    name = F.sha2(F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("null")), F.sha2(text, 256)), 256)
    part = lambda at, n: F.conv(F.substring("name", at, n), 16, -10).cast("long")
    rows = docs.select(doc.alias("doc_id"), name.alias("name"), text.alias("text")).select("doc_id", part(1, 16).alias("own"), part(17, 8).alias("key"), "text")
    found = written(repeated_ranges(rows.select(F.col("own").alias("doc_id"), "key", "text")), "ranges")

    def cut(batches):
        for b in slices(batches, "text", BATCH):
            out = []
            for doc, text, spans in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "spans")], strict=True):
                removed, left, at = [], [], 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if removed and lo <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], hi)
                    else:
                        removed.append([lo, hi])
                for lo, hi in removed:
                    left.append(text[at:lo])
                    at = hi
                out.append((doc, len(text), removed, b"".join([*left, text[at:]])))
            doc, size, removed, kept = zip(*out, strict=True)
            spans = pa.array([[{"lo": x, "hi": y} for x, y in r] for r in removed], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(size, pa.int64()), spans, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    of = rows.join(found.withColumnRenamed("doc_id", "own"), ["own", "key"], "left")
    return of.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<lo: long, hi: long>>, kept binary")


def kept_digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def brute_force(texts: Iterable[bytes], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """Maximal removed spans of each text, by a table of all windows: for tests."""
    texts, seen = list(texts), {}
    for t in texts:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] = seen.get(t[i : i + span], 0) + 1
    out = []
    for t in texts:
        spans: list[list[int]] = []
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + span
                else:
                    spans.append([i, i + span])
        out.append([tuple(s) for s in spans])
    return out

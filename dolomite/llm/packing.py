"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits a sequence; the program asks for the fewest configurations that
cover every length's count. It is solved by multiplicative weights: each length has a price, a knapsack dynamic program
over the capacity finds the dearest configuration (and, of the same table, the dearest that holds each length), the best of them
take from the demand, and the prices of lengths left behind rise. The fractional solution is rounded: each
configuration is used as often as its amount rounded down, and what is left over goes by best fit into the free room of these
sequences and into new ones, whole counts of equal pieces and sequences at a time, so the work depends on the lengths and not
on the number of pieces.

Only the histogram, at most `capacity` counts, comes to the driver. Pieces are numbered within their length in two
steps (within a task, then over tasks), and a piece's number alone gives its sequence and place, so no sequence's pieces
meet in a shuffle and a frequent length is no hot key.

Null text: the end id alone, a piece of one token. Repeated rows are packed each. Empty input: no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dolomite.llm.common import slices, spread, texts, written
from dolomite.llm.token_store import encoded

ROUNDS, BURN, NEAR, RATE = 24, 12, 0.002, 0.3

Config = tuple[tuple[int, int], ...]  # (length, how often), longest first


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value for each capacity, and the last item taken for it (-1: none, a token stays free)."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            value = best[c - lengths[:k]] + price[:k]
            i = k - 1 - int(value[::-1].argmax())  # of equals the longest, which leaves the short ones for gaps
            if value[i] > best[c] + 1e-12:
                best[c], item[c] = value[i], i
    return best, item


def traced(lengths: np.ndarray, item: np.ndarray, capacity: int) -> Counter:
    out: Counter = Counter()
    while capacity > 0:
        if (i := item[capacity]) < 0:
            capacity -= 1
        else:
            out[int(lengths[i])] += 1
            capacity -= int(lengths[i])
    return out


def fractional(count: dict[int, int], capacity: int) -> tuple[dict[Config, float], float]:
    """Configurations with amounts, and a lower bound on the optimum (from the best prices met).

    In each round the configurations within NEAR of the dearest take from the demand of that round; what they leave of a
    length raises its price. The first BURN rounds find prices alone; each of the others adds its share of the counts.
    """
    lengths = np.array(sorted(count), np.int64)
    need = np.array([count[x] for x in lengths], float)
    price, amount, bound = lengths / capacity, defaultdict(float), 0.0
    place = {int(x): i for i, x in enumerate(lengths)}
    for turn in range(ROUNDS):
        left = need.copy()
        best, item = knapsack(lengths, price, capacity)
        bound = max(bound, float(need @ price) / best[capacity])
        value = price + best[capacity - lengths]
        for i in np.lexsort((-lengths, -np.round(value, 9))):
            if value[i] < (1 - NEAR) * best[capacity]:
                break
            if left[i] <= 0:
                continue
            config = traced(lengths, item, capacity - int(lengths[i]))
            config[int(lengths[i])] += 1
            if (step := min(left[place[x]] / n for x, n in config.items())) > 0:
                for x, n in config.items():
                    left[place[x]] = max(0.0, left[place[x]] - step * n)
                if turn >= BURN:
                    amount[tuple(sorted(config.items(), reverse=True))] += step / (ROUNDS - BURN)
        price = price * np.exp(RATE * (left / need - (left / need).mean()))
        price /= price.max()
    return dict(amount), bound


def best_fit(count: dict[int, int], capacity: int, begun: Counter | None = None) -> Counter:
    """Longest first, each piece into the fullest sequence that holds it; equal sequences and lengths at once.

    begun: sequences that are there already, how many of each configuration.
    """
    rooms: dict[int, Counter] = defaultdict(Counter)  # free tokens: configuration: how many
    for config, bins in (begun or {}).items():
        rooms[capacity - sum(x * n for x, n in config)][config] += bins
    for x in sorted(count, reverse=True):
        n = count[x]

        def put(config: Config, bins: int, each: int, room: int, x: int = x) -> None:
            if bins and each:
                more = tuple((y, k + each * (y == x)) for y, k in config) if any(y == x for y, _ in config) else (*config, (x, each))
                rooms[room - x * each][more] += bins

        for room in sorted(r for r in rooms if r >= x and rooms[r]):
            k = room // x
            for config in sorted(rooms[room]):
                if not n:
                    break
                bins = rooms[room].pop(config)
                full = min(bins, n // k)
                n -= full * k
                put(config, full, k, room)
                rest = bins - full
                if rest and n:
                    put(config, 1, n, room)
                    n, rest = 0, rest - 1
                if rest:
                    rooms[room][config] += rest
        k = capacity // x
        put((), n // k, k, capacity)
        put((), 1, n % k, capacity)
    return sum((rooms[r] for r in rooms), Counter())


def solve(count: dict[int, int], capacity: int) -> tuple[Counter, float]:
    """How often each configuration is used (exactly covering the counts), and the lower bound."""
    plan, left = Counter(), Counter({x: n for x, n in count.items() if n > 0 and x < capacity})
    full, bound = count.get(capacity, 0), 0.0
    if left:
        amount, bound = fractional(dict(left), capacity)
        for config, a in sorted(amount.items(), key=lambda x: (-x[1], x[0])):
            use = min(int(a + 1e-9), *(left[x] // n for x, n in config))
            if use > 0:
                plan[config] += use
                left.subtract({x: n * use for x, n in config})
        plan = best_fit({x: n for x, n in left.items() if n > 0}, capacity, plan)
    if full:
        plan[((capacity, 1),)] += full
    bound = max(bound, sum(x * n for x, n in count.items() if x < capacity) / capacity) + full
    return plan, float(np.ceil(bound - 1e-6))


def places(plan: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """length: (last number + 1 of each run, its first number, first sequence, how often in a sequence, offset)."""
    runs, sequence = defaultdict(list), 0
    for config, use in sorted(plan.items(), key=lambda x: (-x[1], x[0])):
        offset = 0
        for x, n in config:
            first = runs[x][-1][0] if runs[x] else 0
            runs[x].append((first + n * use, first, sequence, n, offset))
            offset += n * x
        sequence += use
    return {x: tuple(np.array(v, np.int64).T) for x, v in runs.items()}


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """shard, doc_id, piece, start, length, ids_crc32, number: of each piece, numbered within its length and shard."""

    def run(batches):
        from pyspark import TaskContext

        shard, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches, "text", 1 << 20):
            ids, bounds = encoded(b, path, end_id)
            total = np.diff(bounds)
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, total[row] - start)
            order = np.argsort(length, kind="stable")
            number = np.empty(len(row), np.int64)
            ranked = length[order]
            number[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            data, at = memoryview(ids.astype("<u4").tobytes()), bounds[row] + start
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), shard), pa.int32()), b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(number)], ["shard", "doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return spread(docs).mapInArrow(run, "shard int, doc_id long, piece int, start long, length long, ids_crc32 long, number long")


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(texts(docs, id_col, text_col), path, end_id, capacity), "pieces")
    by_shard = cut.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = by_shard.withColumn("earlier", F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).drop("n")
    count = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(solve(count, capacity)[0])

    def assign(batches):
        for b in batches:
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                last, first, base, n, off = where[int(x)]
                i = np.searchsorted(last, number[rows], "right")
                k = number[rows] - first[i]
                sequence[rows], offset[rows] = base[i] + k // n[i], off[i] + k % n[i] * x
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = cut.join(earlier, ["shard", "length"]).withColumn("number", F.col("number") + F.col("earlier"))
    return numbered.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Vector code compression: product quantisation with a codebook for each part, by delta-maintained Lloyd rounds.

Components become integers, floor(scale * x); each vector is cut into `parts` equal consecutive parts. A part position's codebook starts as
that part of the first vectors by identifier. A round assigns every part to the nearest entry (squared Euclidean distance, ties to the
lower index) and replaces each entry by floor(sum / count) of its parts; unused entries stay.

What persists, as tables in the shared folder: the vectors with their last assignment, and for each entry the running integer sum and
count of its parts. A round rewrites the assignments and shuffles only plus and minus contributions of parts whose assignment changed,
summed within each task first (at most a row for each entry), and adds them to the running sums. Codebooks are bounded by
parts * entries * width integers; they alone reach the driver and go back to the tasks. All arithmetic is on integers: float64
products where every intermediate is below 2^53, else int64.

Rows whose vector is null, empty, or holds null or non-finite components are dropped; so are those whose length isn't that of the first
kept row, or isn't a multiple of `parts`, so that one codebook fits all. Repeated identifiers are rows of their own, ordered by
their vectors; null identifiers come last. With fewer rows than entries the codebook is that small. Components beyond LIMIT after
scaling, whose distances would not fit a long, raise an error. Empty input gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dolomite.llm.common import released, small_or_shuffled, spread, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest magnitude of a component after scaling, and vectors for one product of matrices.
LIMIT, SLICE = 1 << 28, 4096


def vectors_of(rows: DataFrame, parts: int, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector (integers) of the rows that are kept."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    named = named.where((F.size("x") > 0) & (F.size("x") % parts == 0) & F.forall("x", good))
    first = named.select(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", F.size("x").alias("d")))["d"].alias("d")).first()["d"]
    if first is None:
        return named.select("vec_id", "label", F.array().cast("array<long>").alias("vector"))
    whole = F.transform("x", lambda v: F.when(F.abs(v * scale) <= LIMIT, F.floor(v * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling")).cast("long")))
    return named.where(F.size("x") == first).select("vec_id", "label", whole.alias("vector"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, exactly; ties to the lower index."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at].astype(np.int64)


def assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each part) and each vector's distances summed. books: part, entry, component."""
    parts, _, width = books.shape
    codes, error = np.empty((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
    for p in range(parts):
        codes[:, p], d = nearest(vectors[:, p * width : (p + 1) * width], books[p])
        error += d
    return codes, error


def contributions(vectors: np.ndarray, old: np.ndarray | None, new: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds what changed assignments take from an entry and bring to another."""
    parts, _, width = sums.shape
    for p in range(parts):
        moved = np.arange(len(new)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        x = vectors[moved, p * width : (p + 1) * width]
        for codes, sign in ((new, 1), (old, -1)):
            if codes is not None and len(moved):
                np.add.at(sums[p], codes[moved, p], sign * x)
                np.add.at(counts[p], codes[moved, p], sign)


def round_of(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label, vector, codes) with new codes and error, and `before`, the old codes where any changed (else null)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                b = batch.slice(i, SLICE)
                codes, error = assigned(matrix(b.column("vector")), shared.value)
                old = b.column("codes").to_pylist()
                now = [c.tobytes() for c in codes]
                before = pa.array([o if o != n else None for o, n in zip(old, now, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("vector"), pa.array(now, pa.binary()), before, pa.array(error)], ["vec_id", "label", "vector", "codes", "before", "error"])
        released()

    return written(rows.select("vec_id", "label", "vector", "codes").mapInArrow(run, "vec_id long, label string, vector array<long>, codes binary, before binary, error long"), "assignments")


def moved_sums(rows: DataFrame, shape: tuple[int, int, int], first: bool) -> DataFrame:
    """part, entry, n, total: what the changed assignments of a round add to the running sums and counts, a row for each entry and task at most."""
    parts, entries, width = shape

    def run(batches):
        sums, counts = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            new = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            old = None if first else np.frombuffer(b"".join(b.column("before").to_pylist()), np.uint8).reshape(-1, parts)
            contributions(matrix(b.column("vector")), old, new, sums, counts)
        part, entry = np.nonzero((counts != 0) | (sums != 0).any(2))
        flat = sums[part, entry]
        total = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), total], ["part", "entry", "n", "total"])

    changed = rows if first else rows.where("before is not null")
    return changed.select("vector", "codes", "before").mapInArrow(run, "part int, entry int, n long, total array<long>")


def summed(rows: DataFrame, width: int) -> DataFrame:
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The codebooks after the rounds, and rows (vec_id, label, vector) with their last assignment and the running sums' table."""
    place = [F.col("vec_id").asc_nulls_last(), "vector"]
    start = rows.orderBy(*place).limit(entries).select("vector").toArrow()
    width = len(start.column("vector")[0]) // parts
    books = matrix(start.column("vector")).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    now, sums = rows.withColumn("codes", F.lit(None).cast("binary")), None
    for k in range(rounds):
        now = round_of(now, books)
        moved = moved_sums(now, books.shape, not k)
        sums = written(summed(moved if sums is None else sums.unionByName(moved), width), "running-sums")
        for r in sums.where("n > 0").toLocalIterator():
            books[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return books, now


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (binary, a byte for each part), error: a row per kept row; and the codebooks (part, entry, component)."""
    kept = written(vectors_of(spread(rows.select(id_col, vector_col, label_col)), parts, scale, id_col, vector_col, label_col), "vectors")
    if kept.isEmpty():
        return kept.select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books, now = trained(kept, parts, entries, rounds)
    return round_of(now, books).select("vec_id", "label", "codes", "error"), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes (vec_id, codes) with the vector that the codes stand for, in scaled integers."""
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            at = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            flat = books[np.arange(parts)[None, :], at].reshape(len(at), parts * width)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * parts * width, pa.int32()), pa.array(flat.ravel()))], ["vec_id", "vector"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id long, vector array<long>")


def report(rows: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels), codebooks_sha256: a row per kept row."""
    codes, books = encoded(rows, **options)
    codes = codes.withColumn("label", F.struct("label"))  # of nulls, too, one value
    by_label = small_or_shuffled(written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors"))
    return codes.join(by_label, "label").select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

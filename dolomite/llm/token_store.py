"""Token-id output: documents compressed one by one with a shared zstandard dictionary.

A store has two tables in one folder. dictionary: one row (dict_hash, dictionary, dtype). blocks: documents in ascending
identifier order, a row for about BLOCK bytes of frames: bucket (a range of identifiers), start (ids before it in its
bucket), first_doc, last_doc, dict_hash, the identifiers, id counts and frame offsets of its documents, and the frames,
little-endian ids each compressed on its own. A document is read by its block's offset index alone.

The dictionary is trained on at most SAMPLE documents of at most SAMPLE_CHARS characters, chosen by a hash of the
identifier; it decides sizes only, never content. Null text: the end id alone. Rows of equal identifier are all written,
ordered by their frames; null identifiers come first. Empty input: an empty store. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dolomite.llm.common import slices, small_or_shuffled, spread, texts
from dolomite.llm.wordbpe import encoder, token_ids

SAMPLE, SAMPLE_CHARS, DICTIONARY, LEVEL = 600, 20_000, 64 << 10, 3
BLOCK = 1 << 20
BLOCKS = "bucket int, start long, first_doc long, last_doc long, n_ids long, dict_hash string, doc_ids array<long>, n_tokens array<int>, offsets array<long>, frames binary"


def encoded(batch: pa.RecordBatch, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids, end_id after each text's, and bounds."""
    ids, bounds = token_ids(batch.column("text"), path)
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(n + 1)


def train(docs: DataFrame, path: str, end_id: int, dtype: str) -> bytes:
    """The dictionary's bytes; empty where the sample is too small to train one."""
    import zstandard

    near = docs.where(F.length("text").between(1, SAMPLE_CHARS))
    # A share of the rows that holds about four samples, so that no task hands on a sample's worth of texts of its own.
    share = min(1.0, 4 * SAMPLE / max(1, docs.count()))
    near = near.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow().combine_chunks()
    if not sample.num_rows:
        return b""
    ids, bounds = encoded(sample.to_batches()[0], path, end_id)
    parts = [ids[a:b].astype(dtype).tobytes() for a, b in zip(bounds, bounds[1:])]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, parts)) // 8), parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_store(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Ids take 2 bytes where all of the vocabulary's fit there, else 4."""
    spark, docs = docs.sparkSession, texts(docs, id_col, text_col)
    dtype = "<u2" if max(encoder(path).largest, end_id) < 1 << 16 else "<u4"
    dictionary = train(docs, path, end_id, dtype)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, dictionary, dtype)], "dict_hash string, dictionary binary, dtype string").coalesce(1).write.parquet(f"{folder}/dictionary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(sorted(set(docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [])))

    def frames(batches):
        own = compressor(dictionary)
        for b in slices(batches, "text", 1 << 20):
            ids, bounds = encoded(b, path, end_id)
            data = memoryview(ids.astype(dtype).tobytes())
            w = np.dtype(dtype).itemsize
            doc = b.column("doc_id").to_numpy(zero_copy_only=False)
            out = [own.compress(data[w * i : w * j]) for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
            bucket = np.where(np.isnan(doc.astype(float)), 0, np.searchsorted(cuts, doc.astype(float), "right"))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), b.column("doc_id"), pa.array(np.diff(bounds), pa.int32()), pa.array(out, pa.binary())], ["bucket", "doc_id", "n", "frame"])

    def blocks(batches):
        bucket, at, held, size = None, 0, [], 0

        def block():
            docs_, counts, data = zip(*held, strict=True)
            known = [d for d in docs_ if d is not None] or [None]
            row = {"bucket": bucket, "start": at, "first_doc": known[0], "last_doc": known[-1], "n_ids": sum(counts), "dict_hash": dict_hash, "doc_ids": docs_, "n_tokens": counts, "offsets": np.cumsum([0, *map(len, data)]).tolist(), "frames": b"".join(data)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("bucket", pa.int32()), ("start", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_ids", pa.int64()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])
        for b in batches:
            for k, d, count, frame in zip(*[b.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "frame")], strict=True):
                if held and (k != bucket or size + len(frame) > BLOCK):
                    yield block()
                    at += sum(x[1] for x in held)
                    held, size = [], 0
                if k != bucket:
                    bucket, at = k, 0
                held.append((d, count, frame))
                size += len(frame)
        if held:
            yield block()

    rows = spread(docs).mapInArrow(frames, "bucket int, doc_id long, n int, frame binary")
    dealt = rows.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "frame")
    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def open_store(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes, str]:
    """blocks, the dictionary's bytes (verified by their hash), the ids' type."""
    (row,) = spark.read.parquet(f"{folder}/dictionary").collect()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary differs from its hash")
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where(F.col("dict_hash") == row["dict_hash"]), bytes(row["dictionary"]), row["dtype"]


def documents_of(blocks: DataFrame, dictionary: bytes, dtype: str, make, schema: str, wanted: frozenset[int] | None = None) -> DataFrame:
    """make(block's row, place in it, ids before it in its bucket, ids) for every document, or those wanted alone."""

    def rows(batches):
        own = decompressor(dictionary)
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            for row in b.to_pylist():
                got, start = [], row["start"]
                for i, (d, n) in enumerate(zip(row["doc_ids"], row["n_tokens"], strict=True)):
                    if wanted is None or d in wanted:
                        frame = row["frames"][row["offsets"][i] : row["offsets"][i + 1]]
                        got.append(make(row["bucket"], d, start, n, np.frombuffer(own.decompress(frame), dtype)))
                    start += n
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in got], schema=kinds)

    kinds = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}[f.split()[1]]) for f in schema.split(", ")])
    return blocks.mapInArrow(rows, schema)


def fetch(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """doc_id, ids of the documents asked for: reads the blocks whose range has one, and decompresses its frame only."""
    blocks, dictionary, dtype = open_store(spark, folder)
    near = F.lit(False)
    for i in ids:
        near = near | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
    return documents_of(blocks.where(near), dictionary, dtype, lambda k, d, s, n, x: (d, x.tolist()), "doc_id long, ids array<int>", frozenset(ids))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks, dictionary, dtype = open_store(spark, folder)
    rows = documents_of(blocks, dictionary, dtype, lambda k, d, s, n, x: (k, d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())), "bucket int, doc_id long, at long, n_tokens long, ids_crc32 long")
    totals = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # a row for each bucket, as many as partitions
    before = totals.alias("a").select("bucket", F.expr("sum(n) over (order by bucket) - n").alias("before"))
    return rows.join(small_or_shuffled(before), "bucket").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

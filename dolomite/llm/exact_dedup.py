"""Exact dedup: stateful streaming over keyed state on disk.

Each row arrives as (digest, identifier, locator). A streaming aggregation keyed by digest, without watermark or
expiry, holds in a RocksDB state store per digest the largest identifier, its content locator (file and identifier) and the
number of arrivals. A hit (a digest that arrived more than once) counts as a duplicate only after the full bytes of all its
texts, fetched by their locators, have been compared; texts that share a digest but not their bytes are grouped by the bytes
themselves.

Texts are equal when identical after lower-casing A-Z. Null counts as empty. Of equal texts the row with the
largest identifier stays (ties: all rows with that identifier are flagged as kept; a null identifier stays only
where its whole group has none). Empty input gives an empty result. Columns other than the two named play no part.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dolomite.llm.common import LOWER, UPPER, fresh, new_folder, small_or_shuffled, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share this much native memory; without it each has its own.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stream_state(arrivals: DataFrame, checkpoint: str, out: str) -> None:
    """Runs what has arrived through the state; each micro-batch appends the state's changed rows to the table at out.

    arrivals: a streaming frame (digest, doc_id, locator). Started again with the same checkpoint it goes on where it
    stopped, with all earlier digests still in its state.
    """
    state = arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count(F.lit(1)).alias("n"))

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/at={batch}")

    with settings(arrivals.sparkSession, STATE):
        state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per row of docs.

    digest: the key's function of the normalised text. files_per_batch: arrivals' files for a micro-batch, else all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.input_file_name().alias("file"))
    locator = F.concat_ws("#", "file", "doc_id")
    arrived = written(rows.select("doc_id", locator.alias("locator"), digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256")), "arrivals")
    folder, (source, *_) = new_folder(spark, "dedup"), [x.rpartition("/")[0] for x in arrived.inputFiles()] or [""]
    if not source:
        return arrived.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    reader = spark.readStream.schema(arrived.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream_state(reader.parquet(source).select("digest", "doc_id", "locator"), f"{folder}/checkpoint", f"{folder}/changes")
    changes = spark.read.schema("digest string, last struct<doc_id: bigint, locator: string>, n bigint, batch int").parquet(f"{folder}/changes")
    # Written, so that the join below deals out both sides anew and a frequent digest can be split.
    state = written(changes.groupBy("digest").agg(F.max("n").alias("group_size"), F.max("last.doc_id").alias("keep_id")), "state")
    hits = written(state.where("group_size > 1").select("digest"), "hits")
    # The bytes of every hit, found by the locators of its arrivals; each task compares its own first, so a group's texts never
    # meet in one place. Rows that share a locator (one identifier in one file, or none) are told apart by the digest, taken again.
    place = F.xxhash64("locator")
    suspects = written(arrived.join(small_or_shuffled(hits), "digest").select(place.alias("place"), "digest").distinct(), "suspects")
    again = rows.select(locator.alias("locator"), "norm", digest(F.col("norm")).alias("digest")).withColumn("place", place).join(small_or_shuffled(suspects), ["place", "digest"])
    differ = written(again.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b").select("digest"), "differ")
    out = arrived.join(state, "digest", "left")
    if not differ.isEmpty():
        mixed = rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest")).join(differ, "digest", "left_semi")
        apart = mixed.join(mixed.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")), "norm")
        apart = apart.select("doc_id", "keep_id", "group_size", sha256(F.col("norm")).alias("text_sha256"))
        out = out.join(differ, "digest", "left_anti").select(*apart.columns).unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; rows equal in identifier and text give one row."""
    groups = written(exact_groups(docs, id_col, text_col), "groups")
    of_id, of_text = fresh(docs, "gone_id", "gone_digest")
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(of_text))
    digest = sha256(normalised(F.col(text_col)))
    left = docs.join(small_or_shuffled(gone), F.col(id_col).cast("long").eqNullSafe(F.col(of_id)) & (digest == F.col(of_text)), "left_anti")
    if groups.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return left
    return left.withColumn(of_text, digest).dropDuplicates([id_col, of_text]).drop(of_text)

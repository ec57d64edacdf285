"""What the operators of this subpackage share: the shared folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes each up to which a side may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 200_000

#: Bytes of work after which freed memory goes back to the system, and how often within a task over texts.
RELEASE_BYTES, RELEASE_EVERY = 1 << 20, 16 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all is one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors share no folder")
        folder = "file://" + tempfile.mkdtemp(prefix="dolomite-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dolomite/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives the loss of any executor."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (written before, so that counting is cheap) with a broadcast hint if it has few rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows out anew where a small input would occupy a few cores only; larger inputs stay as they are.

    By the optimiser's estimate of the size, so nothing is run to find out.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if 4 * size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as none of df's columns (upper case or lower) has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, null texts empty: other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def released(size: int = RELEASE_BYTES) -> None:
    """Gives freed memory of a Python worker back to the system, after work on `size` bytes (nothing for little work).

    Workers stay between tasks, and both allocators would keep what a task's largest arrays took beside the executor's heap.
    """
    if size >= RELEASE_BYTES:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)


def slices(batches, column: str, most: int = 4 << 20):
    """Arrow batches cut so that the column's texts take about `most` bytes each (a longer text comes alone)."""
    import numpy as np
    import pyarrow.compute as pc

    done = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        at = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
        for a, b in zip([0, *at], [*at, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        done += int(size.sum())
        if done >= RELEASE_EVERY:
            released()
            done = 0
    batch = None
    released()

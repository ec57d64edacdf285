"""Documents as they arrive: a file stream, upserts of each batch (streaming.keyed), and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dolomite.streaming.keyed import KeyedTable, upserting


def arriving(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    """Parquet files of folder as a stream; files: how many a batch takes, the throttle."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def processed(stream: DataFrame, work: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, key: str = "path", parts: int = 64) -> StreamingQuery:
    """Each batch through work, and its rows upserted by key into the table (streaming.keyed): only the parts that a batch touches are rewritten."""
    return upserting(stream, work, KeyedTable(stream.sparkSession, table, key, parts), checkpoint)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events and their values in windows; works on a stream (with a watermark) and on a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


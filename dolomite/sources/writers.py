"""Results to files: each through Spark's writers, whose commits survive lost tasks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Columns of a formalised rule in a file.
FORMAL = ("rule_text", "status", "rule_json", "equation", "reasoning", "error")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, not made yet, below spark.checkpoint.dir, which driver and executors share.

    Where that is unset a local master (tests) gets a temporary folder of this machine; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors share no folder")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="dolomite-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/dolomite/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Deletes all that this application has materialised, indexes and keyed tables in new_folder among it: when no frame reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_folder(spark, "x")).getParent()
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what follows reads it and computes none of it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_export(results: DataFrame, summary: DataFrame, path: str, fmt: str = "json") -> None:
    """summary (one row) and results (a row per document) as JSON lines in two folders of path; nothing to write is an error."""
    if fmt.strip().lower() != "json":
        raise ValueError(f"only JSON is written, not {fmt!r}")
    if results.isEmpty():
        raise ValueError("no results to export")
    write_json(summary.coalesce(1), f"{path}/summary")
    write_json(results, f"{path}/results")


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, summary)"""
    return spark.read.json(f"{path}/results"), spark.read.json(f"{path}/summary")


def write_formal(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The six columns FORMAL as CSV; one that rows lack is empty, and a missing status is Unknown."""
    have = {c.lower() for c in rows.columns}
    kept = rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in FORMAL])
    write_csv(kept.withColumn("status", F.coalesce(F.col("status").cast("string"), F.lit("Unknown"))), path, mode=mode)


def write_normalised(rows: DataFrame, path: str, answer: str = "answer", error: str = "error") -> None:
    """original_rule_json (the row without the answer) and dfm_format: the answer, or the error's text in its place."""
    rule = F.to_json(F.struct(*[c for c in rows.columns if c not in (answer, error)]))
    said = F.coalesce(F.col(answer), F.concat(F.lit("ERROR: "), F.coalesce(F.col(error), F.lit("no answer"))))
    write_csv(rows.select(rule.alias("original_rule_json"), said.alias("dfm_format")), path)


def payload(fields: dict) -> str:
    """A result's values as JSON text: objects by their own dict(), dataclasses and others by their attributes."""
    plain = lambda o: {} if o is None else o.dict() if hasattr(o, "dict") else vars(o)
    return json.dumps(fields, default=plain, ensure_ascii=False)


def write_json(rows: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """JSON lines; by: a folder for each value of these."""
    w = rows.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path)


def flat(rows: DataFrame) -> DataFrame:
    """Lists, structs and maps as JSON text, nulls as empty text: what a CSV cell can hold."""
    cell = lambda f: F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`").cast("string")
    return rows.select(*[F.coalesce(cell(f), F.lit("")).alias(f.name) for f in rows.schema])


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    flat(rows.select(*columns) if columns else rows).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def append_csv(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, mode="append")


def exported(results: DataFrame, fmt: str = "json") -> DataFrame:
    """A row (document as JSON) per result; an unknown format is an error."""
    if fmt != "json":
        raise ValueError(f"unsupported format {fmt!r}")
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def upserted(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of new, and those of old whose key new does not have; columns are the sorted union of both, the key first."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    every = kept.unionByName(new, allowMissingColumns=True)
    return every.select(key, *sorted(c for c in every.columns if c != key))

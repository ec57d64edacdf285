"""Keyed tables by batches: partial rewrites, restarts, lost batches; resuming without unbounded state."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dolomite.streaming import incremental
from dolomite.streaming.keyed import KeyedTable, first_seen, resuming

ROW = "path string, x int"


def held(table: KeyedTable) -> dict:
    return {r[table.key]: r.x for r in table.rows().collect()}


def files(folder) -> set[str]:
    return {str(p) for p in Path(folder).glob("data/*/*/*.parquet")}


def test_a_batch_of_one_key_rewrites_one_part(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), parts=16, keep=5)
    rows = [(f"p{i}", i) for i in range(400)]
    assert len(table.upsert(spark.createDataFrame(rows, ROW), 0)) == 16
    before = files(tmp_path)
    assert len(table.upsert(spark.createDataFrame([("p7", -1)], ROW), 1)) == 1
    assert before < files(tmp_path) and len(files(tmp_path) - before) == 1
    assert held(table) == dict(rows) | {"p7": -1}
    part = table.upsert(spark.createDataFrame([("new", 5), (None, 6)], ROW), 2)
    assert held(table) == dict(rows) | {"p7": -1, "new": 5, None: 6} and len(part) <= 2
    table.upsert(spark.createDataFrame([(None, 7)], ROW), 3)
    assert held(table)[None] == 7 and table.rows().count() == 402


def test_old_versions_expire_and_readers_of_the_last_stay(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), parts=4, keep=2)
    for v in range(7):
        table.upsert(spark.createDataFrame([(f"k{i}", v) for i in range(v, 40)], ROW), v)
        old = table.rows() if v == 5 else None if v < 5 else old
    assert table.versions() == [5, 6] and old.count() == 40
    named = {f"v={r.version}/part={r.part}" for v in (5, 6) for r in spark.read.parquet(f"{tmp_path}/manifest/v={v}").collect()}
    assert {str(p.relative_to(tmp_path / "data")) for p in Path(tmp_path).glob("data/*/part=*")} == named
    assert held(table) == {f"k{i}": min(i, 6) for i in range(40)}


def test_a_lost_batch_is_not_seen_and_runs_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), parts=4)
    table.upsert(spark.createDataFrame([("a", 1), ("b", 2)], ROW), 0)
    lost = spark.createDataFrame([("a", 9)], ROW).withColumn("part", table.part_of("path")).select("part", F.struct("path", "x").alias("row"))
    lost.write.partitionBy("part").parquet(f"{tmp_path}/data/v=1")  # its manifest was never written
    assert held(table) == {"a": 1, "b": 2}
    table.upsert(spark.createDataFrame([("a", 3), ("c", 4)], ROW), 1)
    table.upsert(spark.createDataFrame([("a", 3), ("c", 4)], ROW), 1)
    assert held(table) == {"a": 3, "b": 2, "c": 4} and table.rows().count() == 3


def test_columns_may_come_later_and_clash(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), key="part", parts=2)
    table.upsert(spark.createDataFrame([(1, "r"), (2, "s")], "part int, row string"), 0)
    table.upsert(spark.createDataFrame([(2, 7, 8), (3, 9, 8)], "part int, x int, part_of_key int"), 1)
    assert {tuple(r[c] for c in ("part", "row", "x", "part_of_key")) for r in table.rows().collect()} == {(1, "r", None, None), (2, None, 7, 8), (3, None, 9, 8)}
    with pytest.raises(ValueError, match="parts"):
        KeyedTable(spark, str(tmp_path), key="part", parts=3).rows()


def test_empty_tables_and_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), parts=2)
    assert table.rows() is None and table.upsert(spark.createDataFrame([], ROW), 0) == set() and table.rows() is None


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(folder))


def test_resume_takes_each_key_once(spark, tmp_path):
    folder, mark, calls = tmp_path / "in", str(tmp_path / "mark"), []
    out, seen = KeyedTable(spark, str(tmp_path / "out"), parts=4), KeyedTable(spark, str(tmp_path / "seen"), parts=4)

    def work(rows):
        calls.extend(r.path for r in rows.collect())
        return rows.withColumn("x", F.col("x") * 10)

    for rows in ([("a", 1), ("b", 2), ("a", 5)], [("b", 3), ("c", 4)], [("a", 8), ("d", 1), (None, 2)], [(None, 3)]):
        arrive(spark, folder, rows)
        resuming(incremental.arriving(spark, str(folder), ROW), work, out, seen, mark).awaitTermination()
    assert held(out) == {"a": 10, "b": 20, "c": 40, "d": 10, None: 20}
    assert len(calls) == len(set(calls)) == 5


def test_a_batch_that_failed_runs_again(spark, tmp_path):
    folder, mark = tmp_path / "in", str(tmp_path / "mark")
    out, seen = KeyedTable(spark, str(tmp_path / "out"), parts=4), KeyedTable(spark, str(tmp_path / "seen"), parts=4)
    fail = []

    def work(rows):
        if fail:
            raise RuntimeError("lost")
        return rows

    for n, rows in enumerate(([("a", 1)], [("a", 2), ("b", 2)], [("c", 3)])):
        arrive(spark, folder, rows)
        if n == 1:
            fail.append(1)
            with pytest.raises(Exception, match="lost"):
                resuming(incremental.arriving(spark, str(folder), ROW), work, out, seen, mark).awaitTermination()
            fail.clear()
        resuming(incremental.arriving(spark, str(folder), ROW), work, out, seen, mark).awaitTermination()
    assert held(out) == {"a": 1, "b": 2, "c": 3}


def test_state_is_bounded_by_the_time_span(spark, tmp_path):
    folder, mark, states = tmp_path / "in", str(tmp_path / "mark"), []
    schema = "path string, modified timestamp"
    for hour in range(6):
        frame = spark.range(50).select(F.concat(F.lit(f"{hour}-"), F.col("id") % 25).alias("path"), F.expr(f"timestamp'2024-01-01 00:00:00' + interval {hour} hours").alias("modified"))
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        run = first_seen(incremental.arriving(spark, str(folder), schema), within="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", mark).trigger(availableNow=True).start()
        run.awaitTermination()
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 150
    assert max(states) <= 75 and states[-1] <= 75

"""The documents source over a mixed folder, its filters and stream; single-file exports and their commits."""

from __future__ import annotations

import csv
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dolomite.sources import datasource


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    datasource.register(spark)
    root = tmp_path_factory.mktemp("mixed")
    (root / "a.txt").write_text("plain é text")
    (root / "b.json").write_text('{"k": [1, 2]}')
    (root / "bad.json").write_text("{no json")
    (root / "sub").mkdir()
    (root / "sub" / "c.CSV").write_text("x,y\n1,2\n")
    (root / "sub" / "noname").write_bytes(b"raw \xff bytes")
    (root / "_hidden.txt").write_text("left out")
    (root / ".dot").write_text("left out")
    (root / "broken.docx").write_bytes(b"no zip")
    for i, p in enumerate(sorted(p for p in root.rglob("*") if p.is_file())):
        os.utime(p, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    return root


def names(frame) -> dict[str, str]:
    return {Path(r.path).name: r.text for r in frame.collect()}


def test_a_mixed_folder(spark, folder):
    rows = {Path(r.path).name: r for r in spark.read.format("documents").load(str(folder)).collect()}
    assert set(rows) == {"a.txt", "b.json", "bad.json", "c.CSV", "noname", "broken.docx"}
    assert rows["a.txt"].text == "plain é text" and json.loads(rows["b.json"].text) == {"k": [1, 2]} and rows["c.CSV"].text == "x | y\n1 | 2" and rows["noname"].text == "raw  bytes"
    assert {n for n, r in rows.items() if r.error} == {"bad.json", "broken.docx"} and all(rows[n].text == "" for n in ("bad.json", "broken.docx"))
    assert rows["c.CSV"].suffix == "csv" and rows["noname"].suffix == "" and rows["a.txt"].length == 13


def test_globs_uris_and_one_file(spark, folder):
    assert set(names(spark.read.format("documents").option("glob", "*.json").load(f"file://{folder}"))) == {"b.json", "bad.json"}
    assert set(names(spark.read.format("documents").load(f"{folder}/a.txt"))) == {"a.txt"}
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("documents").load(f"{folder}/nowhere").collect()


def test_filters_are_decided_before_files_are_opened(spark, folder):
    load = lambda **options: set(names(spark.read.format("documents").options(**options).load(str(folder))))
    assert load(suffixes="json, .TXT") == {"a.txt", "b.json", "bad.json"} and load(suffixes="json", mostBytes="8") == {"bad.json"}
    times = {Path(r.path).name: r.modified for r in spark.read.format("documents").load(str(folder)).collect()}
    middle = sorted(times.values())[3]
    assert load(modifiedAfter=middle.isoformat()) == {n for n, t in times.items() if t > middle}
    assert load(modifiedBefore=f"{middle.isoformat()}+00:00") == {n for n, t in times.items() if t < middle}
    reader = datasource.DocumentReader({"path": str(folder), "split": "1", "suffixes": "json"})
    assert [[Path(f.path).name for f in s.files] for s in reader.partitions()] == [["b.json"], ["bad.json"]]
    rows = spark.read.format("documents").load(str(folder))
    assert [rows.where(f"suffix = '{x}'").count() for x in ("txt", "csv")] == [1, 1] and rows.count() == 6


def test_splits_are_planned_by_size():
    files = [datasource.Found(str(i), 0, n) for i, n in enumerate((5, 5, 5, 30, 1, 1))]
    assert [[f.length for f in s.files] for s in datasource.splits(files, 10)] == [[5, 5], [5], [30], [1, 1]] and datasource.splits([], 10) == []


def test_a_parser_of_ones_own(spark, tmp_path):
    (tmp_path / "x.cad").write_text("abc")
    assert names(spark.read.format("documents").option("parsers", "cad=dolomite.sources.readers:parse_csv").load(str(tmp_path))) == {"x.cad": "abc"}


def test_a_stream_takes_each_file_once(spark, folder, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    for turn in range(3):
        for n in range(2):
            path = source / f"{turn}-{n}.txt"
            path.write_text(f"text {turn} {n}")
            os.utime(path, (1_700_000_000 + turn, 1_700_000_000 + turn))
        run = spark.readStream.format("documents").load(str(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        run.awaitTermination()
        assert sorted(r.text for r in spark.read.parquet(out).collect()) == sorted(f"text {t} {n}" for t in range(turn + 1) for n in range(2))


def cells(path) -> list[list[str]]:
    with open(path, newline="") as f:
        return list(csv.reader(f))


def test_csv_has_one_header_and_all_rows_in_order(spark, folder, tmp_path):
    path = tmp_path / "deep" / "rules.csv"
    rows = spark.range(0, 50, 1, 4).select("id", F.concat(F.lit('q"uote, '), "id", F.lit("\nline")).alias("text"), F.array("id").alias("list"), F.lit(None).cast("string").alias("none"), (F.col("id") > 3).alias("flag"))
    rows.write.format("single_file").mode("overwrite").save(str(path))
    got = cells(path)
    assert got[0] == ["id", "text", "list", "none", "flag"] and [r[0] for r in got[1:]] == [str(i) for i in range(50)]
    assert got[5] == ["4", 'q"uote, 4\nline', "[4]", "", "true"]
    rows.limit(1).write.format("single_file").mode("append").save(str(path))
    assert len(cells(path)) == 52 and sum(r[0] == "id" for r in cells(path)) == 1
    rows.limit(2).coalesce(1).write.format("single_file").option("columns", "text, id").mode("overwrite").save(str(path))
    assert cells(path)[0] == ["text", "id"] and len(cells(path)) == 3
    assert [p.name for p in path.parent.iterdir()] == ["rules.csv"]


def test_json_is_one_document(spark, folder, tmp_path):
    path = tmp_path / "export.json"
    rows = spark.range(0, 7, 1, 3).select("id", F.struct(F.lit("é").alias("a"), F.array(F.lit(1)).alias("b")).alias("s"))
    rows.write.format("single_file").option("format", "json").option("summary", '{"documents": 7}').mode("overwrite").save(str(path))
    got = json.loads(path.read_text())
    assert got["summary"] == {"documents": 7} and got["results"] == [{"id": i, "s": {"a": "é", "b": [1]}} for i in range(7)]
    texts = spark.createDataFrame([('{"x": 1}',), ('{"x": [2]}',)], "payload string")
    texts.write.format("single_file").option("format", "json").option("payload", "payload").mode("overwrite").save(str(path))
    assert sorted(json.loads(path.read_text())["results"], key=str) == [{"x": 1}, {"x": [2]}]


def test_a_failed_job_leaves_the_file_as_it_was(spark, folder, tmp_path):
    path = tmp_path / "export.json"
    path.write_text("before")
    bad = spark.createDataFrame([('{"x": 1}',), ("[1]",)], "payload string").repartition(2)
    with pytest.raises(Exception, match="no JSON object"):
        bad.write.format("single_file").option("format", "json").option("payload", "payload").mode("overwrite").save(str(path))
    with pytest.raises(Exception, match="no results"):
        bad.limit(0).write.format("single_file").option("format", "json").mode("overwrite").save(str(path))
    assert path.read_text() == "before"
    with pytest.raises(Exception, match="csv or json"):
        bad.write.format("single_file").option("format", "xml").mode("overwrite").save(str(path))


def test_parts_of_lost_attempts_are_not_joined(spark, folder, tmp_path):
    writer = datasource.SingleFile({"path": str(tmp_path / "x.csv")}, spark.range(1).schema, True)
    Path(writer.parts).mkdir()
    for name in ("0-lost", "0-done", "1-done"):
        Path(writer.parts, name).write_text(f"{name}\n")
    writer.commit([datasource.Part(1, f"{writer.parts}/1-done", 1), None, datasource.Part(0, f"{writer.parts}/0-done", 1)])
    assert (tmp_path / "x.csv").read_text() == "id\n0-done\n1-done\n" and [p.name for p in tmp_path.iterdir()] == ["x.csv"]

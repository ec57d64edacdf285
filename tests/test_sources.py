"""Readers, writers and streams, on files made here."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from dolomite.sources import readers, writers
from dolomite.streaming import incremental
from dolomite.streaming.keyed import KeyedTable


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("café \u0001".encode() + b"\xff end")
    (tmp_path / "in" / "b.json").write_text('{"k": ["é"]}')
    (tmp_path / "b2.json").write_text("{broken")
    (tmp_path / "t.csv").write_text("x,y\n" + "".join(f"{i},\n" for i in range(150)))
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    got = {r.path.rpartition("/")[2]: r for r in readers.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "café \u0001 end" and json.loads(got["b.json"].text) == {"k": ["é"]}
    assert got["b2.json"].error and got["b2.json"].text == "" and got["p.pdf"].error
    assert got["t.csv"].text.count("\n") == 100 and got["d.docx"].text == "Para\n\na | b"
    assert [r.path.rpartition("/")[2] for r in readers.list_files(spark, [str(tmp_path), str(tmp_path / "in")], "*.txt").collect()] == ["a.txt"]
    assert readers.pages_joined(["one", " ", "three"]) == ("--- Page 1 ---\none\n\n--- Page 3 ---\nthree", 2)


def test_rules(spark, tmp_path):
    for name, data in {"a": {"documents": [{"rules": [{"rule_text": "1"}]}, {}]}, "b": {"rules": [{"rule_text": "2"}]}, "c": {"rule_text": "3"}, "d": [{"rule_text": "4"}, {"rule_text": "5"}]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    assert sorted(json.loads(r.rule)["rule_text"] for r in readers.load_rules(spark, str(tmp_path)).collect()) == list("12345")
    with pytest.raises(Exception, match="no rules in"):
        readers.load_rules(spark, str(tmp_path / "c.json"), strict=True).collect()


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p1", 'a "b"\nc', [1, 2], None), ("", "x", [], "y"), ("p1", "later", [], None)], "path string, t string, l array<int>, n string").coalesce(1)
    writers.write_csv(rows, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c")).collect()
    assert back[0].t == 'a "b"\nc' and back[0].l == "[1,2]"
    assert [(r.path, r.t) for r in readers.resume_rows(spark, str(tmp_path / "c")).collect()] == [("p1", "later")]
    with pytest.raises(ValueError):
        writers.exported(rows, "xlsx")
    assert json.loads(writers.exported(rows).first().value)["path"] == "p1"


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, x int")
    new = spark.createDataFrame([("b", "z")], "path string, y string")
    got = writers.upserted(old, new)
    assert got.columns == ["path", "x", "y"] and sorted(map(tuple, got.collect())) == [("a", 1, None), ("b", None, "z")]


def test_schema_and_requirements(spark, tmp_path):
    blob = "\n Object: Hole\n Attributes: Depth, Kind (Type)\n\n Object: Pin\n Attribute: Radius\n Object: PMI\n"
    rows = {tuple(r) for r in readers.feature_schema(spark, {"Drill": blob}).collect()}
    assert ("Drill", "Hole", "Kind", "Type") in rows and ("Drill", "Pin", "Radius", None) in rows and ("Drill", "PMI", None, None) in rows
    assert ("Drill", "Pin", "Radius", None) not in {tuple(r) for r in readers.feature_schema(spark, {"Drill": blob}, faithful=True).collect()}
    (tmp_path / "r.txt").write_text("# c\nNumPy==1.2 # x\nother>=1\n")
    assert [tuple(r) for r in readers.requirements(spark, str(tmp_path / "r.txt")).collect()] == [("numpy", "1.2")]


def test_stream_upserts(spark, tmp_path):
    folder, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    work = lambda df: df.withColumn("n", F.length("text"))
    for text in ("one", "three"):
        spark.createDataFrame([("p", text), (text, text)], "path string, text string").write.mode("append").parquet(folder)
        incremental.processed(incremental.arriving(spark, folder, "path string, text string"), work, table, mark).awaitTermination()
    got = {r.path: r.n for r in KeyedTable(spark, table).rows().collect()}
    assert got == {"p": 5, "one": 3, "three": 5}

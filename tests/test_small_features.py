"""Summaries of domains, totals of files, clean names of answers, cached embeddings, token windows with their fallback, optimised chunks."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import functions as F

from dolomite.functions import text
from dolomite.operators import candidates, chunking, provider, reports
from dolomite.plans import pipelines
from dolomite.sources import readers


def test_domain_summary(spark):
    blobs = {"Drill": "\n Object: Hole\n Attributes: Depth, Kind (Type)\n\n Object: Pin\n Attribute: Radius\n Object: PMI\n", "Empty": " "}
    got = {r.domain: r.summary for r in readers.domain_summary(spark, blobs).collect()}
    assert got == {"Drill": "**Drill**: Hole (Depth, Kind (Type)), Pin (Radius), PMI", "Empty": "**Empty**: "}
    assert readers.domain_summary(spark, blobs, faithful=True).first().summary == "**Drill**: Hole (Depth, Kind (Type)), Pin, PMI"


def test_totals_of_a_folder_of_exports(spark, tmp_path):
    for i, (n, told) in enumerate(((2, 2), (3, None), (0, 5))):
        (tmp_path / f"{i}.json").write_text(json.dumps({"rules": [{"rule_text": str(k)} for k in range(n)]} | ({"rule_count": told} if told else {})))
    entries, totals = reports.consolidated_all(readers.rule_files(spark, str(tmp_path)))
    assert sorted(r.rule_count for r in entries.collect()) == [2, 3, 5] and tuple(totals.first()) == (3, 10)
    assert tuple(reports.consolidated_all(readers.rule_files(spark, str(tmp_path)).limit(0))[1].first()) == (0, 0)


def test_missing_requirements(spark):
    wanted = spark.createDataFrame([("NumPy", "1"), ("x", "2"), ("y", "3")], "name string, version string")
    have = spark.createDataFrame([("numpy", "1"), ("Y", "4")], "name string, version string")
    assert {r.name: r.status for r in readers.missing_requirements(wanted, have).collect()} == {"numpy": "ok", "x": "missing", "y": "other version"}


def test_names_of_an_answer_are_cleaned(spark):
    rows = spark.createDataFrame([('note {" a ": 1, "\'b\'": "x", "c": [1, {"d": 2}]} end',), ("none",), ('{"k": 1, " k": 2}',), (None,), ("{bad}",), ("{}",)], "t string")
    assert [r.m for r in rows.select(text.safe_object(F.col("t")).alias("m")).collect()] == [{"a": "1", "b": "x", "c": '[1,{"d":2}]'}, None, {"k": "1"}, None, None, {}]


def test_texts_are_embedded_once(spark, tmp_path):
    @dataclass(frozen=True)
    class Noted:
        folder: str

        def embed(self, texts):
            import uuid

            assert len(texts) <= 4
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, f"t{i % 6}" if i % 7 else None) for i in range(60)], "i int, text string").coalesce(1)
    got = {r.i: r.embedding for r in provider.embedded(rows, Noted(str(tmp_path)), batch=4).collect()}
    assert got == {i: [2.0 if i % 7 else 0.0] for i in range(60)}
    asked = [t for p in tmp_path.iterdir() for t in p.read_text().split("\n")]
    assert sorted(asked) == ["", *[f"t{k}" for k in range(6)]]


def test_token_windows_fall_back_to_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "bad one two three"), (3, None)], "i int, text string")
    tokens = lambda c: F.when(~c.contains("bad"), F.split(c, " "))
    got: dict = {}
    for r in sorted(chunking.token_windows(docs, 4, 1, tokens).collect(), key=lambda r: (r.i, r.chunk_index)):
        got.setdefault(r.i, []).append(r.chunk)
    words = [r.chunk for r in sorted(chunking.word_windows(docs.where("i = 2"), 4, 1).collect(), key=lambda r: r.chunk_index)]
    assert got[1] == ["a b c d", "d e"] and got[2] == words
    assert chunking.token_windows(docs, 4, 1).count() == chunking.word_windows(docs, 4, 1).count()


def test_chunks_to_embed(spark):
    low = "granite slabs"
    docs = spark.createDataFrame([("d", low, 1), ("e", "Steel wall thickness tolerance must hold.", 2), ("f", None, 3)], "doc_id string, text string, chunk_name int")
    got = {r.doc_id: r for r in pipelines.embedding_chunks(docs, 400).collect()}
    assert got["d"].optimised_text.startswith("Key concepts: ") and got["d"].optimised_text.endswith(got["d"].original_text) and got["d"].chunk_name == 1
    assert got["e"].optimised_text == got["e"].original_text == "Steel wall thickness tolerance must hold." and got["e"].features.density > 0 and "f" not in got


def test_sentences_keep_a_clashing_column(spark):
    rows = candidates.rule_sentences(spark.createDataFrame([("Walls must be 2 mm.", 4)], "text string, sentence int"))
    assert rows.select("sentence", "rule_text").first() == (4, "Walls must be 2 mm.")


def test_chunks_that_share_their_keys(spark):
    chunks = spark.createDataFrame([(None, "Walls must be 2 mm thick here."), (None, "Walls must be 2 mm thick here."), (1, "It must be 3 mm. ok"), (1, "Ribs must be 4 mm wide there.")], "k int, chunk string")

    @dataclass(frozen=True)
    class Short:
        def complete(self, task, text):
            return json.dumps({"rule_text": "short 1" if task == "single" else f"{text} longer text 2 mm", "confidence": 0.9})

    rows = pipelines.single_rules(chunks, Short(), retries=1).collect()
    assert len(rows) == 4 and {r.rule_text for r in rows} == {"short 1 longer text 2 mm"} and [c for c in rows[0].asDict() if c == "row"] == []


def test_replacement_characters_of_a_file_stay(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x�y".encode() + b"\xff\xfe" + "é".encode())
    assert [r.text for r in readers.load_texts(spark, str(tmp_path)).collect()] == ["x�yé"]


def test_written_tables_are_dropped_together(spark):
    from dolomite.sources import writers

    table = writers.materialised(spark.range(3), "once")
    assert table.count() == 3
    path = table.inputFiles()[0]
    writers.drop_written(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://"))

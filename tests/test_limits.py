"""Limits that hold over all workers together, and refusals that outlive them."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import pytest

from dolomite.operators.limits import Limit, asked_in_blocks, asked_together, refused_until, shares


def noted(folder: str, most: int | None = None):
    """A provider that notes the time of each call in a file of its own, and refuses from `most` calls on."""

    @dataclass(frozen=True)
    class Noted:
        folder: str
        most: int | None

        def complete(self, task, text):
            import os
            import time
            import uuid

            if self.most is not None and len(os.listdir(self.folder)) >= self.most:
                raise RuntimeError("429: tokens per day used up, try again in 17m0s")
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(time.time()))
            if text == "bad":
                raise ValueError("bad text")
            return text.upper()

    return Noted(folder, most)


def times(folder) -> list[float]:
    return sorted(float(p.read_text()) for p in Path(folder).iterdir())


def test_shares_of_a_window():
    assert shares(Limit(5), [[1] * 9, [1], []]) == [4, 1, 0]
    assert shares(Limit(9, tokens=10), [[6, 6], [3, 3]]) == [1, 1]
    assert shares(Limit(9, tokens=10), [[50, 1], [2]]) == [1, 0] and shares(Limit(9, tokens=10), [[4], [50], [4]]) == [1, 0, 1]
    assert shares(Limit(3), [[], []]) == [0, 0]


def test_refusals():
    assert refused_until("429 tokens per day, try again in 17m18s", Limit(1), 100.0) == pytest.approx(100 + 17 * 60 + 18)
    assert refused_until("429 tokens per day", Limit(1), 100.0) == 400.0 and refused_until("429 too many", Limit(1), 1.0) == refused_until("x", Limit(1), 1.0) == 0


@pytest.mark.parametrize("workers", [2, 3])
def test_workers_keep_one_limit(spark, tmp_path, workers):
    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"text {i}") for i in range(14)], "i int, chunk string")
    got = {r.i: (r.answer, r.error) for r in asked_together(rows, noted(str(tmp_path)), "extract", Limit(4, 1.5), workers=workers).collect()}
    assert got == {i: (None, "bad text") if i == 3 else (f"TEXT {i}", None) for i in range(14)}
    at = times(tmp_path)
    assert len(at) == 14 and all(sum(t <= x < t + 1.2 for x in at) <= 4 for t in at)


def test_a_refusal_stops_all_workers_and_later_runs(spark, tmp_path):
    calls, table = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    rows = spark.createDataFrame([(f"d{i}", i, f"text {i}") for i in range(12)], "document_id string, chunk_index int, chunk string")
    first = {r.chunk_index: (r.answer, r.error) for r in asked_in_blocks(rows, noted(str(calls), 5), "extract", Limit(100, 0.1), table, block_rows=4).collect()}
    assert len(first) == 12 and sum(a is not None for a, _ in first.values()) == 5 == len(times(calls))
    again = {r.chunk_index: r.answer for r in asked_in_blocks(rows, noted(str(calls), 99), "extract", Limit(100, 0.1), table, block_rows=4).collect()}
    assert sum(a is not None for a in again.values()) == 5 == len(times(calls))  # the refusal was written, so nothing is asked


def test_a_later_run_asks_what_is_left_once(spark, tmp_path):
    calls, table = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    rows = spark.createDataFrame([(f"d{i % 7}", i % 7, "bad" if i % 7 == 2 else f"text {i % 7}") for i in range(9)], "document_id string, chunk_index int, chunk string")
    asked_in_blocks(rows.where("chunk_index < 4"), noted(str(calls)), "extract", Limit(50, 0.1), table).collect()
    assert len(times(calls)) == 4
    got = asked_in_blocks(rows, noted(str(calls)), "extract", Limit(50, 0.1), table, block_rows=2).collect()
    assert len(times(calls)) == 7 and len(got) == 9
    assert {(r.chunk_index, r.answer, r.error) for r in got} == {(i, None, "bad text") if i == 2 else (i, f"TEXT {i}", None) for i in range(7)}


def test_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "document_id string, chunk_index int, chunk string")
    assert asked_together(rows, noted(str(tmp_path)), "extract", Limit(1, 0.1)).collect() == []
    assert asked_in_blocks(rows, noted(str(tmp_path)), "extract", Limit(1, 0.1), str(tmp_path / "t")).collect() == []


def test_blocks_read_their_own_rows(spark, tmp_path):
    """However many blocks, the rows are made twice (to count and to deal them), and not once a block."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return f"text {i}"

    rows = spark.range(40).select("id", F.udf(text)("id").alias("chunk"))
    got = asked_in_blocks(rows, noted(str(tmp_path)), "extract", Limit(1000, 0.0), f"{tmp_path}/store", ["id"], block_rows=5)
    before = made.value
    assert before <= 80 and got.where("answer = upper(chunk)").count() == 40

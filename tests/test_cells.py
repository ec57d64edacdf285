"""The inverted file against a full scan: recall of probing, exact answers, hot cells, edges."""

from __future__ import annotations

import numpy as np

from dolomite.operators import retrieval
from dolomite.operators.cells import CellIndex, recall

SCHEMA = "vec_id long, embedding array<float>"


def clustered(spark, n=1500, groups=30, size=16, hot=0.34, seed=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (groups, size))
    of = np.where(rng.random(n) < hot, 0, rng.integers(0, groups, n))
    rows = centre[of] + rng.normal(0, 0.25, (n, size))
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], SCHEMA).repartition(4)


def as_dict(frame):
    out: dict = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, -round(r.score, 9), r.id)):
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    return out


def test_recall_and_exactness(spark, tmp_path):
    rows = clustered(spark)
    queries = rows.where("vec_id % 20 = 0")
    index = CellIndex.write(rows, f"{tmp_path}/index", 30)
    assert index.rows().count() == 1500
    truth = retrieval.vector_search_many(rows, queries, 10)
    assert recall(index.search(queries, 10, probes=4), truth) >= 0.9
    assert as_dict(index.search(queries, 10, probes=2, exact=True)) == as_dict(truth)


def test_probing_reads_a_share_of_the_rows(spark, tmp_path):
    rows = clustered(spark, 900, hot=0.0)
    index = CellIndex.write(rows, f"{tmp_path}/index", 30)
    asked = index.probed(rows.where("vec_id % 20 = 0"), 3, "vec_id", "embedding")
    sizes = {r.cell: r.n for r in spark.read.parquet(f"{tmp_path}/index/cells").collect()}
    reads = [sum(sizes[c] for c in r.cells) for r in asked.collect()]
    assert len(reads) == 45 and np.mean(reads) < 0.35 * 900


def test_hot_cells_are_compared_in_parts(spark, tmp_path):
    rows = clustered(spark, 600, groups=3, hot=0.8)
    index = CellIndex.write(rows, f"{tmp_path}/index", 4)
    queries = rows.where("vec_id % 5 = 0")
    assert as_dict(index.search(queries, 7, probes=1, exact=True, block=40)) == as_dict(retrieval.vector_search_many(rows, queries, 7))


def test_edges(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0])], SCHEMA)
    index = CellIndex.write(rows, f"{tmp_path}/index", 8)
    got = as_dict(index.search(rows.where("vec_id in (2, 4)"), 3, probes=1, exact=True))
    assert got == {4: [(1, 1.0), (4, 1.0), (3, 0.0)]}
    none = CellIndex.write(rows.limit(0), f"{tmp_path}/none", 3)
    assert none.search(rows.where("vec_id = 4"), 3, exact=True).collect() == []


def test_tuned_probes_reach_their_recall(spark, tmp_path):
    """On vectors without clusters, where few probes find little."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 24)]) for i in range(1200)], SCHEMA)
    index, queries = CellIndex.write(rows, f"{tmp_path}/index", 24), rows.where("vec_id % 20 = 0")
    probes = index.tuned(10, 0.93)
    assert 4 < probes < 24
    assert recall(index.search(queries, 10, probes), retrieval.vector_search_many(rows, queries, 10)) >= 0.9


def test_queries_in_parts(spark):
    """Queries are dealt to parts, so that no task holds all of them; the result is the same."""
    import random

    from dolomite.operators import retrieval

    rng = random.Random(3)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<float>")
    one, many = (sorted((r.query_id, r.id, round(r.score, 9)) for r in retrieval.vector_search_many(rows, rows, 3, blocks=2, parts=p).collect()) for p in (1, 5))
    assert one == many and len(one) == 180

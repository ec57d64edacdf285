"""Every query that has SQL gives the rows that DuckDB gives; the others give some."""

from __future__ import annotations

import duckdb
import pytest

from dolomite.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(cell(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall())


def test_parts_of_one_row_group_come_in_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.read.parquet(f"{SF}/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = catalog.canonical_rules(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == spark.sparkContext.defaultParallelism and max(r["count"] for r in rows) < 2 * min(r["count"] for r in rows)


def test_textrank_ranks_every_chunk(spark, tmp_path):
    from dolomite import lexicon

    texts = {7: " ".join(f"w{i * i % 31} the x{i % 7}" for i in range(80)), 8: "bend radius must exceed thickness of the bend", 9: None}
    spark.createDataFrame([(d, "en", "s", t) for d, t in texts.items()], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, t in texts.items():
        words = (t or "").lower().split()
        for n, at in enumerate(range(0, len(words), 90)):
            w = words[at : at + 100]
            grams = {tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}
            nodes = sorted(g for g in grams if sum(x in lexicon.STOPWORDS for x in g) / len(g) <= 0.5 and len(" ".join(g)) > 2)
            weight = {a: {b: (c := len(set(a) & set(b))) + c / max(len(set(a)), len(set(b))) for b in nodes if a != b and set(a) & set(b)} for a in nodes}
            weight = {a: x for a, x in weight.items() if x}
            total = {a: sum(x.values()) for a, x in weight.items()}
            score = dict.fromkeys(weight, 1 / max(1, len(weight)))
            for _ in range(100):
                score = {a: 0.15 / len(weight) + 0.85 * sum(score[b] * c / total[b] for b, c in weight[a].items()) for a in weight}
            want[f"{d}:{n}"] = sorted((min(2 * x, 1.0) for x in score.values()), reverse=True)[:5]
    got = {}
    for r in catalog.QUERIES["textrank"](spark, str(tmp_path)).collect():
        got.setdefault(r.id, []).append(r.score)
    assert len(want) > 3 and got.keys() == {i for i, x in want.items() if x}
    for i, scores in got.items():
        assert sorted(scores, reverse=True) == pytest.approx(want[i], abs=1e-4)


def test_tfidf_of_all_terms_keeps_common_words(spark, tmp_path):
    rows = [(i, f"common word{i}") for i in range(201)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["tfidf_weights_all"](spark, str(tmp_path))
    assert found.where("term = 'common'").count() == 201 and found.count() == 402


def test_extract_enhanced_leaves_no_chunk_of_a_long_document_out(spark, tmp_path):
    filler = " ".join(f"filler{i % 97}" for i in range(9)) + ". "
    text = "".join(filler * 40 + f"The bend radius must be at least {i} mm. " for i in range(1, 56))  # 20,000 words
    spark.createDataFrame([(1, "en", "s", text)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.chunk_index for r in catalog.QUERIES["extract_enhanced"](spark, str(tmp_path)).collect()}
    assert len(found) > 20 and found == set(range(max(found) + 1))


def test_names_match():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

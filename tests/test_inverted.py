"""The stored index against the plain search over all documents, early ends, ties, edges."""

from __future__ import annotations

import random

import pytest

from dolomite import lexicon
from dolomite.operators import retrieval
from dolomite.operators.inverted import InvertedIndex

WORDS = [f"w{i}" for i in range(60)]


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus(400, 2) + [(1000, "w5 w9 w5 w9"), (1001, "w5 w9 w5 w9"), (1002, None), (1003, ""), (1004, "the of and")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def rounded(frame):
    return [(r.id, round(r.score, 9)) for r in frame.collect()]


def test_searches_equal_the_full_scan(spark, docs, tmp_path):
    index = InvertedIndex.write(docs, str(tmp_path), features=800, block=16)
    for query, k in (("w5 w9", 10), ("w40 w41 and w42", 5), ("w0", 7), ("w0 w1 w0 w55", 3), ("the w59", 20), ("w1", 500)):
        want = rounded(retrieval.keyword_search(docs, query, k, 0.1, grams=(1, 3), stop=lexicon.ENGLISH, features=800))
        assert rounded(index.search(query, k)) == want, query
    assert index.search("of the", 5).collect() == [] and index.search("", 5).collect() == [] and index.search("unknown", 5).collect() == []


def test_rare_words_end_early_and_read_few_blocks(spark, docs, tmp_path):
    index = InvertedIndex.write(docs, str(tmp_path), features=800, block=8)
    found, levels = index.traced("w5 w9", 2)
    assert [r.id for r in found.collect()] == [1000, 1001] and levels[-1] > 0
    read = index.postings(["w5"], "bigint", levels[-1]).count()
    assert 0 < read < index.postings(["w5"], "bigint").count()


def test_blocks_fall_in_weight_and_hold_every_posting(spark, docs, tmp_path):
    InvertedIndex.write(docs, str(tmp_path), features=500, block=8)
    rows = spark.read.parquet(f"{tmp_path}/postings").collect()
    assert all(len(r.ids) <= 8 and r.top == r.weights[0] >= r.weights[-1] == r.low and list(r.weights) == sorted(r.weights, reverse=True) for r in rows)
    want = {(r.id, r.term): round(r.weight, 9) for r in retrieval.tfidf(docs, grams=(1, 3), stop=lexicon.ENGLISH, features=500).collect()}
    assert {(i, r.term): round(w, 9) for r in rows for i, w in zip(r.ids, r.weights, strict=True)} == want


def test_an_empty_index(spark, tmp_path):
    index = InvertedIndex.write(spark.createDataFrame([], "doc_id string, text string"), str(tmp_path))
    assert index.search("anything", 3).collect() == []


@pytest.mark.parametrize("features, level", [(7, 1_000_000), (60, 1_000_000), (5000, 1_000_000), (60, 5)])
def test_known_terms_without_the_others(spark, monkeypatch, features, level):
    """The most frequent n-grams by levels are those of a count of all n-grams; no other n-gram is counted as a text."""
    import random

    from pyspark.sql import functions as F

    from dolomite.operators import retrieval

    rng = random.Random(features)
    text = lambda: " ".join(rng.choice(["bend", "hole", "é", "été", "the", "of", "wall", "Wall", "w_1", "x"]) for _ in range(rng.randrange(25)))
    docs = spark.createDataFrame([*[(i % 50, text()) for i in range(70)], (90, None), (91, "the of")], "doc_id long, text string").repartition(3)
    every = retrieval.terms_of(docs, grams=(1, 3), stop=("the", "of"))
    top = every.groupBy("term").agg(F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(features)
    want = sorted(map(tuple, every.join(top, "term").select("id", "term", "tf").collect()))
    monkeypatch.setattr(retrieval, "LEVEL", level)
    if level > 5:
        monkeypatch.setattr(retrieval, "terms_of", None)
    assert sorted(map(tuple, retrieval.known_terms(docs, "doc_id", "text", (1, 3), ("the", "of"), features).collect())) == want


def test_df_by_broadcast_and_by_shuffle(spark):
    """Terms sent to every task, terms shuffled and terms of one document get the same numbers; rows of one id are one document."""
    rows = [(i, " ".join(f"t{k}" for k in range(40) if i % (k + 1) == 0) + f" own{i} own{i}") for i in range(60)] + [(7, "t3 more own7"), (None, "t0 own7"), (None, "t0 t0"), (70, None), (71, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    tf = retrieval.counted_terms(docs, "doc_id", "text", (1, 2), ("own3",))
    want = retrieval.terms_of(docs, "doc_id", "text", (1, 2), ("own3",))
    assert sorted(map(str, tf.collect())) == sorted(map(str, want.collect()))
    df = {r.term: r["count"] for r in want.groupBy("term").count().collect()}
    for most in (0, 5, 1000):
        found = retrieval.with_df(tf, most).collect()
        assert len(found) == want.count() and all(r.df == df[r.term] for r in found)


def test_terms_of_documents_are_not_shuffled(spark):
    """Words of documents of their own ids are counted in place: what is shuffled is each term's count of documents, and the weights by document."""
    rows = [(i, " ".join(f"w{(i * k) % 50}" for k in range(60))) for i in range(200)]
    plan = retrieval.tfidf(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(id" in plan


def test_texts_are_tokenised_once_and_documents_not_shuffled(spark, tmp_path, monkeypatch):
    """An index reads each text once, and what goes to its tasks are lists of postings, not a row a posting."""
    from pyspark.sql import functions as F

    rows = corpus(200, 5)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).select("doc_id", read("text").alias("text"))
    monkeypatch.setattr(retrieval, "PAGE", 300, raising=False)
    index = InvertedIndex.write(docs, str(tmp_path), features=700, block=8)
    assert seen.value == len(rows)
    want = retrieval.keyword_search(spark.createDataFrame(rows, "doc_id long, text string"), "w5 w9", 10, 0.1, grams=(1, 3), stop=lexicon.ENGLISH, features=700)
    assert rounded(index.search("w5 w9", 10)) == rounded(want)


def test_postings_of_a_frequent_term_in_several_tasks(spark, tmp_path, monkeypatch):
    from dolomite.operators import inverted

    monkeypatch.setattr(inverted, "TASK", 16)
    rows = [(f"d{i}", "all " * (1 + i % 5) + f"w{i % 7} w{i}") for i in range(150)] + [("d3", "all w3"), (None, "all w1")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    InvertedIndex.write(docs, str(tmp_path), features=400, block=4, stop=())
    found = {(i, r.term): round(w, 9) for r in spark.read.parquet(f"{tmp_path}/postings").collect() for i, w in zip(r.ids, r.weights, strict=True)}
    assert found == {(r.id, r.term): round(r.weight, 9) for r in retrieval.tfidf(docs, grams=(1, 3), features=400).collect()}
    want = retrieval.keyword_search(docs, "all w3 w17", 20, 0.1, grams=(1, 3), stop=(), features=400)
    assert rounded(InvertedIndex(spark, str(tmp_path)).search("all w3 w17", 20)) == rounded(want)

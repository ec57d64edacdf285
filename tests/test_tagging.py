"""The perceptron on a made language with known tags; features, phrases and entities from tags."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dolomite.operators import tagging

NOUNS, ADJ, VERBS, DET = ["bracket", "fixture", "flange", "housing", "rib", "wall"], ["rigid", "hollow", "threaded", "thin"], ["holds", "supports", "touches"], ["the", "a"]


def sentence(rng) -> tuple[list[str], list[str]]:
    words, tags = [], []
    for part in (DET, ADJ if rng.random() < 0.6 else [], NOUNS, VERBS, DET, NOUNS):
        if part:
            words.append(rng.choice(part))
            tags.append({id(DET): "DET", id(ADJ): "ADJ", id(NOUNS): "NOUN", id(VERBS): "VERB"}[id(part)])
    if rng.random() < 0.5:
        words += ["at", str(rng.randint(1, 99)), "mm"]
        tags += ["ADP", "NUM", "NOUN"]
    return words, tags


@pytest.fixture(scope="module")
def tagger(spark):
    rng = random.Random(1)
    rows = [sentence(rng) for _ in range(300)] + [([], []), (["odd"], ["A", "B"])]
    return tagging.Tagger.train(spark.createDataFrame(rows, "words array<string>, tags array<string>"), epochs=3, parts=3)


def test_held_out_sentences(spark, tagger):
    rng = random.Random(77)
    rows = [(i, *sentence(rng)) for i in range(80)]
    got = tagger.tag(spark.createDataFrame(rows, "i int, words array<string>, truth array<string>")).collect()
    right = sum(a == b for r in got for a, b in zip(r.tags, r.truth, strict=True))
    assert right / sum(len(r.truth) for r in got) >= 0.98 and tagger.tags == ("ADJ", "ADP", "DET", "NOUN", "NUM", "VERB")
    odd = tagger.tag(spark.createDataFrame([(None,), ([],), (["unseen", "words"],)], "words array<string>")).collect()
    assert [len(r.tags) for r in odd] == [0, 0, 2]


def test_training_is_the_same_again(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([sentence(rng) for _ in range(60)], "words array<string>, tags array<string>")
    one, two = (tagging.Tagger.train(rows, epochs=2, parts=2) for _ in range(2))
    flat = lambda t: {(c, g): round(x, 9) for c, of in t.weights.items() for g, x in of.items()}
    assert flat(one) == flat(two)
    assert len(tagging.Tagger.train(rows, epochs=1, most=20, parts=2).weights) <= 20


def test_entities_are_runs(spark):
    rows = spark.createDataFrame([(["Acme", "Tools", "sells", "two", "M8", "bolts", "and", "M9"], ["B-ORG", "I-ORG", "O", "CARDINAL", "B-PRODUCT", "I-PRODUCT", "O", "B-PRODUCT"]), (["a", "b"], ["B-ORG", "B-ORG"]), ([], [])], "w array<string>, t array<string>")
    got = [[tuple(e) for e in r.e] for r in rows.select(tagging.entities(F.col("w"), F.col("t")).alias("e")).collect()]
    assert got == [[("Acme Tools", "ORG"), ("two", "CARDINAL"), ("M8 bolts", "PRODUCT"), ("M9", "PRODUCT")], [("a", "ORG"), ("b", "ORG")], []]


def test_features_and_phrases(spark, tagger):
    rows = spark.createDataFrame([(1, "The threaded bracket supports a wall at 5 mm.", "x"), (2, None, "y"), (3, "", "z")], "doc_id int, text string, words string")
    named = tagging.Tagger({"bias": {"O": 1.0}, "s=d": {"CARDINAL": 5.0}}, ("CARDINAL", "O"))
    got = {r.doc_id: r for r in tagging.text_features(rows, tagger, named).collect()}
    one = got[1].features
    assert one.complexity == pytest.approx(2 / 9) and [tuple(e) for e in one.entities] == [("5", "CARDINAL")] and got[1].words == "x"
    assert got[2].features.complexity == got[3].features.complexity == 0.0 and got[2].features.entities == []
    assert "supports" in {r.phrase for r in tagging.tagged_phrases(rows, tagger).collect()}
    found = {r.phrase for r in tagging.tagged_phrases(rows, tagger, priority=("NOUN", "PROPN", "ADJ")).collect()}
    assert {"bracket", "threaded bracket", "wall", "threaded"} <= found and "supports" not in found and "the" not in found and "the threaded" in found

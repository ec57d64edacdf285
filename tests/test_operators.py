"""Operators without SQL against plain Python, and the edges of the others."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions import formal, rules as r, text as t
from dolomite.operators import candidates, chunking, expressions, postprocess, provider, reports, retrieval
from dolomite.plans import pipelines


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


TEXT = "One two three. Four five six seven! Eight? Nine ten eleven twelve thirteen fourteen. Fifteen"


def python_chunks(text, size, overlap):
    out, held, n = [], [], 0
    count = lambda s: len(s.split())
    for s in re.split(r"(?<=[.!?])\s+", text):
        if n + count(s) > size and held:
            out.append((" ".join(held).strip(), n))
            held = held[-2:] + [s] if overlap else [s]
            n = count(" ".join(held))
        else:
            held, n = held + [s], n + count(s)
    return out + ([(" ".join(held).strip(), n)] if " ".join(held).strip() else [])


@pytest.mark.parametrize("size", [1, 4, 8, 100])
@pytest.mark.parametrize("overlap", [True, False])
def test_sentence_chunks(spark, size, overlap):
    got = chunking.sentence_chunks(docs(spark, TEXT, "", None), size, overlap).orderBy("doc_id", "chunk_index").collect()
    assert [(x.chunk, x.token_count) for x in got if x.doc_id == 0] == python_chunks(TEXT, size, overlap)
    assert {x.doc_id for x in got} == {0}


def test_windows(spark):
    words = " ".join(map(str, range(25)))
    got = [x.chunk.split() for x in chunking.windows(docs(spark, words, "", None), 10, 3).orderBy("chunk_index").collect()]
    assert [(w[0], w[-1]) for w in got] == [("0", "9"), ("7", "16"), ("14", "23"), ("21", "24")]
    tail = chunking.windows(docs(spark, words), 10, 8, keep_tail=True).count()
    assert tail == 13 and chunking.windows(docs(spark, words), 10, 8).count() == 9
    assert chunking.windows(docs(spark, "a b"), 0, 5).count() == 2


def test_thinned(spark):
    rows = spark.range(100).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("chunk_index"))
    for most in (1, 2, 7, 100, 200):
        want = sorted({round(i * 99 / (most - 1)) for i in range(most)}) if 1 < most < 100 else [0] if most == 1 else list(range(100))
        assert sorted(x.chunk_index for x in chunking.thinned(rows, most).collect()) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""), ("--- Page 1 ---\nNote:  Holes must be drilled", "Holes must be drilled."), ("12. Use steel -", "Use steel -."), ("• Page 3 of 9 ok!", "ok!"),
        ("3 / 10 rest", "rest."), ("x " * 200, ("x " * 120).rstrip().rsplit(" ", 1)[0] + " x..."),
    ],
)
def test_canonical(spark, text, want):
    got = one(spark, t.canonical, text)
    assert got == want or (len(text) > 240 and got.endswith("...") and len(got) <= 243)


def test_json_part(spark):
    assert one(spark, t.json_part, '```json\n[{"a": 1}]\n```') == '[{"a": 1}]'
    assert one(spark, t.json_part, 'Sure: {"a": [1]} done') == '{"a": [1]}'
    assert one(spark, t.json_part, "none") is None


def test_numbers_and_waits(spark):
    assert one(spark, t.numbers, "1-5mm, .5 and 1,200") == [1.0, -5.0, 0.5, 1.0, 200.0]
    assert one(spark, t.wait_seconds, "Please try again in 17m18s.") == 17 * 60 + 23
    assert one(spark, t.wait_seconds, "later") == 20


def test_confidence(spark):
    for value, want in [("0.9", 0.9), ("0", 0.6), ("1.7", 1.0), ("-2", 0.0), ("high", 0.6), (None, 0.6), ("1.5d", 0.6)]:
        assert one(spark, lambda c: r.confidence(c), value) == want


def test_unresolved(spark):
    cases = {'{"all_of":[]}': True, '{"any_of":[{"all_of":[]}]}': True, '{"conditions":[{"x":1}]}': False, '[{"subject":"a"},{"anyOf":null}]': True, "text": False, '{"all_of":[{"a":1}],"any_of":[]}': False, None: False}
    for payload, want in cases.items():
        assert bool(one(spark, r.unresolved, payload)) is want, payload


def test_types_and_categories(spark):
    assert one(spark, r.rule_type, " Design Requirement ") == "general" and one(spark, r.rule_type, "Tolerance") == "tolerance" and one(spark, r.rule_type, None) == "general"
    assert one(spark, r.rule_category, "sheet metal") == "Sheet Metal" and one(spark, r.rule_category, "pharma things") == "Quality Control" and one(spark, r.rule_category, "odd") == "General"


def test_parsed_rules(spark):
    answers = ['[{"rule_text":" A 1 ","confidence":0},{"canonical_statement":"B","confidence_score":"0.9","severity":"advisory","supporting_quote":"q","supporting_quotes":["z"]},{"rule_text":" "}]', 'x {"rules":[{"rule_text":"C","primary_constraints":[{"parameter":"p","units":"mm"}]}]}', "bad", None, '{"rule_text":"D","constraints":"a > 1"}']
    df = spark.createDataFrame(list(enumerate(answers)), "doc_id int, answer string")
    got = {(x.doc_id, x.rule_text): x for x in provider.parsed_rules(df).collect()}
    assert set(got) == {(0, "A 1"), (0, "B"), (1, "C"), (4, "D")}
    assert got[0, "A 1"].confidence == 0.6 and got[0, "B"].confidence == 0.9 and got[0, "B"].supporting_quotes == ["q", "z"]
    assert got[1, "C"].constraints[0].subject == "p" and got[1, "C"].constraints[0].unit == "mm" and got[1, "C"].severity == "ENFORCEABLE"
    assert got[4, "D"].severity == "ENFORCEABLE" and got[0, "B"].severity == "ADVISORY"


def test_provider_errors_are_rows(spark):
    class Broken:
        def complete(self, task, text):
            if "2" in text:
                raise RuntimeError("no")
            return "fine"

    got = {x.text: (x.answer, x.error) for x in provider.asked(docs(spark, "1", "2", None), Broken(), "extract", "text").collect()}
    assert got == {"1": ("fine", None), "2": (None, "no"), None: ("fine", None)}
    assert provider.Failover((Broken(), provider.Offline())).complete("classify", "drill 2") == "Drill"
    with pytest.raises(RuntimeError):
        provider.Failover((Broken(),), 2).complete("x", "2")


def test_leaders(spark):
    texts = ["hole diameter must be five mm", "hole diameter must be five mm now", "other words entirely here", "hole diameter must be five mm"]
    rows = spark.createDataFrame([(1, i, x, c) for i, (x, c) in enumerate(zip(texts, [0.5, 0.9, 0.5, 0.4], strict=True))], "doc_id int, rule_index int, rule_text string, confidence double")
    got = {x.rule_index: x.leader for x in postprocess.similar_leaders(rows, threshold=0.5).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1}


def test_extraction(spark):
    rows = docs(spark, "Walls must be 2 mm thick. Nothing to see here at all, not one thing. Walls must be 2 mm thick. Ribs should be 1 mm.", "short 1", "words without any of the cues that make a rule, and long enough to be read", None)
    found, summary = pipelines.extract(rows)
    assert {x.doc_id: (x.status, x.rule_count) for x in summary.collect()} == {0: ("success", 2), 1: ("insufficient_text", 0), 2: ("no_rules", 0), 3: ("insufficient_text", 0)}
    faithful, _ = pipelines.extract(rows, settings=pipelines.Settings(faithful=True))
    assert found.count() == 2 and faithful.count() == 1
    checked, _ = pipelines.extract_validated(rows)
    assert {x.validation_state for x in checked.collect()} == {"ADVISORY_ONLY"}


def test_formalise(spark):
    rules = spark.createDataFrame([("Minimum Bend.Radius shall be 1.5 mm",), ("Be kind",), (" ",), (None,), ("Distance between a hole and an edge must be 4",)], "rule_text string")
    got = {x.rule_text: x for x in pipelines.formalise(rules).collect()}
    assert got["Minimum Bend.Radius shall be 1.5 mm"].equation == "Bend.Radius >= 1.5" and got["Be kind"].status == "Skipped" and len(got) == 3


def test_expressions(spark):
    e = expressions
    row = spark.createDataFrame([(3.0, 2.0)], "a double, b double")
    known = {"P.A": F.col("a"), "P.B": F.col("b")}
    for text, want in [("P.A + P.B * 2", 7), ("(P.A + P.B) * 2", 10), ("-P.A + .5", -2.5), ("max(P.A, P.B, 9) - min(1, P.B)", 8), ("P.A / 0", None), ("2 - 1 - 1", 0)]:
        assert row.select(e.compiled(e.parse_math(text), known)).first()[0] == want
    for bad in ("__import__('os')", "1 +", "P.A P.B", "(1", "abs(1)", "1 ** 2"):
        with pytest.raises(ValueError):
            e.parse_math(bad)
    with pytest.raises(ValueError):
        e.build({"op": "max", "operands": []})
    tree = e.parse('{"op": "!=", "left": "P.A", "right": 0.5}')
    assert row.select(e.compiled(tree, known)).first()[0] and e.problems(tree, {}) == ["unknown variable P.A"]
    assert e.build(json.loads(json.dumps(e.dumped(tree)))) == tree


def test_entities_and_relations(spark):
    assert one(spark, formal.entity, "the EDGES of it") == "PartEdge" and one(spark, formal.entity, "nothing") is None
    known = F.array(F.lit("CBHole"), F.lit("Hem"))
    assert one(spark, lambda c: formal.canonical_entity(c, known), "Counterbore.Depth") == "CBHole.Depth"
    assert one(spark, lambda c: formal.canonical_entity(c, known), "Curl.Depth") == "Curl.Depth"
    assert one(spark, lambda c: formal.relation_problem(c, F.lit(1)), "AdjacentTo") == "Wrong number of entities"
    assert one(spark, formal.chained_access, "a.b.c") == ["b"]


def test_retrieval_edges(spark):
    none = docs(spark).limit(0)
    assert retrieval.tfidf(none).count() == 0 and retrieval.keyword_search(none, "x").count() == 0
    rows = spark.createDataFrame([(i, [float(i), 1.0], i) for i in range(6)], "vec_id int, embedding array<float>, label int")
    got = retrieval.vector_search(rows, [1.0, 0.0], 2).collect()
    assert [x.id for x in got] == [5, 4]
    assert provider.embedded(docs(spark, "a b", None), provider.HashedEmbedder(8)).count() == 2
    assert provider.reranked(spark.createDataFrame([(2, "bb"), (1, "a")], "id int, text string"), lambda ts: [float(len(x)) for x in ts], 1).first().id == 2


def test_many_queries(spark):
    import random

    rng = random.Random(1)
    data = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(70)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = retrieval.vector_search_many(rows, rows.where("vec_id % 20 = 0"), 5, blocks=3).collect()
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in (0, 20, 40, 60):
        own = {r.id: r.score for r in got if r.query_id == q}
        truth = sorted((cosine(data[q][1], v) for _, v in data), reverse=True)[:5]
        assert sorted(own.values(), reverse=True) == pytest.approx(truth) and all(own[i] == pytest.approx(cosine(data[q][1], data[i][1])) for i in own)


def test_features(spark):
    got = one(spark, candidates.features, "Steel plates: tolerance and thickness in mm")
    assert {(m.term, m.category) for m in got.matches} == {("steel", "materials"), ("tolerance", "specifications"), ("thickness", "specifications"), ("mm", "measurements")}
    assert candidates.document_context(docs(spark, "", None, "Steel is hard. Yes."), lexicon.GLOSSARY).count() == 3


def test_report_edges(spark):
    none = spark.createDataFrame([], "status string, rule_count long, seconds double, avg_confidence double")
    assert reports.run_summary(none).first().documents == 0
    labelled = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.1), (0, 0.1), (1, None)], "label int, confidence double")
    got = reports.label_scores(labelled).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.accuracy) == (1, 1, 2, 1, 0.4)


def test_leaders_by_join_equal_leaders_in_groups(spark):
    import random

    rng = random.Random(7)
    words = [f"word{i}" for i in range(25)]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(25)]
    rows = []
    for i in range(300):
        text = rng.choice(base).split()
        if rng.random() < 0.6:
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i % 3, i, rng.choice([" ".join(text)] * 9 + ["", None]), rng.choice([0.2, 0.5, 0.9])))
    rules = spark.createDataFrame(rows, "doc_id long, rule_index int, rule_text string, confidence double").repartition(3)
    for threshold, features in ((0.8, 1000), (0.5, 60)):
        told = [sorted(map(tuple, postprocess.similar_leaders(rules, threshold=threshold, features=features, most=m).collect())) for m in (1000, 10)]
        assert told[0] == told[1] and any(i != lead for _, i, lead in told[0])


def test_rank_in_rounds_equals_rank_in_groups(spark):
    import random

    from dolomite.operators import graphs, retrieval

    rng, rows = random.Random(1), []
    for doc in (1, 2):
        pairs = {tuple(sorted(rng.sample([f"p{i}" for i in range(12 * doc)], 2))) for _ in range(30)}
        rows += [(doc, a, b, rng.choice([0.5, 1.0, 2.0])) for a, b in pairs]
    edges = spark.createDataFrame([*rows, (3, "a", "b", 0.0), (3, "b", "c", 1.0)], "id long, src string, dst string, weight double")
    told = [sorted((r.id, r.phrase, round(r.score, 6)) for r in retrieval.text_rank(edges, rounds=20, keep=50, most=m).collect()) for m in (10_000, 5)]
    assert told[0] == told[1] and len({i for i, _, _ in told[0]}) == 3
    assert not graphs.page_rank(edges, rounds=1).where("converged").count()
    few = {r.phrase: r.score for r in graphs.page_rank(edges.where("id = 3"), rounds=1).collect()}
    assert few == {"a": 0.5, "b": 1.0, "c": 0.5}


def test_graphs_within_rows_equal_graphs_by_joins(spark):
    """Edges of bounded texts are made within their rows: no join of phrases, of which Spark would broadcast a side, and no shuffle of edges."""
    import random

    from dolomite.operators import retrieval

    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["hole", "bend", "the", "of", "wall", "Wall", "radius", "é1", "a", "mm", "x y"]) for _ in range(n))
    docs = spark.createDataFrame([*[(i % 40, text(rng.randrange(30))) for i in range(60)], (90, None), (91, ""), (92, "one"), (93, text(200))], "doc_id long, text string")
    edges = retrieval.phrase_graph(retrieval.phrases(docs))
    want = sorted((r.id, r.src, r.dst, round(r.weight, 9)) for r in edges.collect())
    ranks = sorted((r.id, r.phrase, round(r.score, 9)) for r in retrieval.text_rank(edges).collect())
    for most in (2000, 60, 0):
        assert sorted((r.id, r.src, r.dst, round(r.weight, 9)) for r in retrieval.graph_of_texts(docs, most=most).collect()) == want
        assert sorted((r.id, r.phrase, round(r.score, 9)) for r in retrieval.rank_of_texts(docs, most=most).collect()) == ranks
    plan = retrieval.local_graphs(retrieval.phrase_lists(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rounds", [100, 3])
def test_phrases_ranked_without_their_pairs(rounds):
    """Scores of rows side by side are those of each row's pairs, converged or not, ties by the alphabet's bytes; no pairs are held."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(rounds)
    words = ["the", "of", "x", "bend", "é", "été", "wall", "a", "must", "w1", "w2", "ab\x01", "ab"]
    rows = [[" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(rng.randrange(3))] for _ in range(60)] + [[""], ["one"], ["one two three"], [" ".join(f"q{i}" for i in range(30))]]
    got = {}
    for r, p, s in zip(*(x.tolist() for x in retrieval.ranked_phrases(pa.array(rows, pa.list_(pa.string())), rounds, 0.85, 5)), strict=True):
        got.setdefault(r, []).append((p, round(s, 9)))
    for r, texts in enumerate(rows):
        grams = {" ".join(w[i : i + n]) for w in map(str.split, texts) for n in (1, 2, 3) for i in range(len(w) - n + 1) if sum(x in lexicon.STOPWORDS for x in w[i : i + n]) <= n / 2}
        phrases = sorted((g for g in grams if len(g) > 2), key=str.encode)
        _, a, b, shared, longer = retrieval.pairs_of(pa.array([phrases], pa.list_(pa.string())))
        place, score = retrieval.ranked(a, b, shared + shared / longer, rounds, 0.85, 5) if len(a) else ([], [])
        assert got.get(r, []) == [(phrases[i], round(float(x), 9)) for i, x in zip(place, score, strict=True)]
    hub = pa.array([[" ".join(f"hub u{r}v{i}" for i in range(300))] for r in range(20)], pa.list_(pa.string()))  # 14 million pairs
    tracemalloc.start()
    assert len(retrieval.ranked_phrases(hub, 100, 0.85, 5)[0]) == 100
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_components_of_chains(spark):
    from dolomite.operators import graphs

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (100, 110), (7, 7)], "src long, dst long")
    assert {r.node: r.component for r in graphs.components(edges).collect()} == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, 110: 90}
    assert graphs.components(edges.limit(0)).collect() == []


def test_clusters_by_joins_equal_clusters_in_groups(spark):
    import random

    rng, rows = random.Random(9), []
    topics = [[f"topic{t}word{i}" for i in range(12)] for t in range(4)]
    for doc, n in ((1, 40), (2, 24), (3, 4), (4, 9)):
        for i in range(n):
            topic = topics[i % 4]
            rows.append((doc, i, " ".join(rng.choices(topic, k=9)) if i % 11 else "", [0.3, 0.8, 0.5][i % 3]))
    rules = spark.createDataFrame(rows, "doc_id long, rule_index int, rule_text string, confidence double").repartition(3)
    told = [sorted((r.doc_id, r.rule_index) for r in postprocess.cluster_best(rules, whole=w).collect()) for w in (100, 20)]
    assert told[0] == told[1]
    kept = {d: [i for x, i in told[0] if x == d] for d in (1, 2, 3, 4)}
    assert 2 <= len(kept[1]) <= 5 and kept[3] == [0, 1, 2, 3] and len(kept[4]) <= 3


def test_planted_clusters_keep_their_best(spark):
    texts = [f"alpha beta gamma delta {w}" for w in ("one", "two", "three", "four")] + [f"red green blue black {w}" for w in ("five", "six", "seven", "eight")] + [f"north south east west {w}" for w in ("nine", "ten", "eleven", "twelve")]
    rules = spark.createDataFrame([(1, i, t, 0.9 if i in (2, 5, 8) else 0.4) for i, t in enumerate(texts)], "doc_id long, rule_index int, rule_text string, confidence double")
    assert sorted(r.rule_index for r in postprocess.cluster_best(rules, most=3).collect()) == [2, 5, 8]


def test_leaders_of_documents_over_batches(spark):
    """Documents that share a batch or go over several give what each gives alone, a document without identifier among them; no call a document."""
    words = "bend radius hole edge depth wall draft rib boss slot".split()
    rows = [(None if d == 6 else d, i, " ".join(words[(d + i * k) % 10] for k in range(1, 4 + i % 2)), None if i == 5 else (i * 7 % 4) / 4) for d in range(7) for i in range(9)]
    rules = spark.createDataFrame(rows, "doc_id long, rule_index int, rule_text string, confidence double").repartition(3)
    led = lambda frame: sorted(map(str, postprocess.similar_leaders(frame).collect()))
    want = sorted(x for d in range(7) for x in led(rules.where("doc_id is null" if d == 6 else f"doc_id = {d}")))
    assert "FlatMapGroups" not in postprocess.similar_leaders(rules)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert led(rules) == want and len(want) == 63
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_post_process_makes_its_rules_once(spark, tmp_path):
    import os

    def noted(batches):
        for b in batches:
            open(f"{tmp_path}/{os.urandom(8).hex()}", "w").close()
            yield b

    rules = spark.createDataFrame([(1, i, f"wall {i} of {i % 3}", 0.5, 0.5) for i in range(8)], "doc_id int, rule_index int, rule_text string, confidence double, relevance double").coalesce(1)
    kept, stats = pipelines.post_process(rules.mapInArrow(noted, rules.schema))
    assert kept.count() and stats.first()["n_raw"] == 8 and len(os.listdir(tmp_path)) == 1


def test_enhanced_chunks_are_made_once(spark, tmp_path):
    """Documents are read once, and where none is thinned no chunk is shuffled; a document without identifier keeps its chunks."""
    import os

    def noted(batches):
        for b in batches:
            open(f"{tmp_path}/{os.urandom(8).hex()}", "w").close()
            yield b

    docs = spark.createDataFrame([(None if i == 3 else i, f"The WALL of part {i} must be {i} mm thick. " * 40) for i in range(6)], "doc_id int, text string").coalesce(1)
    found, _ = pipelines.extract(docs.mapInArrow(noted, docs.schema), settings=pipelines.Settings(mode="enhanced", chunk_tokens=60))
    assert len(os.listdir(tmp_path)) == 1 and found.where("doc_id is null").count() == found.where("doc_id = 2").count() > 0
    rows = spark.createDataFrame([(d, i) for d in (1, 2, None) for i in range(4 if d == 1 else 9)], "doc_id int, chunk_index int")
    assert "hashpartitioning" not in chunking.thinned(rows, 20)._jdf.queryExecution().executedPlan().toString()
    kept = sorted((r.doc_id or 0, r.chunk_index) for r in chunking.thinned(rows, 5).collect())
    assert kept == [(0, i) for i in (0, 2, 4, 6, 8)] + [(1, i) for i in range(4)] + [(2, i) for i in (0, 2, 4, 6, 8)]


def test_score_of_chunks_by_terms_of_sentences(spark):
    docs = spark.createDataFrame([(1, "The WALL of a Wall. No such. ΑΣ. A wall, HOLE and rib!")], "doc_id int, text string")
    got = chunking.sentence_chunks(docs, 3, overlap=False, terms=["wall", "hole"]).select("chunk", "score").collect()
    assert [tuple(r) for r in got] == [("The WALL of a Wall.", 1), ("No such. ΑΣ.", 0), ("A wall, HOLE and rib!", 2)]

"""Answers asked once, steps within documents, checks, exports, caches, and edges: against plain Python."""

from __future__ import annotations

import json
import sys
import time
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions import formal, rules as r
from dolomite.operators import chunking, postprocess, prompts, provider, reports, retrieval
from dolomite.plans import pipelines
from dolomite.sources import readers, writers


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the providers below go to Python workers, which cannot import this file


class Counting:
    """Answers as Offline does, and notes each call in a file of the test's folder."""

    def __init__(self, path):
        self.path, self.own = str(path), provider.Offline()

    def complete(self, task, text):
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps([task, text]) + "\n")
        return self.own.complete(task, text)


def calls(path) -> list:
    return [tuple(json.loads(x)) for x in path.read_text(encoding="utf-8").splitlines()]


def test_a_rule_is_asked_for_once(spark, tmp_path):
    texts = ["Minimum Bend.Radius shall be 1.5 mm", "Be kind", "Distance between a hole and an edge must be 4", "Flatness of Wall.Face within 0.1"]
    rows = spark.createDataFrame([(x, "clash", 1) for x in texts], "rule_text string, intent string, rhs int")
    got = pipelines.formalise(rows, Counting(tmp_path / "asked"))
    assert got.count() == len(got.collect()) == 4 and set(rows.columns) <= set(got.columns)
    seen = calls(tmp_path / "asked")
    assert sorted(t for k, t in seen if k == "intent") == sorted(texts) and len(seen) == len(set(seen)) == 7


def test_chunks_are_asked_for_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Walls of part {i} must be {i} mm thick, whatever the process and the material may be.") for i in range(6)], "doc_id int, text string")
    found, summary = pipelines.extract(docs, Counting(tmp_path / "asked"))
    assert found.count() == 6 and summary.where("status = 'success'").count() == 6 and found.count() == 6
    assert len(calls(tmp_path / "asked")) == 6
    with pytest.raises(ValueError):
        pipelines.extract(docs, settings=pipelines.Settings(least_confidence=1.5))
    low = pipelines.Settings(chunks_per_document=10).recalling()
    assert (low.mode, low.least_confidence, low.least_relevance, low.chunks_per_document) == ("raw", 0.1, 0.05, 80)
    raw, _ = pipelines.extract(docs, settings=low)
    assert {(x.extraction_method, x.confidence, x.relevance) for x in raw.collect()} == {("raw_bulk", 0.6, 0.5)} and raw.count() == 6


class Geometry:
    def complete(self, task, text):
        if task == "intent":
            return json.dumps({"is_quantifiable": True, "rule_intent": {"type": "min", "requires_geometry": True}, "geometry_relation": {"from": "hole", "to": "edge"}})
        return "x < 4 * Wall.Thickness"


def test_the_operator_comes_from_the_answer(spark):
    rows = spark.createDataFrame([("Holes near edges",)], "rule_text string")
    for faithful, want in ((False, ("<", "4 * Wall.Thickness")), (True, (">=", "x < 4 * Wall.Thickness"))):
        said = json.loads(pipelines.formalise(rows, Geometry(), faithful).first().rule_json)
        assert (said["operator"], said["rhs"]) == want


def test_clusters_are_those_of_a_document(spark):
    words = "bend hole wall rib boss draft slot pocket fillet groove thread cable".split()
    rows = [(d, i, f"{words[(i + d) % 12]} {words[(i * 5) % 12]} number {i} of {d}", 0.4 + i / 50, 0.9) for d in range(40) for i in range(20 if d % 2 else 4)]
    rules = spark.createDataFrame(rows, "doc_id int, rule_index int, rule_text string, confidence double, relevance double")
    final, stats = pipelines.post_process(rules, cluster=True)
    per = {x.doc_id: x["count"] for x in final.groupBy("doc_id").count().collect()}
    assert set(per) == set(range(40)) and all(per[d] == 4 for d in range(0, 40, 2)) and all(2 <= per[d] <= 5 for d in range(1, 40, 2))
    assert all(x.n_raw >= x.n_unique >= x.n_good >= x.n_clustered >= x.n_final == per[x.doc_id] for x in stats.collect())
    best = postprocess.cluster_best(rules.where("doc_id = 1")).agg(F.max("confidence")).first()[0]
    assert best == max(c for d, _, _, c, _ in rows if d == 1)


def test_leaders_without_stop_words(spark):
    rows = spark.createDataFrame([(1, 0, "the hole of the wall", 0.5), (1, 1, "a hole in a wall", 0.4), (1, 2, "rib", 0.4)], "doc_id int, rule_index int, rule_text string, confidence double")
    lead = lambda **k: {x.rule_index: x.leader for x in postprocess.similar_leaders(rows, **k).collect()}
    assert lead(stop=["the", "of", "in"]) == {0: 0, 1: 0, 2: 2} and lead(stop=()) == {0: 0, 1: 1, 2: 2} and lead() == {0: 0, 1: 0, 2: 2}


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "One two. Three four five. Six.", 1, 2, 3, 4, 5, 6)], "doc_id int, text string, tokens int, at int, sentences int, place int, part int, total int")
    assert chunking.windows(docs, 2, 1).select("tokens", "at").distinct().count() == 1
    chunks = chunking.sentence_chunks(docs, 3)
    assert {x.place for x in chunks.collect()} == {4} and {x.part for x in chunks.collect()} == {5}
    assert chunking.thinned(chunks, 1).select("total").collect()[0].total == 6
    rows = spark.createDataFrame([(1, 2, "a", 1), (1, 1, "a", 2)], "doc_id int, rule_index int, key string, rank int")
    assert [(x.rule_index, x.key, x["rank"]) for x in postprocess.first_of_each(rows, F.col("key"), ["rule_index"]).collect()] == [(1, "a", 2)]
    assert postprocess.capped(rows, 1, [F.col("rule_index")]).first()["rank"] == 2


def test_scored_chunks_are_ranked(spark):
    docs = spark.createDataFrame([(1, "No cue here. The minimum radius must be large. A wall.")], "doc_id int, text string")
    got = chunking.scored_chunks(docs, 4, terms=lexicon.PRIORITY_TERMS).orderBy("rank").collect()
    assert got[0].chunk.startswith("The minimum") and [x["rank"] for x in got] == [1, 2, 3]


def test_zero_vectors_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id int, embedding array<double>")
    assert [(x.id, x.score) for x in retrieval.vector_search(rows, [0.0, 0.0], 5).collect()] == [(1, 0.0), (2, 0.0)]
    assert [(x.id, round(x.score, 6)) for x in retrieval.vector_search(rows, [1.0, 1.0], 5).collect()] == [(2, 1.0), (1, 0.0)]
    assert rows.orderBy("vec_id").select(retrieval.normal(F.col("embedding")).alias("v")).first().v == [0.0, 0.0]
    none = spark.createDataFrame([], "label int, confidence double")
    assert reports.label_scores(none).first().accuracy == 0.0


def test_similarity_search(spark):
    texts = ["bend radius of steel", "draft of a rib", "bend radius of steel", *[f"other words {i}" for i in range(12)]]
    rows = spark.createDataFrame([(i, x, [1.0, i / 10]) for i, x in enumerate(texts)], "id int, text string, embedding array<double>")
    got = retrieval.similarity_search(rows, "bend radius", [0.0, 1.0], 3).collect()
    assert got[0].id == 0 and got[0].score > 0.5 and len({x.text for x in got}) == 3
    plain = retrieval.similarity_search(rows, "bend radius", [0.0, 1.0], 3, hybrid=False, rerank=False).collect()
    assert [x.id for x in plain] == [14, 13, 12]
    assert [x.id for x in retrieval.similarity_search(rows, "  ", [0.0, 1.0], 2, hybrid=False).collect()] == [14, 13]
    few = rows.where("id < 5")
    assert {x.id for x in retrieval.similarity_search(few, "bend radius", [0.0, 1.0], 2).collect()} == {0, 2}


class Slow:
    def complete(self, task, text):
        time.sleep(5)
        return "late"


class Limited:
    def __init__(self):
        self.n = 0

    def complete(self, task, text):
        self.n += 1
        if self.n < 2:
            raise RuntimeError("429 tokens per day (TPD): try again in 1m2s")
        return "fine"


def test_waits_and_limits():
    with pytest.raises(TimeoutError):
        provider.Timed(Slow(), 0.05).complete("x", "y")
    assert provider.Timed(provider.Offline(), 5).complete("classify", "Tubing") == "Tubing"
    assert provider.seconds_to_wait("Please try again in 17m18s.") == 17 * 60 + 23 and provider.seconds_to_wait("later", 1.0) == 1.0
    day = provider.DailyLimit(Limited(), least=300)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            day.complete("x", "y")
    assert day.provider.n == 1 and 290 < day.until - time.time() <= 301
    assert provider.Failover((Limited(),), interval=0.0, most=0.01).complete("x", "y") == "fine"


def test_cached_answers(spark, tmp_path):
    chunks = spark.createDataFrame([("a", i, f"text {i}") for i in range(5)], "document_id string, chunk_index int, chunk string")
    cache = spark.createDataFrame([("a", 1, "known"), ("a", 2, None)], "document_id string, chunk_index int, answer string")
    every, new = provider.cached(chunks, cache, Counting(tmp_path / "asked"), "classify")
    assert {x.chunk_index: x.answer for x in every.collect()} == {0: "General", 1: "known", 2: "General", 3: "General", 4: "General"}
    assert new.count() == 4 and len(calls(tmp_path / "asked")) == 4


class Poor:
    """A rule too short at first; enhanced it is long enough, but for the second chunk never."""

    def complete(self, task, text):
        if "fail" in text and task == "enhance":
            raise RuntimeError("no")
        good = task == "enhance" and "never" not in text
        return json.dumps({"rule_text": "Walls must be 2 mm thick" if good else "fail 1" if "fail" in text else "never 1" if "never" in text else "x 1", "confidence": 0.9})


def test_single_rules(spark):
    chunks = spark.createDataFrame([(1, 0, "Radius 1 must be"), (1, 1, "never 2 minimum"), (1, 2, "words alone"), (1, 3, "fail 3 minimum")], "doc_id int, chunk_index int, chunk string")
    got = {x.chunk_index: x for x in pipelines.single_rules(chunks, Poor(), similar=F.array(F.lit("s" * 200))).collect()}
    assert set(got) == {0, 1, 3}
    assert (got[0].rule_text, got[0].extraction_method, got[0].complexity) == ("Walls must be 2 mm thick", "enhanced_structured", 2 / 4)
    assert got[1].extraction_method == "enhanced_enhanced_structured" and got[3].extraction_method == "structured" and got[3].rule_text == "fail 1"


def test_classes_agree(spark):
    texts = ["sheet metal forming of hems", "Sheet Metal", "a rib", "PMI notes", "bounding box", "nothing", "the thread depth", "UV resin by SLA", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    got = {x.t: x.c for x in rows.select("t", r.rule_class(F.col("t"), F.lit("")).alias("c")).collect()}
    assert got == {x: provider.rule_class(x) for x in texts} and got["sheet metal forming of hems"] == "SMForm"
    assert provider.rule_class("a rib", "Die Casting guide") == "Die Cast"


def test_contract(spark):
    answers = {'{"formalism": "equation", "equation": "A.B > 1", "reasoning": "r"}': ("equation", "A.B > 1", "r"), '{"formalism": "equation"}': (None, None, "Formalization output invalid: Equation formalism without equation"), '{"formalism": "poem"}': (None, None, "Formalization output invalid: Invalid formalism type"), "no": (None, None, "Formalization output invalid: no JSON"), '{"formalism": "AST", "ast": {}}': (None, None, "Formalization output invalid: AST formalism without AST"), '{"formalism": null, "reasoning": "gap"}': (None, None, "gap")}
    rows = spark.createDataFrame([(x,) for x in answers], "a string").select("a", formal.contracted(F.col("a")).alias("c"))
    assert {x.a: (x.c.formalism, x.c.equation, x.c.reasoning) for x in rows.collect()} == answers


def test_deep_compounds(spark):
    deep = '{"all_of":[' * 12 + '{"any_of":[]}' + "]}" * 12
    rows = spark.createDataFrame([(deep,), ('{"all_of":[' * 12 + '{"x":1}' + "]}" * 12,)], "c string")
    assert [x.b for x in rows.select(r.unresolved(F.col("c")).alias("b")).collect()] == [True, False]


def test_printed_compounds(spark):
    row = spark.sql("select array(named_struct('parameter', 'wall', 'target', null, 'subject', null, 'operator', '>=', 'constraint_type', null, 'op', null, 'expression', null, 'value', '2', 'units', 'mm', 'unit', null)) as c, array(named_struct('function', 'max', 'operands', array('a', ' ', 'b')), named_struct('function', '', 'operands', array('z'))) as f")
    assert row.select(r.printed_constraints(F.col("c"), F.col("f")).alias("p")).first().p == "wall >= 2 mm; max(a, b)"
    strict = reports.strict_rows(row.select(F.lit(" R ").alias("rule_text"), F.col("c").alias("constraint_list"), F.col("f").alias("compound"), F.lit(2.0).alias("confidence"))).first()
    assert tuple(strict) == ("R", "general", "general", "wall >= 2 mm; max(a, b)", "", "ADVISORY", 1.0)


def test_files_of_results(spark, tmp_path):
    docs = spark.createDataFrame([("d", "d.pdf", 1.5, 2), ("e", "e.pdf", 0.5, 1)], "doc_id string, name string, processing_time double, chunks_processed int")
    rules = spark.createDataFrame([("d", 0, " A ", "g", "t", 0.55555, "low", "")], "doc_id string, rule_index int, rule_text string, category string, rule_type string, confidence double, priority string, rationale string")
    assert tuple(reports.rule_objects(rules).first())[1:] == (0, "A", "g", "t", 0.5556, "low", "") or reports.rule_objects(rules).first().confidence_score == 0.5556
    over = reports.rule_objects(rules.withColumn("m", F.create_map(F.lit("priority"), F.lit("high"))), "m").first()
    assert over.priority == "high" and over.rule_text == "A"
    results = reports.document_results(docs, rules)
    writers.write_export(results, docs.agg(F.count("*").alias("documents")), str(tmp_path / "out"))
    back, summary = writers.read_export(spark, str(tmp_path / "out"))
    assert back.where("source_pdf = 'd.pdf'").first().rule_count == 1 and summary.first().documents == 2
    for bad in (lambda: writers.write_export(results.limit(0), docs, str(tmp_path / "none")), lambda: writers.write_export(results, docs, str(tmp_path / "csv"), "csv")):
        with pytest.raises(ValueError):
            bad()
    writers.write_formal(spark.createDataFrame([("r", None)], "rule_text string, status string"), str(tmp_path / "formal"))
    got = readers.read_csv(spark, str(tmp_path / "formal"))
    assert got.columns == list(writers.FORMAL) and got.first().status == "Unknown"
    writers.write_normalised(spark.createDataFrame([("r", None, "late")], "rule_text string, answer string, error string"), str(tmp_path / "norm"))
    assert readers.read_csv(spark, str(tmp_path / "norm")).first().dfm_format == "ERROR: late"
    assert reports.compiled(rules.withColumn("source", F.lit("s"))).first().source_document == "s"
    assert json.loads(writers.payload({"a": pipelines.RECALL}))["a"]["chunks_per_document"] == 120


def test_stores(spark, tmp_path):
    store = str(tmp_path / "store")
    assert retrieval.create_store(spark, store).count() == 0
    chunks = spark.createDataFrame([("d", 0, "one two"), ("d", 1, " ")], "doc_id string, chunk_index int, chunk string")
    rows = retrieval.store_chunks(store, chunks, provider.HashedEmbedder(4))
    assert [(x.text, x.doc_id, len(x.embedding)) for x in rows.collect()] == [("one two", "d", 4)]
    assert retrieval.create_store(spark, store).count() == 1


def sheet(rows) -> str:
    cell = lambda i, j, v: f'<c r="{chr(65 + j)}{i + 1}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    return '<worksheet xmlns="m"><sheetData>' + "".join(f"<row>{''.join(cell(i, j, v) for j, v in enumerate(r) if v is not None)}</row>" for i, r in enumerate(rows)) + "</sheetData></worksheet>"


def test_workbooks_and_cached_files(spark, tmp_path):
    book = tmp_path / "in" / "b.xlsx"
    book.parent.mkdir()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="rel"><sheets><sheet name="One" sheetId="1" r:id="x1"/><sheet name="Two" sheetId="2" r:id="x2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([[0, 1], ["a", None, "c"], *[["x"]] * 200]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([]))
    (tmp_path / "in" / "t.txt").write_text("Steel is hard. Yes.")
    got = {x.suffix: x for x in readers.load_documents(spark, str(tmp_path / "in"), metadata=True).collect()}
    lines = got["xlsx"].text.split("\n")
    assert lines[:3] == ["--- Sheet One ---", "name | value", "a |  | c"] and len(lines) == 102 and got["xlsx"].error is None
    assert got["txt"].word_count == 4 and got["txt"].keywords == ["steel"]
    store = str(tmp_path / "cache")
    first = readers.load_cached(spark, str(tmp_path / "in"), store)
    assert first.count() == 2
    (tmp_path / "in" / "u.txt").write_text("new")
    assert readers.load_cached(spark, str(tmp_path / "in"), store).count() == 3 and spark.read.parquet(store).count() == 3


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rule_count": 2, "rules": [{"rule_text": "x"}]}')
    (tmp_path / "b.json").write_text('{"rules": []}')
    assert sorted((x.rule_count, len(x.rules)) for x in readers.rule_files(spark, str(tmp_path)).collect()) == [(0, 0), (2, 1)]


def test_prompts():
    said = prompts.Prompted(lambda p: p, (("schema", "Bend"), ("similar", " "))).complete("attribute", "the rule")
    assert said.endswith("schema: Bend\n\nthe rule") and "similar" not in said
    assert all(prompts.assembled(t, "text").endswith("text") for t in prompts.REQUESTS)


def test_rule_class_lowers_each_text_once(spark):
    rows = spark.createDataFrame([("A RIB of sheet metal", "DIE casting guide"), ("A RIB", None), (None, "x"), (None, None)], "t string, title string")
    out = rows.select(r.rule_class(F.col("t"), F.col("title")).alias("c"))
    assert [x.c for x in out.collect()] == [provider.rule_class(a or "", b or "") for a, b in rows.collect()]
    assert out._jdf.queryExecution().analyzed().toString().count("lower(") == 2

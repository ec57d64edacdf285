"""Rules from answers of models as they come: odd entries and fields, prose around, names twice."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from dolomite.functions import rules as rule_columns
from dolomite.operators.provider import parsed_rules, raw_rules

C = {"rule_text": "C", "confidence": 0.9}


def texts(spark, *answers, **options):
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    out: dict[int, list] = {i: [] for i in range(len(answers))}
    for r in sorted(parsed_rules(rows, **options).collect(), key=lambda r: (r.i, r.rule_index)):
        out[r.i].append(r.rule_text)
    return [*out.values()]


def test_an_odd_entry_loses_itself_alone(spark):
    got = texts(spark, json.dumps(["just text", C]), json.dumps([{"rule_text": "E"}, None, 5]), json.dumps({"rules": [{"rule_text": "J"}, ["x"]]}), json.dumps([C, {"rule_text": " "}, {"canonical_statement": "S"}, True, 1.5, [C]]))
    assert got == [["C"], ["E"], ["J"], ["C", "S"]]


def test_shapes_of_answers(spark):
    fenced, prose = f"```json\n{json.dumps([C])}\n```", f"Here it is: {json.dumps({'rules': [C]})} - done"
    assert texts(spark, fenced, prose, json.dumps(C), "[]", "no JSON", None, "", '{"rules": []}', '{"rules": "none"}', "[1, 2", '{"a": 1}') == [["C"], ["C"], ["C"], [], [], [], [], [], [], [], []]


def test_a_name_twice_in_one_object(spark):
    assert texts(spark, '[{"rule_text": "a", "rule_text": "b"}, {"rule_text": "kept"}]', '{"rules": [{"rule_text": "kept"}, {"x": 1, "x": 2}, 7]}') == [["kept"], ["kept"]]


def test_an_odd_field_loses_itself_alone(spark):
    rule = {"rule_text": 12, "rule_category": ["x"], "scope_domain": "milling", "confidence": "high", "supporting_quotes": [1, "q", {"a": 1}], "primary_constraints": [{"parameter": "t", "value": 2.5, "operator": ">="}, "text", None], "harvested_constraints": {"a": 1}, "constraints": [{"a": 1}], "priority": None}
    rows = spark.createDataFrame([(json.dumps({"rules": [rule, C]}),)], "answer string")
    first, second = sorted(parsed_rules(rows).collect(), key=lambda r: r.rule_index)
    assert (first.rule_text, first.category, first.confidence, first.priority, first.scope.process, second.rule_text) == ("12", '["x"]', 0.6, "medium", None, "C")
    assert [(c.subject, c.value, c.source) for c in first.constraints] == [("t", "2.5", "primary")] and first.constraints_text == '[{"a":1}]'
    assert first.supporting_quotes[:2] == ["1", "q"]


def test_scope_by_its_other_names(spark):
    rows = spark.createDataFrame([(json.dumps([{"rule_text": "a", "scope_domain": {}, "scope": {"process": "turning", "item": 3}}, {"rule_text": "b", "domain": {"feature": "hole"}}, {"rule_text": "c", "domain": "text"}]),)], "answer string")
    assert [tuple(r.scope) for r in sorted(parsed_rules(rows).collect(), key=lambda r: r.rule_index)] == [("turning", "3", None), (None, None, "hole"), (None, None, None)]


def test_at_most_so_many_valid_ones(spark):
    assert texts(spark, json.dumps([None, *({"rule_text": str(i)} for i in range(9))]), most=4) == [["0", "1", "2", "3"]]


def test_random_lists_keep_every_object(spark):
    rng, answers, want = random.Random(3), [], []
    for _ in range(200):
        items = [rng.choice([None, 3, "x", [], {}, {"rule_text": "é\n\"q\""}, {"rule_text": ""}, {"rule_text": "t", "constraints": rng.choice([None, 1, [], {"a": [1]}])}]) for _ in range(rng.randint(0, 7))]
        answers.append(json.dumps(rng.choice([items, {"rules": items}])))
        want.append([x["rule_text"] for x in items if isinstance(x, dict) and x.get("rule_text")])
    assert texts(spark, *answers) == want


def test_clashing_names_and_raw_lists(spark):
    rows = spark.createDataFrame([(json.dumps({"rules": ["x", {"text": "Wall shall be 2 mm", "confidence_score": "bad"}, {"text": "b.", "confidence_score": 0.9}]}), 1, 2)], "answer string, parsed_rule int, listed int")
    got = sorted(raw_rules(rows).collect(), key=lambda r: r.rule_index)
    assert [(r.rule_text, r.confidence, r.listed) for r in got] == [("Wall shall be 2 mm.", 0.6, 2), ("b.", 0.9, 2)]
    assert parsed_rules(rows.withColumn("answer", F.lit(json.dumps([C])))).select("parsed_rule", "rule_text").first() == (1, "C")
    level = spark.createDataFrame([("[]", "ENFORCEABLE", 5)], "constraints string, severity string, level int")
    assert rule_columns.validated(level).first().level == 5

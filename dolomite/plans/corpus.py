"""Inputs that the queries over rules and equations derive from documents and parts, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a document's sentence gets before it, behind it, as its severity and as its constraint, each by a remainder of its own.
BEFORE = ["", "--- Page 3 --- Note: ", "3. ", "", "• ", "1 / 10 Page 4 of 9 ", "tip: ", "Minimum radius 1,5 mm: "]
BEHIND = [".", "", " Please recycle.", "!", " 5-8 mm deep", ""]
SEVERITY = ["ENFORCEABLE", "enforceable", None, "ADVISORY", "unknown", " ", "ENFORCEABLE"]
CONSTRAINTS = ["radius >= {n}*t", '[{"subject":"hole","operator":">=","value":"{n}"}]', None, '{"all_of":[]}', "draft >= {n}", "", "[]", '{"any_of":[{"all_of":[]}]}', '{"conditions":[{"subject":"x{n}"}]}', "yes", '{"allOf":[{"a":{n}}]}']

EQUATIONS = (
    "rid int, domain string, equation string",
    [
        (1, "Sheetmetal", "Bend.Radius >= {n}.5 * ModuleParams.Thickness"),
        (2, "Sheet Metal", "Hole.Depth <= ModuleParams.Thickness * {n} + 0.5"),
        (3, "Mill", "Pocket.MinRadius == 0.{n}"),
        (4, "Turn", "Groove.Depth > {n} * ModuleParams.Thickness - 1.25"),
        (5, "Drill", "Hole.Diameter between {n} and 55"),
        (6, "nowhere", "{w}.Width in [1, {n}]"),
        (7, "Additive", "AMFace.MinGap < max(0.4, {n} * ModuleParams.NominalThickness)"),
        (8, "Tubing", "Tube.{w} != {n}"),
        (9, "General", "no operator in {w}"),
        (10, "General", "Tolerance(Bend.Angle, {n}, 0.5, 0.5)"),
        (11, "Assembly", "Distance(Hole, {w}) >= {n}"),
        (12, "Die Cast", "Rib.Height <= {n} * WallThickness.MinValue / 3"),
    ],
)
EXPRESSIONS = (
    "rid int, expression string",
    [
        (1, '"Tolerance({w}.Angle, {n}, 0.5, 0.5)"'),
        (2, "```python Limits(Hole.Diameter, {n}.9, 60.1)```"),
        (3, "Max(Surface.Roughness, {n})"),
        (4, "GDT(Flatness, {w}, 0.05)"),
        (5, "GDT({w}, Surface, 0.05)"),
        (6, "GDT()"),
        (7, ""),
        (8, "{w}.Roughness <= {n}"),
    ],
)
NAMES = (
    "rid int, raw string",
    [(1, "Hole"), (2, "{n} adjacent holes"), (3, "countersunk hole near an edge"), (4, "edge of a {w}"), (5, "bend line"), (6, "{w} wheel"), (7, None), (8, " Curls ")],
)
CHECKS = (
    "rid int, domain string, side_a string, side_b string, tolerance string, scoped boolean",
    [
        (1, "Sheetmetal", "Bend.Radius", "Hem", "", False),
        (2, "Sheetmetal", "Counterbore.Depth", "", "Bend", False),
        (3, "Sheetmetal", "{w}", "", "", False),
        (4, "Turn", "Groove", "Bend", "Slot", False),
        (5, "Turn", "", "", "Slot", False),
        (6, "{w}", "Bend", "", "", False),
        (7, "General", "Sheetmetal.Bend", "Turn.Groove", "", True),
        (8, "General", "Sheetmetal.Bend", "Turn.Bend", "", True),
        (9, "Turn", "Bend", "Turn.Groove", "", True),
        (10, "Turn", "{w}.Bend", "Turn.Groove", "", True),
        (11, "Turn", "", "", "", True),
    ],
)
PASCAL = ("rid int, equation string", [(1, "slot.{w} >= {n} * moduleparams.thickness"), (2, "0.{n} * Bend.radius"), (3, "no names"), (4, "a.b.{w} + x_{n}.y2")])
TREES = {
    1: '{"op": ">=", "left": "Part.Size", "right": 25}',
    2: '{"op": "<", "left": "0.5 * Part.Price", "right": {"op": "max", "operands": ["Part.Size * 10 + 200.5", 460]}}',
    3: '{"op": "and", "operands": [{"op": "!=", "left": "Part.Size", "right": 7}, {"op": "<=", "left": "min(Part.Size, 30) - 1", "right": "Part.Price / 40"}]}',
    4: '{"op": "or", "operands": [{"op": "==", "left": "Part.Size", "right": 3}, {"op": ">", "left": "(Part.Price - 900) * 2", "right": 150.25}]}',
}


#: Columns of rules made of the sentences of documents, and of the templates filled in for each part.
RULES = "rid long, doc string, text string, confidence double, relevance double, severity string, constraints string"


def rules(sentences: DataFrame) -> DataFrame:
    """RULES of sentences (doc_id, rule_index, rule_text, confidence): each with one of the prefixes, endings, severities and constraints."""
    pick = lambda of, at: F.element_at(F.array(*[F.lit(x).cast("string") for x in of]), (at % len(of) + 1).cast("int"))
    doc, place = F.col("doc_id"), F.col("rule_index")
    return sentences.select(
        (doc * 100_000 + place).cast("long").alias("rid"),
        F.substring(F.lit("abcde"), (doc % 5 + 1).cast("int"), F.lit(1)).alias("doc"),
        F.concat(pick(BEFORE, doc + place), "rule_text", pick(BEHIND, doc + 2 * place)).alias("text"),
        "confidence",
        ((doc * 7 + place * 3) % 20 / 20.0).alias("relevance"),
        pick(SEVERITY, doc + place).alias("severity"),
        F.replace(pick(CONSTRAINTS, doc * 3 + place), F.lit("{n}"), F.length("rule_text").cast("string")).alias("constraints"),
    )


def rules_sql(sentences: str) -> str:
    """The same over CTEs that end in a table named rules."""
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    pick = lambda of, at: f"([{', '.join(map(cell, of))}])[({at}) % {len(of)} + 1]"
    return f"""(WITH {sentences} SELECT CAST(doc_id * 100000 + rule_index AS BIGINT) AS rid, substr('abcde', CAST(doc_id % 5 + 1 AS INT), 1) AS doc, {pick(BEFORE, "doc_id + rule_index")} || rule_text || {pick(BEHIND, "doc_id + 2 * rule_index")} AS text,
        confidence, CAST((doc_id * 7 + rule_index * 3) % 20 AS DOUBLE) / 20 AS relevance, {pick(SEVERITY, "doc_id + rule_index")} AS severity, replace({pick(CONSTRAINTS, "doc_id * 3 + rule_index")}, '{{n}}', CAST(length(rule_text) AS VARCHAR)) AS constraints FROM rules)"""


def frame(parts: DataFrame, corpus: tuple[str, list[tuple]]) -> DataFrame:
    """A row per part: the template whose number its key gives, {n} its size and {w} its name's first word with a capital; rid: its key."""
    templates = parts.sparkSession.createDataFrame(corpus[1], corpus[0]).withColumnRenamed("rid", "template")  # a dozen rows
    word = F.initcap(F.substring_index("p_name", " ", 1))
    own = parts.select(F.col("p_partkey").cast("long").alias("rid"), F.col("p_size").cast("string").alias("n"), word.alias("w"), (F.col("p_partkey") % len(corpus[1]) + 1).cast("int").alias("template"))
    filled = lambda c: F.replace(F.replace(F.col(c), F.lit("{n}"), F.col("n")), F.lit("{w}"), F.col("w")).alias(c)
    rows = own.join(F.broadcast(templates), "template")
    return rows.select("rid", "template", *[filled(c) if kind == "string" else F.col(c) for c, kind in (f.split() for f in corpus[0].split(", ")[1:])])


def values(corpus: tuple[str, list[tuple]]) -> str:
    """A subquery of the same rows."""
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    kinds = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    fields = [f.split() for f in corpus[0].split(", ")][1:]
    filled = lambda n, k: f"replace(replace(CAST({n} AS VARCHAR), '{{n}}', CAST(p_size AS VARCHAR)), '{{w}}', upper(left(p_name, 1)) || lower(substr(split_part(p_name, ' ', 1), 2))) AS {n}" if k == "string" else f"CAST({n} AS {kinds[k]}) AS {n}"
    rows = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in corpus[1])
    return f"(SELECT CAST(p_partkey AS BIGINT) AS rid, template, {', '.join(filled(*f) for f in fields)} FROM part JOIN (VALUES {rows}) v(template, {', '.join(n for n, _ in fields)}) ON template = p_partkey % {len(corpus[1])} + 1)"

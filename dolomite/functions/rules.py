"""Column expressions over extracted rules: normalising, tagging, validating, keys and printing."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions.text import has_any, norm_key, numbers, strip, unused

#: A rule as a model may answer it, by the kind of its fields; unknown fields are ignored.
CONSTRAINT_FIELDS = ("parameter", "subject", "target", "operator", "op", "constraint_type", "value", "unit", "units", "expression", "logic", "constraint_source")
TEXT_FIELDS = (
    "rule_text", "canonical_statement", "rule_category", "rule_type", "priority", "confidence", "confidence_score", "confidenceScore", "intent", "rule_intent", "ruleIntent",
    "applicability", "constraints", "requirements", "severity", "rule_severity", "rationale", "primary_feature", "unit", "supporting_quote",
)
LIST_FIELDS = ("primary_constraints", "harvested_constraints")
SCOPE_FIELDS = ("process", "item", "feature")
BLANK_JSON = ("", "{}", "[]", "0", "0.0", "false")


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def field(value: Column, name: str, kind: str = "string") -> Column:
    """A field of a VARIANT, null where there is none or it is of another kind; as a string, what is no text is JSON."""
    return F.try_variant_get(value, f"$.{name}", kind)


def entries(answer: Column) -> Column:
    """The objects among the entries of a JSON answer: a list, an object with a list of rules, or one object, in order (array of VARIANT).

    Other entries are passed over, each alone. An answer with a name twice in one object, which no VARIANT can hold, is read entry by entry.
    """
    whole = F.try_parse_json(answer)
    inner = F.get_json_object(answer, "$.rules")
    texts = F.from_json(F.when(answer.startswith("["), answer).otherwise(F.when(inner.startswith("["), inner)), "array<string>")
    apart = F.transform(F.filter(texts, lambda t: t.startswith("{")), F.try_parse_json)
    own = F.when(is_object(whole) & F.coalesce(field(whole, "rules").isNull(), F.lit(True)), F.array(whole))
    found = F.coalesce(field(whole, "rules", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"), own, apart)
    return F.filter(found, is_object)


def rule_of(value: Column) -> Column:
    """A VARIANT object as a struct of the known fields, each on its own: one of an unexpected kind loses no other."""
    objects = lambda name: F.filter(field(value, name, "array<variant>"), is_object)
    one = lambda c: F.struct(*[field(c, k).alias(k) for k in CONSTRAINT_FIELDS])
    named = F.coalesce(*[F.when(~F.coalesce(strip(field(value, k)), F.lit("")).isin(*BLANK_JSON), field(value, k, "variant")) for k in ("scope_domain", "scope", "domain")])
    scope = F.struct(*[field(named, k).alias(k) for k in SCOPE_FIELDS])
    return F.struct(
        *[field(value, k).alias(k) for k in TEXT_FIELDS],
        scope.alias("scope_domain"),
        *[F.transform(objects(k), one).alias(k) for k in LIST_FIELDS],
        field(value, "supporting_quotes", "array<string>").alias("supporting_quotes"),
    )


def truthy(text: Column) -> Column:
    """The text, null if blank: falls through a chain of alternatives."""
    return F.nullif(strip(text), F.lit(""))


def looked_up(key: Column, table: Mapping[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key], F.lit(default))


def rule_type(value: Column) -> Column:
    v = F.lower(strip(value))
    return looked_up(v, {t: t for t in lexicon.RULE_TYPES} | lexicon.RULE_TYPE_ALIASES, "general")


def rule_category(value: Column) -> Column:
    v = F.lower(strip(value))
    out = F.when(v.isNull(), "General")
    for c in lexicon.CATEGORIES:
        out = out.when(F.replace(v, F.lit(" "), F.lit("_")) == c.lower().replace(" ", "_"), c)
    for part, c in lexicon.CATEGORY_PARTS.items():
        out = out.when(F.contains(v, F.lit(part)), c)
    return out.otherwise("General")


def confidence(*values: Column) -> Column:
    """The first that is neither blank nor zero, as a number from 0 to 1; 0.6 if none is or it is no number."""
    real = lambda v: F.when(strip(v).rlike(r"^[+-]?0*\.?0*$"), None).otherwise(truthy(v))
    first = F.coalesce(*[real(v) for v in values])
    number = F.when(first.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), first.try_cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.6))))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("very_low")


def correctness_tag(score: Column, relevance: Column, text: Column, faithful: bool = False) -> Column:
    """faithful: what the order of its checks makes of it, needs_review always."""
    if faithful:
        return F.lit("needs_review")
    return F.when(relevance < 0.2, "out_of_scope").when(score < 0.4, "low_confidence").when((F.length(strip(text)) < 20) | ~text.rlike("[0-9]"), "incomplete").when(score < 0.7, "needs_review").otherwise("correct")


def parsed_value(value: Column) -> Column:
    """(nums, raw): numbers of the text, or the text itself where it has none."""
    found = numbers(value)
    return F.struct(F.when(F.size(found) > 0, found).alias("nums"), F.when((F.size(found) <= 0) & (value != ""), value).alias("raw"))


def parsed_time(value: Column) -> Column:
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(strip(value), F.lit(f)) for f in formats], F.current_timestamp())


def class_label(score: Column) -> Column:
    return (score > 0.7).cast("int")


def colour(score: Column) -> Column:
    return F.when(score > 0.8, "green").when(score > 0.6, "orange").otherwise("red")


def priority_of(text: Column) -> Column:
    t = norm_key(text)
    return F.when(has_any(t, lexicon.HIGH_PRIORITY), "high").when(has_any(t, lexicon.MEDIUM_PRIORITY), "medium").otherwise("low")


def risk_of(text: Column) -> Column:
    t = norm_key(text)
    return F.when(has_any(t, lexicon.HIGH_RISK), "high").when(t.rlike("[0-9]") | has_any(t, lexicon.MEDIUM_RISK), "medium").otherwise("low")


def rule_class(text: Column, title: Column | None = None) -> Column:
    """One of twelve classes: by the title (null or left out: not known), then by the first process, feature or generic word.

    Text and title are lower-cased once, and handed to the branches by a lambda: as columns each branch would do it again.
    """

    def first(low: Column) -> Column:
        out, tables = F, [(lexicon.CLASS_TITLES, "title"), (lexicon.CLASS_PROCESSES, "text"), (lexicon.CLASS_FEATURES, "text"), (lexicon.CLASS_GENERIC, "text")]
        for table, of in tables:
            for name, words in table.items() if of == "text" or title is not None else ():
                found = [F.contains(low[of], F.lit(w)) for w in words]
                out = out.when(reduce(Column.__or__, found), name)
        return out.otherwise("General")

    title_ = F.lit(None).cast("string") if title is None else F.lower(title)
    return F.get(F.transform(F.array(F.struct(F.lower(text).alias("text"), title_.alias("title"))), first), F.lit(0))


def unresolved(payload: Column, depth: int = 32) -> Column:
    """Whether a constraint (JSON text) holds a compound without parts; one nested deeper than `depth` levels counts as unresolved.

    Of the five names a compound can have, the first that is there decides. A fold over the levels.
    """
    names = ("all_of", "any_of", "conditions", "allOf", "anyOf")
    none = F.array().cast("array<string>")

    def nested(item: Column) -> Column:
        """The compound's parts as JSON text, empty text if it has none, null if the item is no compound."""
        keys, out = F.json_object_keys(item), None
        for k in names:
            out = (F if out is None else out).when(F.array_contains(keys, k), F.coalesce(F.get_json_object(item, f"$.{k}"), F.lit("")))
        return out

    parts = lambda item: F.coalesce(F.from_json(F.when(item.startswith("["), item).otherwise(nested(item)), "array<string>"), none)
    bad = lambda item: ~item.startswith("[") & nested(item).isin("", "[]", "{}", "0", "false")
    step = lambda a, _: F.struct((a["bad"] | F.coalesce(F.exists(a["items"], bad), F.lit(False))).alias("bad"), F.flatten(F.transform(a["items"], parts)).alias("items"))
    start = F.struct(F.lit(False).alias("bad"), F.array(strip(payload)).alias("items"))
    deeper = lambda a: F.exists(a["items"], lambda i: F.coalesce(F.size(parts(i)), F.lit(0)) > 0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step, lambda a: a["bad"] | F.coalesce(deeper(a), F.lit(False)))


def validated(rules: DataFrame, constraints: str = "constraints", severity: str = "severity") -> DataFrame:
    """rules with severity, validation_state, has_constraints and unresolved. constraints: text or JSON, null for none."""
    c = F.coalesce(strip(F.col(constraints)), F.lit(""))
    is_json = c.rlike(r"(?s)^[\[{]")
    has = F.when(is_json, ~c.isin("[]")).otherwise(c != "")
    level = F.upper(F.coalesce(truthy(F.col(severity)), F.lit("ADVISORY")))
    (own,) = unused(rules, "level")
    rows = rules.withColumns({"has_constraints": has, "unresolved": is_json & unresolved(c), own: level})
    state = F.when(F.col(own) != "ENFORCEABLE", "ADVISORY_ONLY").when(F.col("has_constraints") & ~F.col("unresolved"), "ENFORCEABLE").otherwise("INCOMPLETE")
    return rows.withColumns({"validation_state": state, severity: F.when(F.col(own) == "ENFORCEABLE", "ENFORCEABLE").otherwise("ADVISORY")}).drop(own)


def merged_constraints(primary: Column, harvested: Column) -> Column:
    """Primary ones first, each with its source where it names none, and with subject, unit and logic from their other names."""

    def tidy(source: str):
        def one(c: Column) -> Column:
            return F.struct(F.coalesce(c["subject"], c["parameter"]).alias("subject"), c["operator"].alias("operator"), c["value"].alias("value"), F.coalesce(c["unit"], c["units"]).alias("unit"), F.coalesce(c["logic"], c["expression"]).alias("logic"), F.coalesce(c["constraint_source"], F.lit(source)).alias("source"))

        return one

    none = F.array().cast("array<struct<subject:string,operator:string,value:string,unit:string,logic:string,source:string>>")
    return F.concat(F.coalesce(F.transform(primary, tidy("primary")), none), F.coalesce(F.transform(harvested, tidy("harvested")), none))


def normalised(rule: Column) -> dict[str, Column]:
    """Columns of a rule as rule_of gives it; rule_text is null for rules to be dropped."""
    text = F.coalesce(truthy(rule["rule_text"]), truthy(rule["canonical_statement"]))
    merged = merged_constraints(rule["primary_constraints"], rule["harvested_constraints"])
    plain = F.coalesce(truthy(rule["constraints"]), truthy(rule["requirements"]))
    has = (F.size(merged) > 0) | (plain.isNotNull() & ~F.coalesce(plain, F.lit("")).isin("[]", "{}"))
    said = F.upper(F.coalesce(truthy(rule["severity"]), truthy(rule["rule_severity"])))
    quote, quotes = truthy(rule["supporting_quote"]), F.filter(F.transform(F.coalesce(rule["supporting_quotes"], F.array().cast("array<string>")), strip), lambda q: q != "")
    return {
        "rule_text": text,
        "canonical_statement": F.coalesce(truthy(rule["canonical_statement"]), text),
        "category": F.coalesce(truthy(rule["rule_category"]), F.lit("General")),
        "rule_type": F.coalesce(truthy(rule["rule_type"]), F.lit("general")),
        "priority": F.when(F.lower(rule["priority"]).isin("low", "medium", "high"), F.lower(rule["priority"])).otherwise("medium"),
        "confidence": confidence(rule["confidence"], rule["confidence_score"], rule["confidenceScore"]),
        "intent": F.coalesce(truthy(rule["intent"]), truthy(rule["rule_intent"]), truthy(rule["ruleIntent"]), F.lit("")),
        "scope": F.struct(*[rule["scope_domain"][k].alias(k) for k in ("process", "item", "feature")]),
        "applicability": truthy(rule["applicability"]),
        "constraints": merged,
        "constraints_text": plain,
        "has_constraints": has,
        "suggested_severity": F.when(has, "ENFORCEABLE").otherwise("ADVISORY"),
        "severity": F.when(said.isin("ENFORCEABLE", "ADVISORY"), said).when(has, "ENFORCEABLE").otherwise("ADVISORY"),
        "supporting_quotes": F.when(quote.isNull() | F.array_contains(quotes, quote), quotes).otherwise(F.array_prepend(quotes, quote)),
        "rationale": F.coalesce(truthy(rule["rationale"]), F.lit("")),
    }


def dedupe_key(intent: Column, scope: Column, applicability: Column, constraints: Column, text: Column, category: Column, kind: Column, faithful: bool = False) -> Column:
    """Intent, scope, applicability and constraints; rule text, category and type where all of these are blank.

    faithful: a scope of three empty parts counts as something, so the second form is never reached.
    """
    scoped = F.array_join(F.array(*[norm_key(scope[k]) for k in ("process", "item", "feature")]), "|")
    each = lambda c: F.array_join(F.array(*[norm_key(c[k]) for k in ("subject", "operator", "value", "unit", "logic")]), ":")
    of = F.array_join(F.transform(constraints, each), ";")
    main = F.concat_ws("|", norm_key(intent), scoped, norm_key(applicability), of)
    blank = (norm_key(intent) == "") & (norm_key(applicability) == "") & (of == "") & (scoped == "||")
    return main if faithful else F.when(blank, F.concat_ws("|", norm_key(text), norm_key(category), norm_key(kind))).otherwise(main)


def printed_constraints(constraints: Column, compound: Column | None = None) -> Column:
    """parameter operator value unit of each, then fn(a, b) of each compound (function, operands), joined by semicolons."""

    def one(c: Column) -> Column:
        param = F.coalesce(truthy(c["parameter"]), truthy(c["target"]), truthy(c["subject"]))
        op = F.coalesce(truthy(c["operator"]), truthy(c["constraint_type"]), truthy(c["op"]))
        rhs, unit = F.coalesce(truthy(c["expression"]), truthy(c["value"])), F.coalesce(truthy(c["units"]), truthy(c["unit"]))
        piece = F.when(param.isNotNull() & op.isNotNull() & rhs.isNotNull(), F.concat_ws(" ", param, op, rhs)).when(param.isNotNull() & rhs.isNotNull(), F.concat(param, F.lit(": "), rhs)).otherwise(rhs)
        return F.when(piece.isNotNull(), F.concat_ws(" ", piece, unit))

    def call(c: Column) -> Column:
        known = F.filter(c["operands"], lambda o: truthy(o).isNotNull())
        return F.when(truthy(c["function"]).isNotNull() & (F.size(known) > 0), F.concat(strip(c["function"]), F.lit("("), F.array_join(known, ", "), F.lit(")")))

    none = F.array().cast("array<string>")
    of = lambda items, f: none if items is None else F.coalesce(F.transform(items, f), none)
    return F.array_join(F.filter(F.concat(of(constraints, one), of(compound, call)), lambda x: x.isNotNull()), "; ")


def printed_applicability(app: Column) -> Column:
    """key=value of what is known of process, material, feature, location and geometry. app: a map of texts."""
    known = lambda k: F.when(truthy(app[k]).isNotNull() & ~F.lower(strip(app[k])).isin("unknown", "null"), F.concat(F.lit(f"{k}="), strip(app[k])))
    return F.concat_ws("; ", *[known(k) for k in ("process", "material", "feature", "location", "geometry")])


def picked_domain(filename: Column, technical: Column, sector: Column, feature: Column) -> Column:
    name = F.lower(F.coalesce(filename, F.lit("")))
    base = F.coalesce(truthy(technical), F.when(F.contains(name, F.lit("sheet")) & F.contains(name, F.lit("metal")), "sheet metal"), truthy(sector), F.lit("general"))
    return F.concat_ws(" / ", base, truthy(feature))

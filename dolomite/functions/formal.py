"""Column expressions that turn rule sentences and equations into a canonical form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions.rules import looked_up, truthy
from dolomite.functions.text import json_part, strip, words, unused

DISTANCE = "Distance.MinValue"


def any_of(text: Column, terms: list[str]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(t) for t in terms))


def domain_of(text: Column) -> Column:
    """The first domain one of whose keywords is a substring (so "them" has "hem")."""
    out = None
    for domain, terms in lexicon.DOMAIN_KEYWORDS.items():
        out = (F if out is None else out).when(any_of(text, terms), domain)
    return out.otherwise("General")


def category_of(kind: Column, geometry: Column, tolerance: Column) -> Column:
    kind, geometry, tolerance = F.coalesce(kind, F.lit("advisory")), F.coalesce(geometry, F.lit(False)), F.coalesce(tolerance, F.lit(False))
    return F.when((kind == "advisory") & ~(geometry | tolerance), "Advisory").when(tolerance, "Tolerance").when(geometry, "Geometry").otherwise("Attribute")


def needs_branches(text: Column) -> Column:
    return any_of(text, lexicon.BRANCH_PHRASES)


def entity(raw: Column) -> Column:
    """A known name, or the longest known name within it; null for others."""
    text = F.lower(strip(raw))
    out = F.when(text.isin(*lexicon.ENTITIES), looked_up(text, lexicon.ENTITIES, ""))
    for key in sorted(lexicon.ENTITIES, key=len, reverse=True):
        out = out.when(F.contains(text, F.lit(key)), lexicon.ENTITIES[key])
    return out.otherwise(None)


def canonical_entity(name: Column, known: Column) -> Column:
    """The root before the dot mapped to the schema's name, if that is known and the root is not. known: array of objects."""
    root = F.substring_index(name, ".", 1)
    mapped = looked_up(root, lexicon.ENTITY_ROOTS, "")
    return F.when(F.array_contains(known, root), name).when((mapped != "") & F.array_contains(known, mapped), F.concat(mapped, F.substr(name, F.length(root) + 1))).otherwise(name)


def tolerance_type(expression: Column) -> Column:
    """(type, error) of a tolerance expression as a model answers it."""
    e = F.regexp_replace(strip(F.replace(F.replace(expression, F.lit("```python"), F.lit("")), F.lit("```"), F.lit(""))), "^\"+|\"+$", "")
    e = F.regexp_replace(e, "^'+|'+$", "")
    gdt = F.regexp_extract(e, r"^GDT\s*\(\s*([A-Za-z]+)", 1)
    kind = F.when(e.startswith("Tolerance("), "Bilateral").when(e.startswith("Limits("), "Limits").when(e.startswith("Max(") | e.startswith("Min("), "SingleLimit").when(e.startswith("GDT(") & gdt.isin(*lexicon.GDT_TYPES), "GDT")
    error = F.when(e == "", "Empty tolerance expression").when(e.startswith("GDT(") & (gdt == ""), "Malformed GDT expression").when(e.startswith("GDT(") & kind.isNull(), F.concat(F.lit("Unsupported GD&T type: "), gdt)).when(kind.isNull(), F.concat(F.lit("Unsupported tolerance formalism: "), e))
    return F.struct(kind.alias("type"), error.alias("error"), e.alias("equation"))


def pascal_case(equation: Column) -> Column:
    """object.attribute as Object.Attribute everywhere; moduleparams as ModuleParams.

    Text is split at its dotted names, the names are rewritten, and the two are zipped together again.
    """
    pattern = r"\b[a-zA-Z_]\w*\.[a-zA-Z_]\w*\b"
    up = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))

    def one(m: Column) -> Column:
        root = F.substring_index(m, ".", 1)
        return F.concat(F.when(F.lower(root) == "moduleparams", "ModuleParams").otherwise(up(root)), F.lit("."), up(F.substring_index(m, ".", -1)))

    names = F.transform(F.regexp_extract_all(equation, F.lit(pattern), F.lit(0)), one)
    return F.array_join(F.zip_with(F.split(equation, pattern, -1), names, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit("")))), "")


def schema_problem(domain: Column, objects: Column, sides: Column, tolerance_object: Column, scoped: Column | None = None) -> Column:
    """The error of a rule's schema check, null if it is consistent.

    objects: map from domain to its objects. sides: array of entities as said, blank ones passed over; with scoped (true for a
    geometry over domains, null without one) array of "domain.entity", each of which must be there.
    """
    known, own = F.map_keys(objects), F.coalesce(objects[domain], F.array().cast("array<string>"))
    q = lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("")), F.lit("'"))
    first = lambda items: F.get(items, F.lit(0))
    missing = first(F.filter(sides, lambda e: truthy(e).isNotNull() & ~F.array_contains(own, F.substring_index(canonical_entity(e, own), ".", 1))))
    out = F.when(~F.array_contains(known, domain) | domain.isNull(), F.concat(F.lit("Schema Gap: Unknown domain "), q(domain)))
    single = F.when(missing.isNotNull(), F.concat(F.lit("Schema Gap: Geometry entity "), q(missing), F.lit(" not defined in "), q(domain)))
    if scoped is not None:
        of, name = lambda e: F.substring_index(e, ".", 1), lambda e: F.substring_index(e, ".", -1)

        def problem(e: Column) -> Column:
            gone = ~F.array_contains(F.coalesce(objects[of(e)], F.array().cast("array<string>")), name(e))
            return F.when(~F.coalesce(F.contains(e, F.lit(".")), F.lit(False)), "Geometry v2 entities must be qualified objects").when(~F.array_contains(known, of(e)), F.concat(F.lit("Unknown geometry domain "), q(of(e)))).when(gone, F.concat(F.lit("Schema Gap: Geometry entity "), q(name(e)), F.lit(" not in domain "), q(of(e))))

        over = F.when(F.size(sides) == 0, "Geometry v2 requires geometry_scope").otherwise(first(F.filter(F.transform(sides, problem), lambda x: x.isNotNull())))
        single = F.when(F.coalesce(scoped, F.lit(False)), over).otherwise(single)
    tolerance = F.when(truthy(tolerance_object).isNotNull() & ~F.array_contains(own, tolerance_object), F.concat(F.lit("Schema Gap: Tolerance object "), q(tolerance_object), F.lit(" not defined")))
    return F.coalesce(out, single, tolerance)


def contracted(answer: Column) -> Column:
    """(formalism, equation, ast, reasoning) of a formalisation's answer; all but the reasoning are null where it breaks the contract."""
    j = json_part(answer)
    field = lambda k: F.get_json_object(j, f"$.{k}")
    formalism, equation, ast = field("formalism"), truthy(field("equation")), truthy(field("ast"))
    error = (
        F.when(j.isNull() | F.try_parse_json(j).isNull(), "no JSON")
        .when(formalism.isNotNull() & ~formalism.isin("equation", "AST"), "Invalid formalism type")
        .when((formalism == "equation") & equation.isNull(), "Equation formalism without equation")
        .when((formalism == "AST") & F.coalesce(ast, F.lit("{}")).isin("{}", "[]"), "AST formalism without AST")
    )
    kept = lambda c: F.when(error.isNull(), c)
    return F.struct(kept(formalism).alias("formalism"), kept(equation).alias("equation"), kept(ast).alias("ast"), F.when(error.isNull(), field("reasoning")).otherwise(F.concat(F.lit("Formalization output invalid: "), error)).alias("reasoning"))


def self_validated(status: Column, equation: Column, answer: Column) -> Column:
    """(is_valid, issues) of a formal rule: deferred ones pass; else the validator's answer, and no chained attributes whatever it says."""
    j = json_part(answer)
    parsed = F.from_json(j, "is_valid boolean, issues array<string>")
    issues = F.coalesce(parsed["issues"], F.array().cast("array<string>"))
    chained = chained_access(F.coalesce(equation, F.lit("")))
    said = F.concat(F.lit("Illegal chained attributes detected: ['"), F.array_join(chained, "', '"), F.lit("']"))
    broken = j.isNull() | F.try_parse_json(j).isNull()
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(status == "Deferred", True).when(broken, False).otherwise(F.coalesce(parsed["is_valid"], F.lit(False)) & (F.size(chained) == 0)).alias("is_valid"),
        F.when(status == "Deferred", none).when(broken, F.array(F.lit("Validator JSON parse failure"))).when(F.size(chained) > 0, F.array_append(issues, said)).otherwise(issues).alias("issues"),
    )


def attribute_rule(answer: Column) -> Column:
    """(formalism, equation, reasoning) of a model's answer."""
    e = F.regexp_replace(F.regexp_replace(strip(answer), "^\"+|\"+$", ""), "^'+|'+$", "")
    gap = e.isNull() | F.lower(e).isin("", "null", "none")
    p = pascal_case(e)
    branch = p.rlike(r"max\(|min\(| if ")
    return F.struct(
        F.when(~gap, "equation").alias("formalism"),
        F.when(~gap, p).alias("equation"),
        F.when(gap, "Schema gap: the rule needs attributes that the schema does not have.").when(branch, "Conditional attribute constraint as an equation.").otherwise("Attribute constraint as an equation.").alias("reasoning"),
    )


def chained_access(equation: Column) -> Column:
    return F.regexp_extract_all(equation, F.lit(r"\.(\w+)\."), F.lit(1))


def split_equation(equation: Column) -> Column:
    """(lhs, op, rhs) at the leftmost operator; nulls without one."""
    op = F.nullif(F.regexp_extract(equation, r"(>=|<=|==|!=|\bbetween\b|\bin\b|>|<)", 1), F.lit(""))
    # Behind the text before the match, not at the operator's first letters: "Min in x" has its operator at the second "in".
    before = F.regexp_extract(equation, r"(?s)^(.*?)(?:>=|<=|==|!=|\bbetween\b|\bin\b|>|<)", 1)
    at = F.length(before) + 1
    return F.struct(
        F.when(op.isNotNull(), strip(F.substr(equation, F.lit(1), at - 1))).alias("lhs"), op.alias("op"), F.when(op.isNotNull(), strip(F.substr(equation, at + F.length(op)))).alias("rhs")
    )


def short_name(text: Column) -> Column:
    """Up to seven words before the first stop word behind the third, in title case."""
    w = words(F.regexp_replace(text, "[^a-zA-Z0-9 ]", ""))
    stops = F.array(*[F.lit(s) for s in lexicon.NAME_STOPS])
    cut = F.array_min(F.filter(F.transform(w, lambda x, i: F.when((i > 3) & F.array_contains(stops, F.lower(x)), i)), lambda i: i.isNotNull()))
    taken = F.slice(w, F.lit(1), F.least(F.coalesce(cut, F.size(w)), F.lit(7)))
    return F.initcap(F.lower(F.array_join(taken, " ")))


def with_domain(rows: DataFrame, domain: str = "domain") -> DataFrame:
    """rows with category_name, thick and aliases of their domain's configuration (general for unknown ones), in place of columns of these names."""
    spark, rows = rows.sparkSession, rows.drop("category_name", "thick", "aliases")
    (name,) = unused(rows, "domain_key")
    config = spark.createDataFrame([(k, *v) for k, v in lexicon.DOMAIN_CONFIG.items()], f"{name} string, category_name string, thick string, aliases array<string>")
    known = F.lower(strip(F.coalesce(F.col(domain), F.lit(""))))
    key = F.when(known.isin(*lexicon.DOMAIN_CONFIG), known).otherwise("general")
    return rows.withColumn(name, key).join(F.broadcast(config), name, "left").drop(name)  # a dozen rows


def substituted(expression: Column, thick: Column, aliases: Column) -> Column:
    e = F.aggregate(aliases, expression, lambda a, x: F.replace(a, x, thick))
    e = F.replace(e, F.lit("Distance(Hole, Hole)"), F.lit(DISTANCE))
    return F.replace(e, F.lit("Distance("), F.lit(DISTANCE))


def algebra(lhs: Column, op: Column, rhs: Column, thick: Column, aliases: Column) -> Column:
    """(exp_name, op, recom_num, recom_text): rhs = k*T (+- rest) becomes (lhs -+ rest)/T op k."""
    left, right = substituted(lhs, thick, aliases), substituted(rhs, thick, aliases)
    number = r"(\d+\.?\d*)"
    # The variable becomes one letter outside the alphabet of equations, so one pattern fits all domains.
    t = F.replace(right, thick, F.lit("¤"))
    pattern = rf"{number}\s*\*\s*¤|¤\s*\*\s*{number}"
    k = F.coalesce(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")))
    rest = F.replace(strip(F.regexp_replace(t, pattern, "")), F.lit("¤"), thick)
    term = lambda sign: F.regexp_replace(rest, rf"^[{sign} ]+|[{sign} ]+$", "")
    kept = F.lower(right).contains("max(") | F.lower(right).contains("min(") | F.lower(left).contains("tolerance(")
    odd = k.isNotNull() & (rest != "") & ~rest.startswith("+") & ~rest.startswith("-")
    new = F.when(rest == "", left).when(rest.startswith("+"), F.concat(F.lit("("), left, F.lit(" - "), term("+"), F.lit(")"))).otherwise(F.concat(F.lit("("), left, F.lit(" + "), term("-"), F.lit(")")))
    turned = k.isNotNull() & ~kept & ~odd
    plain = F.when(strip(right).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), strip(right).try_cast("double"))
    num = F.when(kept | odd, None).when(turned, k.try_cast("double")).otherwise(plain)
    return F.struct(F.when(turned, F.concat(new, F.lit("/"), thick)).otherwise(left).alias("exp_name"), op.alias("op"), num.alias("recom_num"), F.when(num.isNull(), right).alias("recom_text"))


def canonical_rules(rows: DataFrame) -> DataFrame:
    """rows (rule_text, status, domain, geometry_json, equation, ast) as canonical rules; those without one are dropped.

    A geometry's right side may hold the whole equation; a tolerance function stands for itself, with operator "True".
    """
    rows = rows.select(*[c for c in rows.columns if c in ("rid", "rule_text", "status", "domain", "geometry_json", "equation", "ast")])
    live = rows.where(~F.lower(strip(F.coalesce(F.col("status"), F.lit("")))).isin("skipped", "invalid")).where(truthy(F.coalesce("geometry_json", "equation", "ast")).isNotNull())
    geo = truthy(F.col("geometry_json"))
    is_tol = geo.isNull() & strip(F.coalesce(F.col("equation"), F.lit(""))).startswith("Tolerance(")
    parts = split_equation(F.when(geo.isNotNull(), F.get_json_object(geo, "$.rhs")).otherwise(F.col("equation")))
    step = with_domain(live).withColumns({"__p": parts, "__geo": geo.isNotNull(), "__tol": is_tol})
    lhs = F.when(F.col("__tol"), F.col("equation")).when(F.col("__geo") & F.contains(F.col("__p.lhs"), F.lit("Distance")), DISTANCE).otherwise(F.col("__p.lhs"))
    step = step.withColumn("__lhs", lhs).where(truthy(F.col("__lhs")).isNotNull())
    root = F.when(F.contains(F.col("__lhs"), F.lit(".")), F.substring_index("__lhs", ".", 1))
    step = step.withColumn("__a", algebra(F.col("__lhs"), F.col("__p.op"), F.coalesce(F.col("__p.rhs"), F.lit("")), F.col("thick"), F.col("aliases")))
    pick = lambda tol, geo_, other: F.when(F.col("__tol"), tol).when(F.col("__geo"), geo_).otherwise(other)
    return step.select(
        *[c for c in rows.columns if c == "rid"],
        "rule_text",
        F.col("category_name").alias("rule_category"),
        short_name(F.coalesce(F.col("rule_text"), F.lit(""))).alias("name"),
        pick("Tolerance", "Distance", F.coalesce(root, F.lit("Attribute"))).alias("feature1"),
        pick(F.lit("Tolerance"), F.coalesce(F.get_json_object("geometry_json", "$.from"), F.lit("")), F.coalesce(root, F.lit(""))).alias("object1"),
        F.when(F.col("__geo"), F.coalesce(F.get_json_object("geometry_json", "$.to"), F.lit(""))).otherwise("").alias("object2"),
        F.when(F.col("__tol"), F.col("__lhs")).otherwise(F.col("__a.exp_name")).alias("exp_name"),
        F.when(F.col("__tol"), "True").otherwise(F.col("__a.op")).alias("operator"),
        F.when(~F.col("__tol"), F.col("__a.recom_num")).alias("recom_num"),
        F.when(F.col("__tol"), "true").otherwise(F.col("__a.recom_text")).alias("recom_text"),
    )


def relation_problem(kind: Column, n_entities: Column) -> Column:
    need = looked_up(kind, {k: str(v[0]) for k, v in lexicon.GEOMETRY_RELATIONS.items()}, "")
    return F.when(need == "", "Unknown geometry relation").when(need != n_entities.cast("string"), "Wrong number of entities")


def distance_expression(a: Column, b: Column) -> Column:
    return F.concat(F.lit("Distance("), a, F.lit(", "), b, F.lit(")"))

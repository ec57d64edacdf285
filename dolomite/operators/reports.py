"""Summaries over documents and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dolomite.functions import rules as rule_columns
from dolomite.functions.text import strip


def document_summary(docs: DataFrame, rules: DataFrame, chunks: DataFrame | None = None, doc_col: str = "doc_id") -> DataFrame:
    """A row per document, those without rules too: rule_count, avg_confidence, chunk_count, status."""
    of = rules.groupBy(doc_col).agg(F.count(F.lit(1)).alias("rule_count"), F.bround(F.avg("confidence"), 4).alias("avg_confidence"))
    out = docs.join(of, doc_col, "left")
    if chunks is not None:
        out = out.join(chunks.groupBy(doc_col).agg(F.count(F.lit(1)).alias("chunk_count")), doc_col, "left").fillna(0, ["chunk_count"])
    return out.fillna(0, ["rule_count"]).fillna(0.0, ["avg_confidence"]).withColumn("status", F.when(F.col("rule_count") > 0, "success").otherwise("no_rules"))


def run_summary(per_doc: DataFrame) -> DataFrame:
    """One row over documents with status, rule_count, avg_confidence and seconds.

    What is neither success nor no_rules counts as failed. The mean confidence is the sum over all documents over the
    number of successful ones.
    """
    ok = F.count_if(F.col("status") == "success")
    return per_doc.agg(
        F.count(F.lit(1)).alias("documents"),
        ok.alias("successful_documents"),
        F.count_if(~F.col("status").isin("success", "no_rules")).alias("failed_documents"),
        F.coalesce(F.sum("rule_count"), F.lit(0)).alias("total_rules"),
        F.bround(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("total_seconds"),
        F.bround(F.coalesce(F.avg("seconds"), F.lit(0.0)), 3).alias("avg_seconds"),
        F.coalesce(F.sum("avg_confidence") / F.nullif(ok, F.lit(0)), F.lit(0.0)).alias("average_confidence"),
    )


def validation_counts(validated: DataFrame, by: str = "doc_id") -> DataFrame:
    is_ = lambda s: F.count_if(F.col("validation_state") == s)
    return validated.groupBy(by).agg(F.count(F.lit(1)).alias("total_rules"), is_("ADVISORY_ONLY").alias("advisory_rules"), is_("ENFORCEABLE").alias("enforceable_rules"), is_("INCOMPLETE").alias("incomplete_rules"), F.count_if("unresolved").alias("unresolved_compound_constraints"))


def dashboard(rules: DataFrame, category: str = "category") -> DataFrame:
    return rules.agg(F.count(F.lit(1)).alias("total"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence"), F.countDistinct(category).alias("categories"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int = 20) -> DataFrame:
    """bin (from 0; the top end belongs to the last) and n, of values within the ends."""
    inside = rows.select(value.alias("v")).where(F.col("v").between(low, high))
    place = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(rows: DataFrame, value: str, by: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(by).agg(F.min(value).alias("low"), p.alias("p"), F.max(value).alias("high")).select(by, "low", *[F.col("p")[i].alias(f"q{i + 1}") for i in range(3)], "high")


def label_scores(predicted: DataFrame, label: str = "label", score: str = "confidence", cut: float = 0.7) -> DataFrame:
    """Accuracy, precision, recall and F1 of score > cut; rows without a score are predicted 0 if labelled so, and wrong else.

    Without rows all are 0.
    """
    p, y = F.coalesce(F.col(score) > cut, F.lit(False)), F.col(label) == 1
    c = lambda x: F.count_if(x).cast("double")
    rows = predicted.agg(F.count(F.lit(1)).alias("n"), c(p & y).alias("tp"), c(p & ~y).alias("fp"), c(~p & y).alias("fn"), c(~p & ~y & F.col(score).isNotNull()).alias("tn"))
    return rows.select(
        "n", "tp", "fp", "fn", "tn",
        F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("n")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0.0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0.0)), F.lit(0.0)).alias("recall"),
        F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0.0)), F.lit(0.0)).alias("f1"),
    )


def best_rule(rules: DataFrame, doc_col: str = "doc_id", index_col: str = "rule_index") -> DataFrame:
    """The rule of highest confidence of each document, the first of equals."""
    best = F.max_by(F.struct(*rules.columns), F.struct("confidence", (-F.col(index_col)).alias("i")))
    return rules.groupBy(doc_col).agg(best.alias("r")).select("r.*")


def flattened(docs: DataFrame, rules: str = "rules") -> DataFrame:
    """A row per rule with rule_index from 1; documents without rules keep one row."""
    return docs.select(*[c for c in docs.columns if c != rules], F.posexplode_outer(rules).alias("i", "rule")).select("*", (F.col("i") + 1).alias("rule_index")).drop("i")


def strict_rows(rules: DataFrame) -> DataFrame:
    """The seven columns of a reviewer's table: rule_text, domain, rule_type, constraints, applicability_text, severity, confidence.

    rules: rule_text, filename, technical_domain, industry_sector, primary_feature, rule_type, constraints (text) or constraint_list and
    compound (arrays), applicability (a map), severity, confidence. Columns that are not there count as null; other columns are
    dropped, and so are rules without text.
    """
    have = set(rules.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    printed = rule_columns.printed_constraints(F.col("constraint_list") if "constraint_list" in have else None, F.col("compound") if "compound" in have else None)
    applies = rule_columns.printed_applicability(F.col("applicability")) if "applicability" in have else F.lit("")
    return rules.where(rule_columns.truthy(F.col("rule_text")).isNotNull()).select(
        *[c for c in rules.columns if c == "rid"],
        strip(F.col("rule_text")).alias("rule_text"),
        rule_columns.picked_domain(col("filename"), col("technical_domain"), col("industry_sector"), col("primary_feature")).alias("domain"),
        F.coalesce(rule_columns.truthy(col("rule_type")), F.lit("general")).alias("rule_type"),
        F.coalesce(rule_columns.truthy(col("constraints")), printed).alias("constraints"),
        F.coalesce(applies, F.lit("")).alias("applicability_text"),
        F.upper(F.coalesce(rule_columns.truthy(col("severity")), F.lit("ADVISORY"))).alias("severity"),
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col("confidence", "double"), F.lit(0.0)))), 4).alias("confidence"),
    )


EXPORT = ("rule_text", "classification_label", "confidence_score", "rule_category", "rule_type", "primary_feature", "operator", "value", "unit", "source_document", "extraction_method", "manufacturing_relevance")


def export_rows(rules: DataFrame) -> DataFrame:
    """The twelve columns EXPORT; classification_label is 1 from a confidence over 0.7, and a column that is not there is null."""
    have = set(rules.columns)
    kept = [rule_columns.class_label(F.col("confidence_score")).alias(c) if c == "classification_label" else F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EXPORT]
    return rules.select(*[c for c in rules.columns if c == "rid"], *kept)


def export_summary(rows: DataFrame) -> DataFrame:
    """(metric, value) of exported rows: their number, mean confidence, those over 0.8, and categories."""
    one = rows.agg(F.count(F.lit(1)).cast("double").alias("Total Rules"), F.avg("confidence_score").alias("Avg Confidence"), F.count_if(F.col("confidence_score") > 0.8).cast("double").alias("High Confidence Rules"), F.countDistinct("rule_category").cast("double").alias("Manufacturing Categories"))
    return one.unpivot([], one.columns, "metric", "value")


def rule_objects(rules: DataFrame, metadata: str | None = None) -> DataFrame:
    """rule_text (trimmed), rule_category, rule_type, confidence_score (4 places), priority, rationale; metadata (a map) over them."""
    rows = rules.select(
        *[c for c in rules.columns if c in ("doc_id", "chunk_index", "rule_index", metadata)],
        strip(F.col("rule_text")).alias("rule_text"), F.col("category").alias("rule_category"), "rule_type", F.bround("confidence", 4).alias("confidence_score"), "priority", "rationale",
    )
    if metadata is None:
        return rows
    own = ("rule_text", "rule_category", "rule_type", "confidence_score", "priority", "rationale")
    return rows.withColumns({c: F.coalesce(F.col(metadata)[c].cast(dict(rows.dtypes)[c]), F.col(c)) for c in own})


def document_results(docs: DataFrame, rules: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """docs (name, processing_time, chunks_processed) as results: source_pdf, rule_count, rules, processing_time, chunks_processed."""
    of = rules.groupBy(doc_col).agg(F.count(F.lit(1)).alias("rule_count"), F.array_sort(F.collect_list(F.struct(*[c for c in rules.columns if c != doc_col]))).alias("rules"))
    return docs.join(of, doc_col, "left").select(F.col("name").alias("source_pdf"), F.coalesce("rule_count", F.lit(0)).alias("rule_count"), "rules", "processing_time", "chunks_processed")


def compiled(rules: DataFrame, source: str = "source") -> DataFrame:
    """source_document, compiled_at, rules: an entry per document of a batch."""
    return consolidated(rules, source).select(F.col(source).alias("source_document"), F.current_timestamp().alias("compiled_at"), "rules")


def mean_density(rows: DataFrame, density: str = "density") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(density), F.lit(0.0)).alias("mean_density"))


def repeated_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """name, n of names with more than one entry."""
    return rows.groupBy(F.lower(strip(F.col(name))).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def consolidated(rules: DataFrame, source: str = "source") -> DataFrame:
    """source, rule_count, rules (in order of rule_index): an entry per source document, as it is written out."""
    return rules.groupBy(source).agg(F.count(F.lit(1)).alias("rule_count"), F.array_sort(F.collect_list(F.struct("rule_index", "rule_text", "confidence"))).alias("rules"))


def consolidated_all(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, totals) of rule files (source, rule_count, rules: array) as readers.rule_files gives them.

    entries: source, rule_count (the file's own, or its number of rules where it says none), rules. totals: one row, documents and rules.
    """
    entries = files.select("source", F.when(F.col("rule_count") > 0, F.col("rule_count")).otherwise(F.size("rules")).alias("rule_count"), "rules")
    return entries, entries.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.sum("rule_count"), F.lit(0)).alias("total_rules"))

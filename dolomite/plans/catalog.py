"""The queries over the driver's tables and our small inputs, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions import formal, rules as r, text as t
from dolomite.operators import candidates, cells, chunking, expressions, inverted, limits, postprocess, provider, reports, retrieval
from dolomite.plans import corpus, pipelines
from dolomite.sources.writers import new_folder, upserted
from dolomite.streaming.incremental import arriving
from dolomite.streaming.keyed import KeyedTable, resuming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WS = r"[ \t\n\r\x0b\x0c]+"
WORDS = f"list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')"
CUE = "license|token|thon|[0-9]"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Small files are dealt out over the cores before text work; large tables already come in many tasks.

    part always is: its rows are short, so that a file of one row group holds very many, and one task reads them however often the file is split.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "part":
        return df.repartition(cores)
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def sql_contains(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in terms) + ")"


def sql_count(x: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{w}') AS INT)" for w in terms) + ")"


SENTENCES = f"string_split(regexp_replace(text, '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(1))"
WINDOWS = f"""
    w AS (SELECT doc_id, lang, source, {WORDS} AS ws FROM documents),
    c AS (SELECT doc_id, lang, source, CAST(s // 90 AS INT) AS chunk_index, array_to_string(ws[s + 1 : s + 100], ' ') AS chunk
          FROM (SELECT *, unnest(range(0, len(ws), 90)) AS s FROM w))"""


def data_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.word_windows(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), 131, 13).drop("text")


def data_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates.rule_sentences(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), lexicon.DATA_PRIORITY, [])
    return rows.withColumn("rule_index", F.col("sent_index")).drop("confidence").withColumn("confidence", F.least(F.lit(1.0), 0.3 + F.length("rule_text") / 401.7))


RULES_SQL = f"""
    s AS (SELECT doc_id, lang, unnest({SENTENCES}) AS raw, unnest(range(len({SENTENCES}))) AS sent_index FROM documents),
    u AS (SELECT doc_id, lang, CAST(sent_index AS INT) AS sent_index, left({sql_strip('raw')}, 500) AS rule_text FROM s
          WHERE {sql_strip('raw')} <> '' AND (regexp_matches(lower(raw), 'license|token|thon|apache|shall|must') OR regexp_matches(raw, '\\b(\\d+\\.?\\d*|\\d*\\.?\\d+)\\b'))),
    rules AS (SELECT *, sent_index AS rule_index, least(1.0, 0.3 + length(rule_text) / CAST(401.7 AS DOUBLE)) AS confidence FROM u)"""

DATA_RULES_SQL = corpus.rules_sql(RULES_SQL)


@query(f"WITH {WINDOWS} SELECT lang, count(*) AS candidates, count(DISTINCT (doc_id, md5(lower(chunk)))) AS distinct_rules, count(DISTINCT doc_id) AS documents FROM c WHERE regexp_matches(lower(chunk), '{CUE}') GROUP BY lang")
def min_slice_summary(spark, sf_dir):
    rows = data_windows(spark, sf_dir).where(F.lower("chunk").rlike(CUE))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("doc_id", F.md5(F.lower("chunk").cast("binary"))).alias("distinct_rules"), F.countDistinct("doc_id").alias("documents"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(repr(x) for x in lexicon.DATA_TERMS)}], lambda k: contains(lower(text), k))), ',') AS keywords FROM documents")
def keyword_glossary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t.matched_terms(F.col("text"), lexicon.DATA_TERMS), ",").alias("keywords"))


@query(f"SELECT doc_id, length(text) AS char_count, len({WORDS}) AS word_count, {sql_count('lower(text)', lexicon.DATA_TERMS)} AS n_keywords, round({sql_count('lower(text)', lexicon.DATA_TERMS)} / greatest(len({WORDS}), 1), 6) AS density FROM documents")
def doc_metadata(spark, sf_dir):
    rows = candidates.document_metadata(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon.DATA_TERMS)
    return rows.select("doc_id", "char_count", "word_count", F.size("keywords").alias("n_keywords"), F.round("density", 6).alias("density"))


@query(f"WITH {WINDOWS} SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5 FROM c")
def chunk_words(spark, sf_dir):
    return data_windows(spark, sf_dir).select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), c AS (SELECT *, unnest(range(0, len(ws), 80)) AS s FROM w) SELECT doc_id, CAST(s // 80 AS INT) AS chunk_index, md5(array_to_string(ws[s + 1 : s + 100], ' ')) AS chunk_md5 FROM c WHERE s = 0 OR s - 80 + 100 < len(ws)")
def chunk_tokens(spark, sf_dir):
    rows = chunking.windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 100, 20)
    return rows.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query()
def chunk_semantic(spark, sf_dir):
    rows = chunking.sentence_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), 60, terms=lexicon.DATA_PRIORITY)
    return rows.select("doc_id", "chunk_index", "token_count", "score", "sentence_count", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(f"""WITH {WINDOWS}, n AS (SELECT *, max(chunk_index) OVER (PARTITION BY doc_id) + 1 AS n FROM c)
    SELECT doc_id, chunk_index FROM n WHERE n <= 5 OR list_contains([CAST(round_even(i * (n - 1) / 4.0, 0) AS INT) FOR i IN range(5)], chunk_index)""")
def chunk_downsample(spark, sf_dir):
    return chunking.thinned(data_windows(spark, sf_dir), 5).select("doc_id", "chunk_index")


@query(f"""WITH {WINDOWS} SELECT doc_id, chunk_index, ({sql_contains('lower(chunk)', lexicon.DATA_PRIORITY)} OR regexp_matches(chunk, '[0-9]') OR {sql_contains('lower(chunk)', lexicon.MODALS)}) AS high_value FROM c""")
def high_value_chunks(spark, sf_dir):
    return data_windows(spark, sf_dir).select("doc_id", "chunk_index", candidates.is_high_value(F.col("chunk"), lexicon.DATA_PRIORITY, []).alias("high_value"))


@query(f"WITH {RULES_SQL} SELECT doc_id, sent_index, md5(rule_text) AS rule_md5, confidence FROM rules")
def heuristic_candidates(spark, sf_dir):
    return data_rules(spark, sf_dir).select("doc_id", "sent_index", F.md5(F.col("rule_text").cast("binary")).alias("rule_md5"), "confidence")


def sql_canonical(x: str) -> str:
    s = x
    for pattern in (r"(?i)-+\s*Page\s*\d+\s*-+", r"(?i)Page\s*\d+(\s*of\s*\d+)?", r"(?i)Please recycle\.|Please recycle[^\n]*"):
        s = f"regexp_replace({s}, '{pattern}', '', 'g')"
    s = f"regexp_replace({s}, '(?i)^\\s*(note:|tip:|•|\\*|-\\s+|o\\s+)\\s*', '')"
    s = sql_strip(f"regexp_replace({s}, '{WS}', ' ', 'g')")
    return sql_strip(f"regexp_replace(regexp_replace({s}, '^\\d+\\s*/\\s*\\d+', ''), '^\\d+\\.\\s*', '')")


@query(f"""WITH a AS (SELECT rid, text, {sql_canonical('text')} AS s FROM {DATA_RULES_SQL}),
    b AS (SELECT *, CASE WHEN length(s) > 240 THEN regexp_replace(left(s, 240), ' [^ ]*$', '') || '...' ELSE s END AS c FROM a)
    SELECT rid, CASE WHEN text = '' THEN '' WHEN regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END AS canonical FROM b""")
def canonical_text(spark, sf_dir):
    return corpus.rules(data_rules(spark, sf_dir)).select("rid", t.canonical(F.col("text")).alias("canonical"))


@query("SELECT doc_id, 'documents.parquet__' || left(md5(text), 16) AS cache_id FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.cache_id(F.lit(f"{sf_dir}/documents.parquet"), F.col("text")).alias("cache_id"))


@query(f"WITH {RULES_SQL}, k AS (SELECT *, {sql_strip(chr(114) + 'ule_text')} AS x, row_number() OVER (PARTITION BY doc_id, regexp_replace(lower({sql_strip('rule_text')}), '{WS}', ' ', 'g') ORDER BY rule_index) AS n FROM rules) SELECT doc_id, rule_index, rule_text FROM k WHERE n = 1")
def exact_dedupe(spark, sf_dir):
    rows = data_rules(spark, sf_dir).select("doc_id", "rule_index", "rule_text")
    return postprocess.first_of_each(rows, t.norm_key(F.col("rule_text")), ["rule_index"])


@query(f"SELECT rid, doc FROM (SELECT *, row_number() OVER (PARTITION BY doc, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g') ORDER BY rid) AS n FROM {DATA_RULES_SQL}) WHERE n = 1")
def normalized_fallback_dedupe(spark, sf_dir):
    return postprocess.squeezed_dedupe(corpus.rules(data_rules(spark, sf_dir)), ["rid"], ("doc",), "text").select("rid", "doc")


@query()
def near_dup_pairs(spark, sf_dir):
    return postprocess.similar_leaders(data_rules(spark, sf_dir))


@query(f"WITH {RULES_SQL} SELECT level, count(*) AS n FROM (SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS level FROM rules) GROUP BY level")
def confidence_levels(spark, sf_dir):
    return data_rules(spark, sf_dir).groupBy(r.confidence_level(F.col("confidence")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT rid, CASE WHEN relevance < 0.2 THEN 'out_of_scope' WHEN confidence < 0.4 THEN 'low_confidence' WHEN length({sql_strip('text')}) < 20 OR NOT regexp_matches(text, '[0-9]') THEN 'incomplete'
    WHEN confidence < 0.7 THEN 'needs_review' ELSE 'correct' END AS tag FROM {DATA_RULES_SQL}""")
def correctness_tags(spark, sf_dir):
    return corpus.rules(data_rules(spark, sf_dir)).select("rid", r.correctness_tag(F.col("confidence"), F.col("relevance"), F.col("text")).alias("tag"))


@query(f"WITH {RULES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_index) - 1 AS place FROM rules) SELECT doc_id, CAST(place AS INT) AS rule_index, md5({sql_strip('rule_text')}) AS rule_md5, confidence, 'general' AS rule_type FROM n WHERE place < 20")
def parsed_answers(spark, sf_dir):
    """Each document's sentences as a model would answer them, between entries that are no rules, in four shapes; and parsed again."""
    rules = data_rules(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rule_index", F.to_json(F.struct("rule_text", "confidence")).alias("j")))).alias("rules"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("rules", lambda r: F.concat(F.lit('null, "text", '), r["j"], F.lit(', ["x"], 5'))), ", "), F.lit("]"))
    within = F.concat(F.lit('{"note": "n", "rules": '), listed, F.lit("}"))
    shape = F.when(F.col("doc_id") % 4 == 0, listed).when(F.col("doc_id") % 4 == 1, within).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).otherwise(F.concat(F.lit("Found: "), within, F.lit(" and no more.")))
    return provider.parsed_rules(rules.select("doc_id", shape.alias("answer"))).select("doc_id", "rule_index", F.md5(F.col("rule_text").cast("binary")).alias("rule_md5"), "confidence", "rule_type")


@query(f"SELECT rid, list_transform(regexp_extract_all(replace(text, ',', ' '), '-?\\d*\\.?\\d+'), lambda x: CAST(x AS DOUBLE)) AS nums FROM {DATA_RULES_SQL}")
def parse_values(spark, sf_dir):
    return corpus.rules(data_rules(spark, sf_dir)).select("rid", t.numbers(F.col("text")).alias("nums"))


@query(f"""WITH v AS (SELECT rid, doc, upper(coalesce(nullif({sql_strip('severity')}, ''), 'ADVISORY')) AS s, coalesce({sql_strip('constraints')}, '') AS c FROM {DATA_RULES_SQL}),
    h AS (SELECT *, CASE WHEN c LIKE '[%' OR c LIKE '{{%' THEN c <> '[]' ELSE c <> '' END AS has_constraints, c LIKE '%_of":[]%' AS unresolved FROM v)
    SELECT rid, has_constraints, unresolved, CASE WHEN s <> 'ENFORCEABLE' THEN 'ADVISORY_ONLY' WHEN has_constraints AND NOT unresolved THEN 'ENFORCEABLE' ELSE 'INCOMPLETE' END AS validation_state,
           CASE WHEN s = 'ENFORCEABLE' THEN 'ENFORCEABLE' ELSE 'ADVISORY' END AS severity FROM h""")
def validate_rules(spark, sf_dir):
    return r.validated(corpus.rules(data_rules(spark, sf_dir))).select("rid", "has_constraints", "unresolved", "validation_state", "severity")


PER_DOC_SQL = f"""{RULES_SQL}, g AS (SELECT doc_id, count(*) AS rule_count, round_even(avg(confidence), 4) AS avg_confidence FROM rules GROUP BY doc_id),
    per_doc AS (SELECT d.doc_id, d.lang, coalesce(rule_count, 0) AS rule_count, coalesce(avg_confidence, 0.0) AS avg_confidence, CASE WHEN rule_count > 0 THEN 'success' ELSE 'no_rules' END AS status FROM documents d LEFT JOIN g USING (doc_id))"""


def per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.document_summary(table(spark, sf_dir, "documents").select("doc_id", "lang"), data_rules(spark, sf_dir).drop("lang"))


@query(f"WITH {PER_DOC_SQL} SELECT * FROM per_doc")
def document_summaries(spark, sf_dir):
    return per_document(spark, sf_dir)


@query(f"""WITH {PER_DOC_SQL} SELECT count(*) AS documents, count(*) FILTER (status = 'success') AS successful_documents, count(*) FILTER (status NOT IN ('success', 'no_rules')) AS failed_documents,
    CAST(sum(rule_count) AS BIGINT) AS total_rules, round_even(sum(rule_count * CAST(0.5 AS DOUBLE)), 3) AS total_seconds, round_even(avg(rule_count * CAST(0.5 AS DOUBLE)), 3) AS avg_seconds, round(sum(avg_confidence) / count(*) FILTER (status = 'success'), 6) AS average_confidence FROM per_doc""")
def run_summary(spark, sf_dir):
    rows = reports.run_summary(per_document(spark, sf_dir).withColumn("seconds", F.col("rule_count") * 0.5))
    return rows.withColumn("average_confidence", F.round("average_confidence", 6))


@query(f"WITH {RULES_SQL}, f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule_index) AS rule_index, rule_text FROM rules) SELECT d.doc_id, CAST(f.rule_index AS INT) AS rule_index, md5(rule_text) AS rule_md5 FROM documents d LEFT JOIN f USING (doc_id)")
def flatten_outer(spark, sf_dir):
    per = data_rules(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_index", "rule_text"))).alias("rules"))
    rows = reports.flattened(table(spark, sf_dir, "documents").select("doc_id").join(per, "doc_id", "left"))
    return rows.select("doc_id", "rule_index", F.md5(F.col("rule.rule_text").cast("binary")).alias("rule_md5"))


@query(f"""SELECT rid, {sql_strip('text')} AS rule_text, (CASE WHEN doc = 'b' THEN 'turning' WHEN doc = 'a' THEN 'sheet metal' WHEN doc = 'c' THEN 'aerospace' ELSE 'general' END) || (CASE WHEN rid % 3 = 0 THEN ' / hole' ELSE '' END) AS domain,
    CASE WHEN rid % 2 = 0 THEN 'dimensional' ELSE 'general' END AS rule_type, coalesce({sql_strip('constraints')}, '') AS constraints, CASE WHEN rid % 5 = 0 THEN '' ELSE 'process=' || doc END AS applicability_text,
    coalesce(upper(nullif({sql_strip('severity')}, '')), 'ADVISORY') AS severity, round_even(greatest(0.0, least(1.0, coalesce(confidence, 0.0))), 4) AS confidence
    FROM {DATA_RULES_SQL} WHERE {sql_strip('text')} <> ''""")
def dfm_strict(spark, sf_dir):
    when = lambda c, v: F.when(c, F.lit(v))
    rows = corpus.rules(data_rules(spark, sf_dir)).withColumns(
        {
            "rule_text": F.col("text"), "filename": when(F.col("doc") == "a", "Sheet-Metal.pdf"), "technical_domain": when(F.col("doc") == "b", " turning "), "industry_sector": when(F.col("doc") == "c", "aerospace"),
            "primary_feature": when(F.col("rid") % 3 == 0, "hole"), "rule_type": when(F.col("rid") % 2 == 0, "dimensional"),
            "applicability": F.create_map(F.lit("process"), F.when(F.col("rid") % 5 == 0, "Unknown").otherwise(F.col("doc")), F.lit("material"), F.lit("null")),
        }
    )
    return reports.strict_rows(rows)


@query(f"WITH {RULES_SQL}, c AS (SELECT d.source, count(*) AS rule_count, round(sum(r.confidence), 4) AS total_confidence FROM rules r JOIN documents d USING (doc_id) GROUP BY d.source) SELECT * FROM c")
def consolidate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = reports.consolidated(data_rules(spark, sf_dir).join(docs, "doc_id"))
    total = F.aggregate("rules", F.lit(0.0), lambda a, x: a + x["confidence"])
    return rows.select("source", "rule_count", F.round(total, 4).alias("total_confidence"))


NULLS = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ("rule_type", "primary_feature", "operator", "value", "unit", "extraction_method", "manufacturing_relevance"))


@query(f"WITH {RULES_SQL} SELECT md5(rule_text) AS rule_text, CASE WHEN confidence > 0.7 THEN 1 ELSE 0 END AS classification_label, confidence AS confidence_score, lang AS rule_category, doc_id AS source_document, {NULLS} FROM rules")
def export_rows(spark, sf_dir):
    rows = data_rules(spark, sf_dir).withColumnsRenamed({"confidence": "confidence_score", "lang": "rule_category", "doc_id": "source_document"})
    return reports.export_rows(rows.drop("relevance")).withColumn("rule_text", F.md5(F.col("rule_text").cast("binary")))


@query(f"""WITH {RULES_SQL}, a AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(confidence) AS m, CAST(count(*) FILTER (confidence > 0.8) AS DOUBLE) AS h, CAST(count(DISTINCT lang) AS DOUBLE) AS c FROM rules)
    SELECT 'Total Rules' AS metric, round(n, 6) AS value FROM a UNION ALL SELECT 'Avg Confidence', round(m, 6) FROM a UNION ALL SELECT 'High Confidence Rules', h FROM a UNION ALL SELECT 'Manufacturing Categories', c FROM a""")
def export_summary(spark, sf_dir):
    rows = data_rules(spark, sf_dir).withColumnsRenamed({"confidence": "confidence_score", "lang": "rule_category"})
    return reports.export_summary(reports.export_rows(rows)).withColumn("value", F.round("value", 6))


@query(f"WITH {RULES_SQL} SELECT doc_id, rule_index, confidence FROM rules QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, rule_index) <= 3")
def top_rules_per_doc(spark, sf_dir):
    return postprocess.capped(data_rules(spark, sf_dir).select("doc_id", "rule_index", "confidence"), 3, [F.desc("confidence"), F.col("rule_index")])


@query(f"WITH {RULES_SQL} SELECT doc_id, count(*) AS n_raw, count(*) FILTER (confidence >= 0.4) AS n_confident, count(*) FILTER (confidence >= 0.4 AND regexp_matches(rule_text, '[0-9]')) AS n_numeric FROM rules GROUP BY doc_id")
def quality_funnel(spark, sf_dir):
    return postprocess.funnel(data_rules(spark, sf_dir), {"n_confident": F.col("confidence") >= 0.4, "n_numeric": F.col("rule_text").rlike("[0-9]")})


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def category_counts(spark, sf_dir):
    return reports.value_counts(table(spark, sf_dir, "documents"), "source")


@query(f"WITH {RULES_SQL} SELECT CAST(least(floor(confidence / 0.05), 19) AS INT) AS bin, count(*) AS n FROM rules WHERE confidence BETWEEN 0 AND 1 GROUP BY bin")
def confidence_histogram(spark, sf_dir):
    return reports.histogram(data_rules(spark, sf_dir), F.col("confidence"), 0.0, 1.0, 20)


@query("SELECT lang, min(n_chars) AS low, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS high FROM documents GROUP BY lang")
def quartiles(spark, sf_dir):
    return reports.quartiles(table(spark, sf_dir, "documents"), "n_chars", "lang")


@query("""WITH p AS (SELECT quality AS label, CASE WHEN n_chars % 7 <> 0 THEN least(1.0, n_chars / 2000.0) END AS c FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT count(*) AS n, CAST(count(*) FILTER (c > 0.7 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (c > 0.7 AND label <> 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT coalesce(c > 0.7, FALSE) AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (c <= 0.7 AND label <> 1) AS DOUBLE) AS tn FROM p)
    SELECT *, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""")
def label_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")
    rows = rows.withColumn("confidence", F.when(F.col("n_chars") % 7 != 0, F.least(F.lit(1.0), F.col("n_chars") / 2000.0)))
    out = reports.label_scores(rows)
    return out.select("n", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"WITH {RULES_SQL} SELECT doc_id, rule_index, confidence FROM rules QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, rule_index) = 1")
def best_rule(spark, sf_dir):
    return reports.best_rule(data_rules(spark, sf_dir).select("doc_id", "rule_index", "confidence"))


@query("SELECT count(*) AS total, round(avg(least(1.0, n_chars / 5000.0)), 6) AS mean_confidence, count(*) FILTER (least(1.0, n_chars / 5000.0) > 0.8) AS high_confidence, count(DISTINCT source) AS categories FROM documents")
def dashboard_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("confidence"))
    return reports.dashboard(rows, "source").withColumn("mean_confidence", F.round("mean_confidence", 6))


KIND_SQL = "CASE p_size % 6 WHEN 0 THEN 'Sheetmetal' WHEN 1 THEN 'sheet metal' WHEN 2 THEN 'Plating' WHEN 3 THEN 'injection molding' WHEN 4 THEN 'Drill' ELSE 'unheard of' END"
PART_DOMAIN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.RULE_TYPE_DOMAINS.items())


@query(f"WITH m AS (SELECT CASE {KIND_SQL} {PART_DOMAIN} ELSE 'General' END AS domain FROM part) SELECT domain, count(*) AS n FROM m GROUP BY domain")
def rule_type_map(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.expr(KIND_SQL).alias("kind"))
    return rows.groupBy(r.looked_up(F.col("kind"), lexicon.RULE_TYPE_DOMAINS, "General").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def class_sql(x: str, title: str) -> str:
    tables = ((title, lexicon.CLASS_TITLES), (x, lexicon.CLASS_PROCESSES), (x, lexicon.CLASS_FEATURES), (x, lexicon.CLASS_GENERIC))
    cases = [f"WHEN {sql_contains(of, words)} THEN '{name}'" for of, named in tables for name, words in named.items()]
    return f"CASE {' '.join(cases)} ELSE 'General' END"


@query(f"SELECT 'rule' AS kind, rid AS id, {class_sql('lower(text)', 'lower(doc)')} AS class FROM {DATA_RULES_SQL} UNION ALL SELECT 'document', doc_id, {class_sql('lower(text)', 'lower(source)')} FROM documents")
def classify_rules(spark, sf_dir):
    """Documents by their text, their source standing for a title."""
    own = corpus.rules(data_rules(spark, sf_dir)).select(F.lit("rule").alias("kind"), F.col("rid").cast("long").alias("id"), r.rule_class(F.col("text"), F.col("doc")).alias("class"))
    return own.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), r.rule_class(F.col("text"), F.col("source")).alias("class")))


@query(f"SELECT doc_id, {class_sql('lower(text)', chr(39) * 2)} AS answer FROM documents")
def limited_answers(spark, sf_dir):
    """A class asked of a provider for every document, by workers that share one budget of calls, in blocks that are written."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    limit = limits.Limit(1_000_000, 0.0)
    return limits.asked_in_blocks(rows, provider.Offline(), "classify", limit, new_folder(spark, "limited"), ["doc_id"], "text", workers=2, block_rows=50_000).select("doc_id", "answer")


FOUND = f"({sql_count('lower(chunk)', lexicon.PRIORITY_TERMS)} + {sql_count('lower(chunk)', lexicon.PROCESS_TERMS)})"


@query(f"WITH {WINDOWS} SELECT doc_id, chunk_index, ({FOUND} > 0 OR regexp_matches(chunk, '[0-9]') OR {sql_contains('lower(chunk)', lexicon.MODALS)}) AS high_value FROM c")
def high_value_default(spark, sf_dir):
    """With the default terms."""
    return data_windows(spark, sf_dir).select("doc_id", "chunk_index", candidates.is_high_value(F.col("chunk")).alias("high_value"))


@query(f"""SELECT rid, confidence >= 0.3 AND relevance >= 0.2 AND length({sql_strip('text')}) >= 15 AND ({sql_contains('lower(text)', lexicon.PRIORITY_TERMS)} OR regexp_matches(text, '[0-9]') OR {sql_contains('lower(text)', lexicon.MODALS)}) AS acceptable,
    confidence >= 0.3 AND relevance >= 0.2 AND length({sql_strip('text')}) >= 8 AS acceptable_for_recall FROM {DATA_RULES_SQL}""")
def acceptable_rules(spark, sf_dir):
    args = [F.col(c) for c in ("text", "confidence", "relevance")]
    return corpus.rules(data_rules(spark, sf_dir)).select("rid", candidates.is_acceptable(*args).alias("acceptable"), candidates.is_acceptable(*args, recall=True).alias("acceptable_for_recall"))


def sql_key(x: str) -> str:
    return f"regexp_replace(lower({sql_strip(f'coalesce({x}, {chr(39) * 2})')}), '{WS}', ' ', 'g')"


@query(f"""WITH {RULES_SQL}, k AS (SELECT doc_id, rule_index, {sql_key('rule_text')} AS t FROM rules)
    SELECT doc_id, rule_index, CASE WHEN {sql_contains('t', lexicon.HIGH_PRIORITY)} THEN 'high' WHEN {sql_contains('t', lexicon.MEDIUM_PRIORITY)} THEN 'medium' ELSE 'low' END AS priority,
      CASE WHEN {sql_contains('t', lexicon.HIGH_RISK)} THEN 'high' WHEN regexp_matches(t, '[0-9]') OR {sql_contains('t', lexicon.MEDIUM_RISK)} THEN 'medium' ELSE 'low' END AS risk FROM k""")
def priority_and_risk(spark, sf_dir):
    return data_rules(spark, sf_dir).select("doc_id", "rule_index", r.priority_of(F.col("rule_text")).alias("priority"), r.risk_of(F.col("rule_text")).alias("risk"))


@query(f"""WITH k AS (SELECT rid, {sql_key('severity')} AS intent, CASE WHEN rid % 3 = 0 THEN '' ELSE doc END AS item, {sql_key('text')} AS t FROM {DATA_RULES_SQL})
    SELECT rid, CASE WHEN intent = '' AND item = '' AND rid % 2 = 1 THEN t || '|general|general' ELSE intent || '||' || item || '|||' || CASE WHEN rid % 2 = 0 THEN 'wall:>=:2:mm:' ELSE '' END END AS key FROM k""")
def rule_keys(spark, sf_dir):
    text = lambda v: F.lit(v).cast("string")
    one = F.struct(text("Wall").alias("subject"), text(">=").alias("operator"), text(" 2").alias("value"), text("mm").alias("unit"), text(None).alias("logic"))
    parts = F.when(F.col("rid") % 2 == 0, F.array(one)).otherwise(F.array().cast("array<struct<subject:string,operator:string,value:string,unit:string,logic:string>>"))
    scope = F.struct(text(None).alias("process"), F.when(F.col("rid") % 3 != 0, F.col("doc")).alias("item"), text("").alias("feature"))
    return corpus.rules(data_rules(spark, sf_dir)).select("rid", r.dedupe_key(F.col("severity"), scope, text(None), parts, F.col("text"), text("General"), text("general")).alias("key"))


@query(f"""WITH v AS (SELECT doc, upper(coalesce(nullif({sql_strip('severity')}, ''), 'ADVISORY')) AS s, coalesce({sql_strip('constraints')}, '') AS c FROM {DATA_RULES_SQL}),
    h AS (SELECT *, c <> '' AND c <> '[]' AS has_constraints, c LIKE '%_of":[]%' AS unresolved FROM v)
    SELECT doc, count(*) AS total_rules, count(*) FILTER (s <> 'ENFORCEABLE') AS advisory_rules, count(*) FILTER (s = 'ENFORCEABLE' AND has_constraints AND NOT unresolved) AS enforceable_rules,
      count(*) FILTER (s = 'ENFORCEABLE' AND NOT (has_constraints AND NOT unresolved)) AS incomplete_rules, count(*) FILTER (unresolved) AS unresolved_compound_constraints FROM h GROUP BY doc""")
def validation_counts(spark, sf_dir):
    return reports.validation_counts(r.validated(corpus.rules(data_rules(spark, sf_dir))), "doc")


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS ws, text FROM documents), m AS (SELECT doc_id, len(ws) AS n, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s,
      len(regexp_extract_all(lower(text), '[aeiouy]+')) + len(list_filter(ws, lambda x: NOT regexp_matches(lower(x), '[aeiouy]'))) AS y FROM w)
    SELECT doc_id, CASE WHEN n > 0 THEN round(CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * (n / s) - CAST(84.6 AS DOUBLE) * (y / n), 4) ELSE 0.0 END AS reading_ease, CASE WHEN n > 0 THEN round(CAST(0.39 AS DOUBLE) * (n / s) + CAST(11.8 AS DOUBLE) * (y / n) - CAST(15.59 AS DOUBLE), 4) ELSE 0.0 END AS grade_level FROM m""")
def readability(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(t.reading_ease(F.col("text")), 4).alias("reading_ease"), F.round(t.grade_level(F.col("text")), 4).alias("grade_level"))


@query(f"SELECT round(avg({sql_count('lower(text)', lexicon.DATA_TERMS)} / greatest(len({WORDS}), 1)), 6) AS mean_density FROM documents")
def mean_density(spark, sf_dir):
    rows = candidates.document_metadata(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon.DATA_TERMS)
    return reports.mean_density(rows).select(F.round("mean_density", 6).alias("mean_density"))


@query("SELECT lower(trim(split_part(p_name, ' ', 1))) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, sf_dir):
    return reports.repeated_names(table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("name")))


OBJECTS = {"Sheetmetal": ["Bend", "Hem", "CBHole"], "Turn": ["Groove"], "General": []}
CHECKS_SQL = "CASE domain " + " ".join(f"WHEN '{d}' THEN {o or 'CAST([] AS VARCHAR[])'}" for d, o in OBJECTS.items()) + " END"
ROOT_SQL = "CASE split_part(x, '.', 1) WHEN 'Counterbore' THEN 'CBHole' WHEN 'Curl' THEN 'RolledHem' ELSE split_part(x, '.', 1) END"
DOMAINS_SQL = ", ".join(f"'{d}'" for d in OBJECTS)
PAIRS_SQL = ", ".join(f"'{d}.{o}'" for d, os in OBJECTS.items() for o in os)


@query(f"""WITH o AS (SELECT *, chr(39) AS q, {CHECKS_SQL} AS objects, list_filter([side_a, side_b], lambda x: x <> '') AS sides FROM {corpus.values(corpus.CHECKS)}),
    m AS (SELECT *, list_filter(sides, lambda x: NOT list_contains(objects, {ROOT_SQL}))[1] AS missing,
      list_filter(list_transform(sides, lambda x: CASE WHEN NOT contains(x, '.') THEN 'Geometry v2 entities must be qualified objects' WHEN split_part(x, '.', 1) NOT IN ({DOMAINS_SQL}) THEN 'Unknown geometry domain ' || q || split_part(x, '.', 1) || q
        WHEN x NOT IN ({PAIRS_SQL}) THEN 'Schema Gap: Geometry entity ' || q || split_part(x, '.', 2) || q || ' not in domain ' || q || split_part(x, '.', 1) || q END), lambda x: x IS NOT NULL)[1] AS problem FROM o)
    SELECT rid, CASE WHEN domain NOT IN ({DOMAINS_SQL}) THEN 'Schema Gap: Unknown domain ' || q || domain || q WHEN scoped AND len(sides) = 0 THEN 'Geometry v2 requires geometry_scope' WHEN scoped AND problem IS NOT NULL THEN problem
      WHEN NOT scoped AND missing IS NOT NULL THEN 'Schema Gap: Geometry entity ' || q || missing || q || ' not defined in ' || q || domain || q WHEN tolerance <> '' AND NOT list_contains(objects, tolerance) THEN 'Schema Gap: Tolerance object ' || q || tolerance || q || ' not defined' END AS error FROM m""")
def schema_consistency(spark, sf_dir):
    objects = F.create_map(*[x for d, o in OBJECTS.items() for x in (F.lit(d), F.array(*map(F.lit, o)).cast("array<string>"))])
    rows = corpus.frame(table(spark, sf_dir, "part"), corpus.CHECKS)
    sides = F.filter(F.array("side_a", "side_b"), lambda x: x != "")
    return rows.select("rid", formal.schema_problem(F.col("domain"), objects, sides, F.col("tolerance"), F.col("scoped")).alias("error"))


@query(f"""WITH e AS (SELECT rid, equation, chr(39) AS q, regexp_extract_all(equation, '\\.(\\w+)\\.', 1) AS c, template = 2 AS deferred FROM {corpus.values(corpus.PASCAL)})
    SELECT rid, deferred OR len(c) = 0 AS is_valid, CASE WHEN deferred THEN '' WHEN len(c) > 0 THEN 'seen; Illegal chained attributes detected: [' || q || array_to_string(c, ''', ''') || q || ']' ELSE 'seen' END AS issues FROM e""")
def self_validation(spark, sf_dir):
    answer = F.lit('```json\n{"is_valid": true, "issues": ["seen"]}\n```')
    rows = corpus.frame(table(spark, sf_dir, "part"), corpus.PASCAL).select("rid", formal.self_validated(F.when(F.col("template") == 2, "Deferred").otherwise("Success"), F.col("equation"), answer).alias("v"))
    return rows.select("rid", "v.is_valid", F.array_join("v.issues", "; ").alias("issues"))


DOMAIN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(re.escape(w).replace(chr(92) + ' ', ' ').replace(chr(92) + '-', '-') for w in ws)}') THEN '{d}'" for d, ws in lexicon.DOMAIN_KEYWORDS.items()) + " ELSE 'General' END"


@query(f"SELECT 'rule' AS kind, rid AS id, {DOMAIN_SQL} AS domain FROM {DATA_RULES_SQL} UNION ALL SELECT 'document', doc_id, {DOMAIN_SQL} FROM documents")
def domain_resolution(spark, sf_dir):
    own = corpus.rules(data_rules(spark, sf_dir)).select(F.lit("rule").alias("kind"), F.col("rid").cast("long").alias("id"), formal.domain_of(F.col("text")).alias("domain"))
    return own.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), formal.domain_of(F.col("text")).alias("domain")))


ENTITY_SQL = "CASE " + " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in lexicon.ENTITIES.items()) + " " + " ".join(f"WHEN contains(x, '{k}') THEN '{lexicon.ENTITIES[k]}'" for k in sorted(lexicon.ENTITIES, key=len, reverse=True)) + " END"


@query(f"SELECT rid, {ENTITY_SQL} AS entity FROM (SELECT rid, lower({sql_strip('raw')}) AS x FROM {corpus.values(corpus.NAMES)})")
def entity_normalize(spark, sf_dir):
    return corpus.frame(table(spark, sf_dir, "part"), corpus.NAMES).select("rid", formal.entity(F.col("raw")).alias("entity"))


@query(f"SELECT e.rid, split_part(equation, '.', 1) AS root FROM {corpus.values(corpus.EQUATIONS)} e WHERE split_part(equation, '.', 1) NOT IN ('Bend', 'Hole', 'Pocket', 'Groove')")
def schema_violations(spark, sf_dir):
    known = spark.createDataFrame([("Bend",), ("Hole",), ("Pocket",), ("Groove",)], "root string")
    return corpus.frame(table(spark, sf_dir, "part"), corpus.EQUATIONS).select("rid", F.substring_index("equation", ".", 1).alias("root")).join(F.broadcast(known), "root", "left_anti").select("rid", "root")


@query(f"""WITH e AS (SELECT rid, regexp_replace({sql_strip("replace(replace(expression, '```python', ''), '```', '')")}, '^"+|"+$', '', 'g') AS e FROM {corpus.values(corpus.EXPRESSIONS)})
    SELECT rid, CASE WHEN e LIKE 'Tolerance(%' THEN 'Bilateral' WHEN e LIKE 'Limits(%' THEN 'Limits' WHEN e LIKE 'Max(%' OR e LIKE 'Min(%' THEN 'SingleLimit'
      WHEN e LIKE 'GDT(%' AND regexp_extract(e, '^GDT\\s*\\(\\s*([A-Za-z]+)', 1) IN ({', '.join(repr(g) for g in lexicon.GDT_TYPES)}) THEN 'GDT' END AS type FROM e""")
def tolerance_types(spark, sf_dir):
    return corpus.frame(table(spark, sf_dir, "part"), corpus.EXPRESSIONS).select("rid", formal.tolerance_type(F.col("expression"))["type"].alias("type"))


DOTTED = r"\b[a-zA-Z_]\w*\.[a-zA-Z_]\w*\b"


@query(f"""WITH n AS (SELECT rid, regexp_extract_all(equation, '{DOTTED}') AS names, string_split_regex(equation, '{DOTTED}') AS gaps FROM {corpus.values(corpus.PASCAL)}),
    u AS (SELECT rid, gaps, list_transform(names, lambda x: CASE WHEN lower(split_part(x, '.', 1)) = 'moduleparams' THEN 'ModuleParams' ELSE upper(left(x, 1)) || substr(split_part(x, '.', 1), 2) END || '.' || upper(left(split_part(x, '.', 2), 1)) || substr(split_part(x, '.', 2), 2)) AS names FROM n)
    SELECT rid, array_to_string([gaps[i] || coalesce(names[i], '') FOR i IN range(1, len(gaps) + 1)], '') AS equation FROM u""")
def pascal_case(spark, sf_dir):
    return corpus.frame(table(spark, sf_dir, "part"), corpus.PASCAL).select("rid", formal.pascal_case(F.col("equation")).alias("equation"))


OPERATORS = r"(>=|<=|==|!=|\bbetween\b|\bin\b|>|<)"
SPLIT_SQL = f"""q AS (SELECT *, nullif(regexp_extract(equation, '{OPERATORS}', 1), '') AS op, length(regexp_extract(equation, '(?s)^(.*?)(?:>=|<=|==|!=|\\bbetween\\b|\\bin\\b|>|<)', 1)) AS pos FROM {corpus.values(corpus.EQUATIONS)}),
    p AS (SELECT rid, domain, op, CASE WHEN op IS NOT NULL THEN trim(left(equation, pos)) END AS lhs, CASE WHEN op IS NOT NULL THEN trim(substr(equation, pos + length(op) + 1)) END AS rhs FROM q)"""


@query(f"WITH {SPLIT_SQL} SELECT rid, lhs, op, rhs FROM p")
def split_equation(spark, sf_dir):
    return corpus.frame(table(spark, sf_dir, "part"), corpus.EQUATIONS).select("rid", formal.split_equation(F.col("equation")).alias("p")).select("rid", "p.*")


CONFIG_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[0]}', '{v[1]}', {list(v[2]) if v[2] else 'CAST([] AS VARCHAR[])'})" for k, v in lexicon.DOMAIN_CONFIG.items()) + ") c(key, category_name, thick, aliases))"
ALGEBRA_SQL = f"""{SPLIT_SQL}, d AS (SELECT p.*, c.* FROM p JOIN {CONFIG_SQL} c ON c.key = CASE WHEN lower(domain) IN ({', '.join(repr(k) for k in lexicon.DOMAIN_CONFIG)}) THEN lower(domain) ELSE 'general' END),
    s AS (SELECT *, list_reduce(list_prepend(lhs, aliases), lambda a, x: replace(a, x, thick)) AS l0, list_reduce(list_prepend(rhs, aliases), lambda a, x: replace(a, x, thick)) AS r0 FROM d WHERE op IS NOT NULL),
    u AS (SELECT *, replace(replace(l0, 'Distance(Hole, Hole)', 'Distance.MinValue'), 'Distance(', 'Distance.MinValue') AS l, replace(replace(r0, 'Distance(Hole, Hole)', 'Distance.MinValue'), 'Distance(', 'Distance.MinValue') AS r FROM s),
    k AS (SELECT *, replace(r, thick, '¤') AS t FROM u),
    m AS (SELECT *, coalesce(nullif(regexp_extract(t, '(\\d+\\.?\\d*)\\s*\\*\\s*¤', 1), ''), nullif(regexp_extract(t, '¤\\s*\\*\\s*(\\d+\\.?\\d*)', 1), '')) AS n, trim(regexp_replace(t, '(\\d+\\.?\\d*)\\s*\\*\\s*¤|¤\\s*\\*\\s*(\\d+\\.?\\d*)', '', 'g')) AS rest, contains(lower(r), 'max(') OR contains(lower(r), 'min(') AS kept FROM k),
    z AS (SELECT *, n IS NOT NULL AND NOT kept AND (rest = '' OR rest LIKE '+%' OR rest LIKE '-%') AS turned FROM m)"""


@query(f"""WITH {ALGEBRA_SQL} SELECT rid, op,
    CASE WHEN NOT turned THEN l WHEN rest = '' THEN l || '/' || thick WHEN rest LIKE '+%' THEN '(' || l || ' - ' || trim(rest, '+ ') || ')/' || thick ELSE '(' || l || ' + ' || trim(rest, '- ') || ')/' || thick END AS exp_name,
    CASE WHEN turned THEN CAST(n AS DOUBLE) WHEN NOT kept AND n IS NULL THEN TRY_CAST(r AS DOUBLE) END AS recom_num FROM z""")
def algebra_normalize(spark, sf_dir):
    rows = formal.with_domain(corpus.frame(table(spark, sf_dir, "part"), corpus.EQUATIONS)).withColumn("p", formal.split_equation(F.col("equation"))).where(F.col("p.op").isNotNull())
    return rows.select("rid", formal.algebra(F.col("p.lhs"), F.col("p.op"), F.col("p.rhs"), F.col("thick"), F.col("aliases")).alias("a")).select("rid", "a.op", "a.exp_name", "a.recom_num")


@query(f"""WITH {ALGEBRA_SQL}, a AS (SELECT rid, category_name, lhs, op, turned, thick, rest, l, r, kept, n FROM z
      UNION ALL SELECT rid, category_name, equation, NULL, FALSE, thick, '', equation, '', TRUE, NULL FROM {corpus.values(corpus.EQUATIONS)} e JOIN {CONFIG_SQL} c ON c.key = lower(domain) WHERE equation LIKE 'Tolerance(%'),
    b AS (SELECT a.*, equation, 'Rule that the value ' || equation AS rule_text, equation LIKE 'Tolerance(%' AS tol FROM a JOIN {corpus.values(corpus.EQUATIONS)} e USING (rid)),
    w AS (SELECT *, (list_filter(string_split(regexp_replace(rule_text, '[^a-zA-Z0-9 ]', '', 'g'), ' '), lambda x: x <> ''))[1:7] AS ws, CASE WHEN contains(lhs, '.') THEN split_part(lhs, '.', 1) END AS root,
      CASE WHEN tol THEN NULL WHEN turned THEN CAST(n AS DOUBLE) WHEN NOT kept AND n IS NULL THEN TRY_CAST(r AS DOUBLE) END AS recom_num FROM b)
    SELECT rid, rule_text, category_name AS rule_category, array_to_string(list_transform(ws, lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS name,
      CASE WHEN tol THEN 'Tolerance' ELSE coalesce(root, 'Attribute') END AS feature1, CASE WHEN tol THEN 'Tolerance' ELSE coalesce(root, '') END AS object1, '' AS object2,
      CASE WHEN tol THEN equation WHEN NOT turned THEN l WHEN rest = '' THEN l || '/' || thick WHEN rest LIKE '+%' THEN '(' || l || ' - ' || trim(rest, '+ ') || ')/' || thick ELSE '(' || l || ' + ' || trim(rest, '- ') || ')/' || thick END AS exp_name,
      CASE WHEN tol THEN 'True' ELSE op END AS operator, recom_num, CASE WHEN tol THEN 'true' WHEN recom_num IS NULL THEN r END AS recom_text FROM w""")
def canonical_rules(spark, sf_dir):
    rows = corpus.frame(table(spark, sf_dir, "part"), corpus.EQUATIONS).select("rid", F.concat(F.lit("Rule that the value "), "equation").alias("rule_text"), F.lit("Success").alias("status"), "domain", F.lit(None).cast("string").alias("geometry_json"), "equation", F.lit(None).cast("string").alias("ast"))
    return formal.canonical_rules(rows)


@query("""SELECT p_partkey, p_size >= 25 AS rule_1, 0.5 * p_retailprice < greatest(p_size * 10 + 200.5, 460) AS rule_2, p_size <> 7 AND least(p_size, 30) - 1 <= p_retailprice / 40 AS rule_3,
    p_size = 3 OR (p_retailprice - 900) * 2 > 150.25 AS rule_4 FROM part""")
def ast_eval_parts(spark, sf_dir):
    known = {"Part.Size": F.col("p_size").cast("double"), "Part.Price": F.col("p_retailprice")}
    return table(spark, sf_dir, "part").select("p_partkey", *[expressions.compiled(expressions.parse(x), known).alias(f"rule_{i}") for i, x in corpus.TREES.items()])


TERMS_SQL = r"""t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
    tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term), n AS (SELECT count(*) AS n FROM documents)"""
TFIDF_SQL = TERMS_SQL + """, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w0 AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n WHERE {bound}),
    w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w0)"""


@query("WITH " + TFIDF_SQL.replace("{bound}", "df BETWEEN 2 AND 200") + " SELECT id, term, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark, sf_dir):
    return retrieval.tfidf(table(spark, sf_dir, "documents"), min_df=2, max_df=200).withColumn("weight", F.round("weight", 6))


@query("WITH " + TFIDF_SQL.replace("{bound}", "TRUE") + " SELECT id, term, round(weight, 6) AS weight FROM w")
def tfidf_weights_all(spark, sf_dir):
    """As tfidf_weights over all terms, whose weights so do not depend on a bound in documents."""
    return retrieval.tfidf(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


KNOWN_SQL = TFIDF_SQL.replace("df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)", "df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000)").replace("{bound}", "TRUE")


@query("WITH " + KNOWN_SQL + """, q0 AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS q FROM df, n WHERE term IN ('license', 'token', 'apache')), q AS (SELECT term, q / sqrt(sum(q * q) OVER ()) AS q FROM q0)
    SELECT id, round(sum(weight * q), 6) AS score FROM w JOIN q USING (term) GROUP BY id HAVING sum(weight * q) > 0.1 ORDER BY sum(weight * q) DESC, id LIMIT 10""")
def keyword_search(spark, sf_dir):
    return retrieval.keyword_search(table(spark, sf_dir, "documents"), "license token apache", 10, grams=(1, 1), stop=()).withColumn("score", F.round("score", 6))


STOP_SQL = ", ".join(f"'{w}'" for w in lexicon.ENGLISH)
#: 1- to 3-grams of the words left after the stop words, the 5,000 most frequent.
GRAMS_SQL = f"""w0 AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({STOP_SQL})) AS w FROM documents),
    t AS (SELECT id, unnest(list_concat(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS term FROM w0),
    tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term), n AS (SELECT count(*) AS n FROM documents),
    df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000),
    w1 AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
    w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w1)"""
ASKED = {"license": "the license of the token and of apache license files", "words": "of reat and tion the erst"}


def asked_sql(query: str) -> str:
    w = [x for x in re.findall(r"\w{2,}", query.lower()) if x not in lexicon.ENGLISH]
    grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    rows = ", ".join(f"('{g}', {grams.count(g)})" for g in dict.fromkeys(grams))
    return f"a AS (SELECT * FROM (VALUES {rows}) v(term, c)), q0 AS (SELECT term, c * (ln((1 + n) / (1 + df)) + 1) AS q FROM df JOIN a USING (term), n), q AS (SELECT term, q / sqrt(sum(q * q) OVER ()) AS q FROM q0)"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {GRAMS_SQL}, {asked_sql(text)} SELECT '{name}' AS query, id, round(sum(weight * q), 6) AS score FROM w JOIN q USING (term) GROUP BY id HAVING sum(weight * q) > 0.1 ORDER BY sum(weight * q) DESC, id LIMIT 10)" for name, text in ASKED.items()))
def keyword_index(spark, sf_dir):
    """Two searches of one stored index: 1- to 3-grams, English stop words, 5,000 features."""
    index, out = inverted.InvertedIndex.write(table(spark, sf_dir, "documents"), new_folder(spark, "index")), None
    for name, text in ASKED.items():
        found = index.search(text, 10).select(F.lit(name).alias("query"), "id", F.round("score", 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


HYBRID_SQL = KNOWN_SQL + """, q0 AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS q FROM df, n WHERE term IN ('license', 'token', 'apache')), q AS (SELECT term, q / sqrt(sum(q * q) OVER ()) AS q FROM q0),
    kw AS (SELECT id, sum(weight * q) AS score FROM w JOIN q USING (term) GROUP BY id HAVING sum(weight * q) > 0.1 ORDER BY score DESC, id LIMIT 10)"""
QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]
COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QUERY})"


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
    SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.vector_search_many(rows, rows.where("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 6))


@query(ORACLES["vector_topk"])
def vector_topk_cells(spark, sf_dir):
    """vector_topk by a stored index of cells; the queries that its probes may leave open go on to the cells that could hold more."""
    rows = table(spark, sf_dir, "embeddings")
    index = cells.CellIndex.write(rows, new_folder(spark, "cells"))
    return index.search(rows.where("vec_id % 20 = 0"), 10, exact=True).withColumn("score", F.round("score", 6))


@query()
def vector_recall(spark, sf_dir):
    """What the index finds of the true top 10 of every twentieth vector with the probes that it measured on others."""
    rows = table(spark, sf_dir, "embeddings")
    asked, index = rows.where("vec_id % 20 = 0"), cells.CellIndex.write(rows, new_folder(spark, "cells"))
    found, truth = index.search(asked, 10, index.tuned(10, 0.93)), retrieval.vector_search_many(rows, asked, 10)
    hit = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count(F.lit(1)), 3).alias("recall"))


@query(f"SELECT vec_id AS id, round({COSINE}, 6) AS score FROM embeddings WHERE label >= 5 AND {COSINE} >= 0.05 ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def vector_filtered(spark, sf_dir):
    return retrieval.vector_search(table(spark, sf_dir, "embeddings"), QUERY, 10, 0.05, {"label": 5}).withColumn("score", F.round("score", 6))


@query(f"""WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COSINE} DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 20),
    b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COSINE} DESC, vec_id) AS rank FROM embeddings WHERE label >= 5 QUALIFY rank <= 20)
    SELECT id, round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY sum(1 / (60 + rank)) DESC, id LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.fused(retrieval.vector_search(rows, QUERY, 20), retrieval.vector_search(rows, QUERY, 20, where={"label": 5}), k=10).withColumn("score", F.round("score", 8))


@query("WITH " + HYBRID_SQL + f""", sv AS (SELECT doc_id AS id, {COSINE} AS score FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
    v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sv WHERE score >= 0 QUALIFY rank <= 10), k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM kw),
    f AS (SELECT text, min(id) AS id, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM k) JOIN documents ON doc_id = id GROUP BY text)
    SELECT id, md5(text) AS text_md5, round(score, 8) AS score FROM f ORDER BY f.score DESC, id LIMIT 10""")
def hybrid_search(spark, sf_dir):
    return retrieval.similarity_search(described(spark, sf_dir), "license token apache", QUERY, 10, rerank=False, grams=(1, 1), stop=()).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("score", 8).alias("score"))


@query()
def similarity_search(spark, sf_dir):
    return retrieval.similarity_search(described(spark, sf_dir), "license token apache", QUERY, 5, grams=(1, 1)).select("id", F.round("score", 6).alias("score"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, embedding) of every document; vectors are dealt to documents by turns, as there are fewer."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    n = F.broadcast(vectors.select(F.count(F.lit(1)).alias("n")))  # one row
    turn = docs.crossJoin(n).select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % F.col("n")).alias("vec_id"))
    return turn.join(vectors.select("vec_id", "embedding"), "vec_id").select("id", "text", "embedding")


@query(f"""WITH s AS (SELECT vec_id AS id, label, 'v' || vec_id AS text, {COSINE} AS score FROM embeddings), h AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 5),
    o AS (SELECT h.id, o.text, row_number() OVER (PARTITION BY h.id ORDER BY o.score DESC, o.id) AS n FROM h JOIN s o ON o.label = h.label AND o.id <> h.id AND o.score > 0.1),
    g AS (SELECT id, string_agg(text, ' ... ' ORDER BY n) AS more, count(*) AS n FROM o WHERE n < 3 GROUP BY id)
    SELECT id, text || coalesce(' ... ' || more, '') AS context, CAST(coalesce(n, 0) AS INT) AS context_size FROM h LEFT JOIN g USING (id)""")
def context_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    scored = rows.select(F.col("vec_id").alias("id"), "label", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), (retrieval.dot(F.col("embedding"), F.array(*map(F.lit, QUERY))) / (F.sqrt(retrieval.dot(F.col("embedding"), F.col("embedding"))) * sum(x * x for x in QUERY) ** 0.5)).alias("score"))
    hits = scored.orderBy(F.desc("score"), "id").limit(5)
    return retrieval.with_context(hits, scored, "label", most=3, least=0.1).select("id", "context", "context_size")


RULE_PHRASES = f"""w AS (SELECT rid AS id, list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda x: x <> '') AS w FROM (SELECT p_partkey AS rid, p_name || ' of the ' || p_type || ' line with ' || p_name || ' from ' || p_brand AS text FROM part)),
    g AS (SELECT id, unnest(list_concat([w[i:i] FOR i IN range(1, len(w) + 1)], [w[i : i + 1] FOR i IN range(1, len(w))], [w[i : i + 2] FOR i IN range(1, len(w) - 1)])) AS p FROM w),
    ph AS (SELECT DISTINCT id, array_to_string(p, ' ') AS phrase, list_distinct(p) AS ws FROM g WHERE len(list_filter(p, lambda x: list_contains({lexicon.STOPWORDS}, x))) / len(p) <= 0.5 AND length(array_to_string(p, ' ')) > 2)"""


@query(f"""WITH {RULE_PHRASES} SELECT a.id, a.phrase AS src, b.phrase AS dst, round(len(list_intersect(a.ws, b.ws)) + len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), len(b.ws)), 6) AS weight
    FROM ph a JOIN ph b ON a.id = b.id AND a.phrase < b.phrase AND len(list_intersect(a.ws, b.ws)) > 0""")
def phrase_graph(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", F.lit("of the"), "p_type", F.lit("line with"), "p_name", F.lit("from"), "p_brand")
    return retrieval.graph_of_texts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rid"), text.alias("text")), "rid").withColumn("weight", F.round("weight", 6))


@query()
def textrank(spark, sf_dir):
    """Of every chunk of documents, id being document:chunk; a chunk's hundred words bound its graph."""
    chunks = data_windows(spark, sf_dir).select(F.concat_ws(":", "doc_id", "chunk_index").alias("id"), "chunk")
    return retrieval.rank_of_texts(chunks, 100, id_col="id", text_col="chunk").withColumn("score", F.round("score", 6))


@query(f"""WITH m AS (SELECT doc_id, len({WORDS}) AS word_count, {sql_count('lower(text)', lexicon.DATA_TERMS)} / greatest(len({WORDS}), 1) AS density FROM documents), f AS (SELECT * FROM m ORDER BY doc_id LIMIT 100)
    SELECT (SELECT count(*) FROM m) AS total, round(avg(density), 6) AS mean_density, round(avg(word_count), 6) AS mean_words, round(avg(CAST(density > 0.1 AS DOUBLE)), 6) AS dense_share FROM f""")
def collection_stats(spark, sf_dir):
    rows = retrieval.collection_stats(candidates.document_metadata(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon.DATA_TERMS))
    return rows.select("total", *[F.round(c, 6).alias(c) for c in ("mean_density", "mean_words", "dense_share")])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.n_chars END AS n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def keyed_upserts(spark, sf_dir):
    """batch_upsert by two batches of a keyed table: all documents, and then the labels, which take the place of theirs."""
    out = KeyedTable(spark, new_folder(spark, "keyed"), "doc_id", parts=8)
    out.upsert(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 0)
    out.upsert(table(spark, sf_dir, "labels").select("doc_id", "quality"), 1)
    return out.rows().select("doc_id", "n_chars", "quality")


@query("SELECT md5(lower(coalesce(text, ''))) AS path, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def resumed_documents(spark, sf_dir):
    """Documents as a stream, each text taken once: by a table of what is done in place of endless state."""
    rows = table(spark, sf_dir, "documents").select(F.md5(F.lower(F.coalesce("text", F.lit(""))).cast("binary")).alias("path"), "doc_id")
    source, mark = new_folder(spark, "arrivals"), new_folder(spark, "resume-mark")
    rows.write.parquet(source)
    out, seen = (KeyedTable(spark, new_folder(spark, n), parts=8) for n in ("resumed", "seen"))
    resuming(arriving(spark, source, "path string, doc_id long"), lambda new: new, out, seen, mark).awaitTermination()
    return out.rows().select("path", "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.n_chars END AS n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def batch_upsert(spark, sf_dir):
    return upserted(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT event_type, CAST(sum(CAST(props->>'$.k' AS INT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    k = F.get_json_object(t.braces(F.col("props")), "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from dolomite.streaming.incremental import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query()
def extract_fast(spark, sf_dir):
    return pipelines.extract(table(spark, sf_dir, "documents"), settings=pipelines.Settings(window=260, overlap=26))[1]


@query()
def extract_enhanced(spark, sf_dir):
    found, _ = pipelines.extract(table(spark, sf_dir, "documents"), settings=pipelines.Settings(mode="enhanced"))
    return found.select("doc_id", "chunk_index", "rule_index", "rule_text", "rule_type", "confidence")


@query()
def formalise_rules(spark, sf_dir):
    return pipelines.formalise(corpus.rules(data_rules(spark, sf_dir)).select("rid", F.col("text").alias("rule_text")))


@query()
def post_processed(spark, sf_dir):
    rules = data_rules(spark, sf_dir).withColumn("relevance", F.lit(0.45))
    return pipelines.post_process(rules, most=50)[1]

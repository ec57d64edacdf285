"""Whole runs: extraction over documents, and formalisation of rules. What a model answered is written before a plan branches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions import formal, rules as r
from dolomite.functions.text import count_terms, reading_ease, strip, unused, word_count
from dolomite.operators import candidates, chunking, postprocess, reports, retrieval
from dolomite.operators.provider import Offline, Provider, asked, parsed_rules
from dolomite.operators.provider import raw_rules as raw_from
from dolomite.sources.writers import materialised


@dataclass(frozen=True)
class Settings:
    window: int = 3200
    overlap: int = 200
    least_chars: int = 64
    rules_per_chunk: int = 20
    rules_per_document: int = 150
    chunk_tokens: int = 800
    chunks_per_document: int = 60
    faithful: bool = False
    mode: str = "fast"  # enhanced, or raw
    least_confidence: float = 0.3
    least_relevance: float = 0.2

    def problems(self) -> list[str]:
        """What is out of range; empty if nothing is."""
        shares = [f"{k} is not between 0 and 1" for k in ("least_confidence", "least_relevance") if not 0.0 <= getattr(self, k) <= 1.0]
        return shares + [f"{k} is under 1" for k in ("window", "rules_per_chunk", "rules_per_document", "chunk_tokens", "chunks_per_document") if getattr(self, k) < 1]

    def recalling(self) -> Settings:
        """For recall: raw rules, lower thresholds, 80 chunks of a document at least."""
        return replace(self, mode="raw", least_confidence=min(self.least_confidence, 0.1), least_relevance=min(self.least_relevance, 0.05), chunks_per_document=max(self.chunks_per_document, 80))


PRECISION = Settings(chunks_per_document=25, rules_per_document=150)
RECALL = Settings(chunks_per_document=120, rules_per_document=500)


def extract(docs: DataFrame, provider: Provider | None = None, settings: Settings = Settings(), doc_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rules, summary). Short texts give no rules and the status insufficient_text. Answers are written once, before both read them.

    fast: windows, dedupe by key (first wins), capped. enhanced: sentence chunks, thinned, rules as they come. raw: the same chunks,
    rules only listed.
    """
    if problems := settings.problems():
        raise ValueError("; ".join(problems))
    provider = provider or Offline(settings.rules_per_chunk)
    own = docs.select(doc_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    enough = own.where(F.length(strip(F.col("text"))) >= settings.least_chars)
    if settings.mode != "fast":
        chunks = chunking.sentence_chunks(enough, settings.chunk_tokens, terms=lexicon.PRIORITY_TERMS).select(doc_col, "chunk_index", "chunk")
        chunks = chunking.thinned(materialised(chunks, "chunks"), settings.chunks_per_document, doc_col)  # counted, and read
    else:
        chunks = chunking.word_windows(enough, settings.window, settings.overlap)
    if settings.mode == "raw":
        found = raw_rules(chunks.select(doc_col, "chunk_index", "chunk"), provider)
    else:
        answers = asked(chunks.select(doc_col, "chunk_index", "chunk"), provider, "extract", "chunk").drop("chunk")
        found = parsed_rules(materialised(answers, "answers"), settings.rules_per_chunk)
    if settings.mode == "fast":
        key = r.dedupe_key(F.col("intent"), F.col("scope"), F.col("applicability"), F.col("constraints"), F.col("rule_text"), F.col("category"), F.col("rule_type"), settings.faithful)
        found = postprocess.first_of_each(found, key, ["chunk_index", "rule_index"], (doc_col,))
        found = postprocess.capped(found, settings.rules_per_document, [F.col("chunk_index"), F.col("rule_index")], doc_col)
    summary = reports.document_summary(own.select(doc_col, F.length(strip(F.col("text"))).alias("n")), found, doc_col=doc_col)
    status = F.when(F.col("n") < settings.least_chars, "insufficient_text").otherwise(F.col("status"))
    return found, summary.withColumn("status", status).drop("n")


def extract_validated(docs: DataFrame, provider: Provider | None = None, settings: Settings = Settings(), **names: str) -> tuple[DataFrame, DataFrame]:
    found, summary = extract(docs, provider, settings, **names)
    text = F.coalesce(F.col("constraints_text"), F.when(F.size("constraints") > 0, F.to_json("constraints")))
    (own,) = unused(found, "own_constraints")
    return r.validated(found.withColumn(own, text), own).drop(own), summary


def raw_rules(chunks: DataFrame, provider: Provider, terms: Sequence[str] = lexicon.CHUNK_TERMS) -> DataFrame:
    """Rules listed from the chunks worth reading, with complexity: terms of the chunk to words of the rule."""
    gated = chunks.where(candidates.is_high_value(F.col("chunk"))).withColumn("n_terms", count_terms(F.col("chunk"), terms))
    rows = raw_from(materialised(asked(gated, provider, "bulk", "chunk"), "raw-answers"))
    return rows.withColumn("complexity", F.col("n_terms") / F.greatest(word_count(F.col("rule_text")), F.lit(1))).drop("chunk", "n_terms")


def single_rules(chunks: DataFrame, provider: Provider, retries: int = 2, similar: Column | None = None, terms: Sequence[str] = lexicon.CHUNK_TERMS, recall: bool = False) -> DataFrame:
    """One rule of each chunk worth reading; one that is not acceptable is enhanced, up to `retries` times, and kept as it is then.

    similar: up to two texts of similar rules that go along with an enhancement (array), each cut at 100 characters. complexity: terms
    of the chunk to its words. extraction_method: structured, with "enhanced_" before it for each enhancement that was answered.
    """
    keys = [c for c in chunks.columns if c != "chunk"]
    (row,) = unused(chunks, "row")
    gate = candidates.is_high_value(F.col("chunk"), recall=recall)
    rows = parsed_rules(materialised(asked(chunks.where(gate), provider, "single", "chunk"), "single-answers"), 1)
    rows = rows.select(*keys, "chunk", "rule_text", "rule_type", "confidence", F.lit(0.5).alias("relevance"), F.lit("structured").alias("extraction_method"))
    # Numbered and written: chunks may share their keys, or have none.
    rows = materialised(rows.withColumn(row, F.monotonically_increasing_id()), "rules-numbered")
    good = candidates.is_acceptable(F.col("rule_text"), F.col("confidence"), F.col("relevance"), recall=recall)
    done = rows.where(good)
    left = rows.where(~good)
    more = F.lit("") if similar is None else F.concat(F.lit("\n"), F.array_join(F.transform(F.slice(similar, 1, 2), lambda x: F.substring(x, 1, 100)), "\n"))
    for turn in range(retries):
        (ask,) = unused(left, "ask")
        answered = materialised(asked(left.withColumn(ask, F.concat("rule_text", more)), provider, "enhance", ask), f"enhanced-{turn}").drop(ask)
        one = parsed_rules(answered.where("answer is not null").select(row, *keys, "answer", "chunk", F.col("extraction_method").alias("before")), 1)
        better = one.select(row, *keys, "chunk", "rule_text", "rule_type", "confidence", F.lit(0.5).alias("relevance"), F.concat(F.lit("enhanced_"), "before").alias("extraction_method"))
        new = better.unionByName(answered.join(better.select(row), row, "left_anti").select(*better.columns))
        new = materialised(new, f"rules-{turn}")
        done, left = done.unionByName(new.where(good)), new.where(~good)
    every = done.unionByName(left)
    n = F.greatest(word_count(F.col("chunk")), F.lit(1))
    return every.withColumns({"readability": reading_ease(F.col("chunk")), "complexity": count_terms(F.col("chunk"), terms) / n}).drop("chunk", row)


def post_process(rules: DataFrame, most: int = 250, least: float = 0.3, least_relevance: float = 0.2, recall: bool = False, cluster: bool = False, stop: Sequence[str] = lexicon.ENGLISH) -> tuple[DataFrame, DataFrame]:
    """(rules, counts per document) of similarity dedup, quality filter, clustering within documents, and the cap by confidence.

    Each step marks rows; the marked table is written once, and rules and counts both read it. n_escalated counts the unique
    rules that a reviewer must see (where rules have a correctness_tag).
    """
    of, keys = unused(rules, "unique", "good", "clustered", "rank"), ["doc_id", "rule_index"]
    unique, good, clustered, rank = of
    rules = materialised(rules, "rules")  # read for the leaders and again for the marks
    lead = postprocess.similar_leaders(rules, threshold=0.9 if recall else 0.8, stop=stop)
    marked = rules.join(lead, keys).withColumn(unique, F.col("leader") == F.col("rule_index")).drop("leader")
    passes = F.lit(True) if recall else (F.col("confidence") >= least) & (F.col("relevance") >= least_relevance)
    marked = marked.withColumn(good, F.col(unique) & F.coalesce(passes, F.lit(False)))
    if cluster:
        marked = materialised(marked, "marked")
        kept = postprocess.cluster_best(marked.where(good).select(*keys, "rule_text", "confidence")).select(*keys, F.lit(True).alias(clustered))
        marked = marked.join(kept, keys, "left").withColumn(clustered, F.coalesce(clustered, F.lit(False)))
    else:
        marked = marked.withColumn(clustered, F.col(good))
    place = F.row_number().over(Window.partitionBy("doc_id", clustered).orderBy(F.desc("confidence"), "rule_index"))
    marked = materialised(marked.withColumn(rank, place), "post-processed")
    final = F.col(clustered) & (F.col(rank) <= most)
    counts = {"n_unique": F.col(unique), "n_good": F.col(good), "n_clustered": F.col(clustered), "n_final": final}
    if "correctness_tag" in rules.columns:
        counts["n_escalated"] = F.col(unique) & F.col("correctness_tag").isin("out_of_scope", "low_confidence")
    stats = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_raw"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return marked.where(final).select(*rules.columns), stats.withColumns({"max_rules": F.lit(most), "hit_cap": F.col("n_clustered") > most})


INTENT = "is_quantifiable boolean, rule_intent struct<type:string,requires_geometry:boolean,requires_tolerance:boolean>, geometry_relation struct<`from`:string,`to`:string>, attribute_constraint struct<entity:string,attribute:string>, mentioned_attributes array<string>, reasoning string"
# Attributes a part has by itself.
INTRINSIC = ["thickness", "radius", "diameter", "length", "width", "height", "depth", "angle"]


def formalise(rules: DataFrame, provider: Provider | None = None, faithful: bool = False) -> DataFrame:
    """rule_text, status, resolution_status, formalism, rule_json, equation, reasoning, error, domain of each rule that is not blank.

    Unreadable intents count as advisory. What cannot be quantified is Skipped. Quantifiable advisory rules are Deferred
    (faithful: left out).
    """
    provider = provider or Offline()
    intent, failed, parsed, category, go, job, answer, error, tol, attr, side_a, side_b, rhs = unused(rules, *"intent failed parsed category go job answer answer_error tol attr side_a side_b rhs".split())
    rows = asked(rules.where(strip(F.coalesce(F.col("rule_text"), F.lit(""))) != ""), provider, "intent", "rule_text", intent, failed)
    rows = rows.withColumn(parsed, F.from_json(intent, INTENT))
    kind = F.col(f"{parsed}.rule_intent")
    of = formal.category_of(kind["type"], kind["requires_geometry"], kind["requires_tolerance"])
    intrinsic = F.coalesce(F.exists(f"{parsed}.mentioned_attributes", lambda a: F.lower(a).isin(*INTRINSIC)), F.lit(False))
    of = F.when((of == "Geometry") & intrinsic, "Attribute").otherwise(of)
    rows = rows.withColumns({"domain": formal.domain_of(F.col("rule_text")), category: of, go: F.coalesce(F.col(f"{parsed}.is_quantifiable"), F.lit(False))})
    task = F.when(F.col(go), F.when(F.col(category) == "Geometry", "geometry").when(F.col(category) == "Tolerance", "tolerance").when(F.col(category) == "Attribute", "attribute"))
    # Written before the branch: a model is asked once for each rule's intent, and once for its one task.
    rows = materialised(rows.withColumn(job, task), "intents")
    done = asked(rows.where(F.col(job).isNotNull()), provider, None, "rule_text", answer, error, task_col=job)
    rest = rows.where(F.col(job).isNull()).withColumns({answer: F.lit(None).cast("string"), error: F.lit(None).cast("string")})
    if faithful:
        rest = rest.where(~F.col(go))
    rows = materialised(done.unionByName(rest), "formal-answers")
    a = formal.entity(F.col(f"{parsed}.geometry_relation.from"))
    b = F.coalesce(formal.entity(F.col(f"{parsed}.geometry_relation.to")), a)
    rows = rows.withColumns({tol: formal.tolerance_type(F.coalesce(F.col(answer), F.lit(""))), attr: formal.attribute_rule(F.col(answer)), side_a: a, side_b: b, rhs: formal.split_equation(F.coalesce(F.col(answer), F.lit("")))})
    geo_ok = F.col(side_a).isNotNull() & F.col(side_b).isNotNull() & (F.coalesce(F.col(answer), F.lit("")) != "")
    at = F.col(category)
    ok = F.when(at == "Geometry", geo_ok).when(at == "Tolerance", F.col(f"{tol}.error").isNull()).when(at == "Attribute", F.col(f"{attr}.formalism").isNotNull()).otherwise(F.lit(False))
    # The operator that the answer itself has; faithful: what the intent's type says, whatever the answer.
    meant = F.when(kind["type"] == "min", ">=").otherwise("<=")
    operator = meant if faithful else F.coalesce(F.col(f"{rhs}.op"), meant)
    value = F.col(answer) if faithful else F.coalesce(F.col(f"{rhs}.rhs"), F.col(answer))
    geometry = F.to_json(F.struct(F.lit("distance").alias("relation"), F.col(side_a).alias("from"), F.col(side_b).alias("to"), operator.alias("operator"), value.alias("rhs")))
    return rows.select(
        *rules.columns,
        F.when(~F.col(go), "Skipped").when(at == "Advisory", "Deferred").when(ok, "Success").otherwise("Review Needed").alias("status"),
        F.when(~F.col(go), "not_quantifiable").when(at == "Advisory", "deferred_advisory").when(ok, "resolved").otherwise("unresolved").alias("resolution_status"),
        F.when(ok, F.when(at == "Attribute", F.col(f"{attr}.formalism")).otherwise(at)).alias("formalism"),
        F.when(ok & (at == "Geometry"), geometry).alias("rule_json"),
        F.when(ok & (at == "Tolerance"), F.col(f"{tol}.equation")).when(ok & (at == "Attribute"), F.col(f"{attr}.equation")).alias("equation"),
        F.when(at == "Attribute", F.col(f"{attr}.reasoning")).otherwise(F.col(f"{parsed}.reasoning")).alias("reasoning"),
        F.coalesce(error, F.when(at == "Tolerance", F.col(f"{tol}.error")).when((at == "Geometry") & ~geo_ok, "Geometry entity could not be resolved")).alias("error"),
        "domain",
    )


def embedding_chunks(docs: DataFrame, size: int = 400, terms: Sequence[str] = lexicon.CHUNK_TERMS, doc_col: str = "doc_id", text_col: str = "text", keep: int = 5) -> DataFrame:
    """scored_chunks with features, original_text, and text as it is to be embedded: of low density behind its key phrases.

    Key phrases are the best of each chunk's own graph of phrases (retrieval.rank_of_texts).
    """
    rows = chunking.scored_chunks(docs, size, terms, text_col=text_col, id_col=doc_col)
    name, found = unused(rows, "chunk_name", "key_phrases")
    rows = materialised(rows.withColumn(name, F.struct(doc_col, "chunk_index").cast("string")), "chunks")
    low = rows.where(F.col("density") <= 0.1)
    ranked = retrieval.rank_of_texts(low, keep=keep, id_col=name, text_col="chunk")
    best = ranked.groupBy(F.col("id").alias(name)).agg(F.sort_array(F.collect_list(F.struct(F.col("score").alias("order"), "phrase", "score")), asc=False).alias(found))
    rows = rows.join(best, name, "left").withColumn(found, F.transform(F.coalesce(found, F.array().cast("array<struct<order:double,phrase:string,score:double>>")), lambda p: F.struct(p["phrase"].alias("phrase"), p["score"].alias("score"))))
    text = retrieval.optimised_text(F.col("chunk"), F.col("density"), F.col(found))
    return rows.withColumns({"original_text": F.col("chunk"), "features": candidates.features(F.col("chunk")), "optimised_text": text}).drop(name, found, "chunk")


Step = Callable[[DataFrame], DataFrame]


def orchestrated(docs: DataFrame, steps: Sequence[Step], export: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Steps (load, chunk, extract, ...) one after another, and the result handed to export."""
    for step in steps:
        docs = docs.transform(step)
    if export:
        export(docs)
    return docs


def with_mode(settings: Settings, mode: str, available: bool = True) -> Settings:
    """enhanced falls back to fast where it is not available."""
    return replace(settings, mode="enhanced" if mode == "enhanced" and available else "fast")


def batch_status(stats: str = "stats_status", aborted: str = "aborted", rules: str = "rule_count", payload: str = "status", error: str = "error"):
    """The status of a batch's document: its error, its own statistics', the rate limit's, the payload's, or unknown."""
    return F.when(F.col(error).isNotNull(), "failed").when(F.col(stats).isNotNull(), F.col(stats)).when(F.col(aborted), F.when(F.col(rules) > 0, "partial_rate_limited").otherwise("rate_limited")).otherwise(F.coalesce(F.col(payload), F.lit("unknown")))

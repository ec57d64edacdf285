"""Finding rule sentences and chunks worth reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions.text import count_terms, has_any, matched_terms, reading_ease, sentences, strip, unused, word_count

NUMBER = r"\b(\d+\.?\d*|\d*\.?\d+)\b"


def is_high_value(chunk: Column, terms: Sequence[str] = lexicon.PRIORITY_TERMS, process: Sequence[str] = lexicon.PROCESS_TERMS, recall: bool = False) -> Column:
    """Any term, number or modal, or a density of terms of 0.005; recall: more than ten characters."""
    if recall:
        return F.length(strip(chunk)) > 10
    found = count_terms(chunk, terms) + count_terms(chunk, process)
    return (found / F.greatest(word_count(chunk), F.lit(1)) >= 0.005) | chunk.rlike("[0-9]") | has_any(chunk, lexicon.MODALS) | (found > 0)


def is_acceptable(text: Column, score: Column, relevance: Column, least: float = 0.3, least_relevance: float = 0.2, recall: bool = False, terms: Sequence[str] = lexicon.PRIORITY_TERMS) -> Column:
    if recall:
        return (score >= max(0.05, least)) & (relevance >= max(0.05, least_relevance)) & (F.length(strip(text)) >= 8)
    cue = has_any(text, terms) | text.rlike("[0-9]") | has_any(text, lexicon.MODALS)
    return (score >= max(least, 0.3)) & (relevance >= max(least_relevance, 0.15)) & cue & (F.length(strip(text)) >= 15)


def rule_sentences(docs: DataFrame, terms: Sequence[str] = lexicon.PRIORITY_TERMS, units: Sequence[str] = lexicon.UNITS, text_col: str = "text") -> DataFrame:
    """docs (without their text) with sent_index and rule_text: sentences with a term, number, unit, shall or must.

    Scores are the heuristic's constants; complexity counts terms.
    """
    (one,) = unused(docs, "sentence")
    rows = docs.select("*", F.posexplode(sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("sent_index", one)).drop(text_col)
    s = strip(F.col(one))
    cue = has_any(F.col(one), [*terms, *units, "shall", "must"]) | F.col(one).rlike(NUMBER)
    return rows.where((s != "") & cue).select(
        *[c for c in rows.columns if c != one], F.substring(s, 1, 500).alias("rule_text"), F.lit(0.45).alias("confidence"), F.lit(0.45).alias("relevance"), count_terms(s, terms).alias("complexity"), reading_ease(s).alias("readability")
    )


def document_metadata(docs: DataFrame, terms: Sequence[str] = lexicon.GLOSSARY, text_col: str = "text") -> DataFrame:
    """docs without their text, with char_count, word_count, keywords, density and readability."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"char_count": F.length(text), "word_count": word_count(text), "keywords": matched_terms(text, terms), "readability": reading_ease(text)})
    return rows.withColumn("density", F.size("keywords") / F.greatest(F.col("word_count"), F.lit(1))).drop(text_col)


def features(text: Column) -> Column:
    """Keyword matches by category and their density."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def of(category: str, terms: Sequence[str]) -> Column:
        return F.transform(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)), lambda t: F.struct(t.alias("term"), F.lit(category).alias("category")))

    found = F.concat(*[of(c, terms) for c, terms in lexicon.FEATURE_KEYWORDS.items()])
    return F.struct(found.alias("matches"), (F.size(found) / F.greatest(word_count(low), F.lit(1))).alias("density"))


def document_context(docs: DataFrame, terms: Sequence[str], chars: int = 2000, text_col: str = "text") -> DataFrame:
    """Readability, words to a sentence and share of words that hold a term, of the text's first characters (the feature's own limit)."""
    head = F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, chars)
    n = word_count(head)
    hit = F.size(F.filter(F.split(F.lower(head), r"[ \t\n\r\x0b\x0c]+"), lambda w: (w != "") & has_any(w, terms)))
    return docs.select(*[c for c in docs.columns if c != text_col], reading_ease(head).alias("readability"), (n / (F.size(F.regexp_extract_all(head, F.lit("[.!?]"), F.lit(0))) + 1)).alias("sentence_length"), F.when(n > 0, hit / n).otherwise(0.0).alias("density"))

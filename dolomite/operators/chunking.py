"""Chunking: documents to rows of overlapping windows, or of whole sentences."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dolomite.functions.text import count_terms, sentences, strip, unused, word_count, words
from dolomite.sources.writers import materialised

Tokens = Callable[[Column], Column]


def windows(docs: DataFrame, window: int, overlap: int, tokens: Tokens = words, keep_tail: bool = False, text_col: str = "text") -> DataFrame:
    """docs with chunk_index and chunk: windows of tokens, one every window - overlap.

    The last window is the first to reach the end; keep_tail: windows go on from every start, overlap alone or not.
    """
    window = max(1, window)
    step = window - min(max(0, overlap), window - 1)
    tok, at = unused(docs, "tokens", "at")
    t = docs.withColumn(tok, tokens(F.coalesce(F.col(text_col), F.lit(""))))
    n = F.size(tok)
    last = n - 1 if keep_tail else F.greatest(F.lit(0), F.ceil((n - window) / step).cast("int") * step)
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = t.select("*", F.posexplode(starts).alias("chunk_index", at))
    return rows.withColumn("chunk", F.array_join(F.slice(tok, F.col(at) + 1, F.lit(window)), " ")).drop(tok, at)


def word_windows(docs: DataFrame, window: int = 3200, overlap: int = 200, text_col: str = "text") -> DataFrame:
    """Windows by words, of which 1.3 make a token; windows of overlap alone at the end are kept."""
    limit = max(1, int(window / 1.3))
    stride = max(1, limit - int(overlap / 1.3))
    return windows(docs, limit, limit - stride, keep_tail=True, text_col=text_col)


def token_windows(docs: DataFrame, window: int = 3200, overlap: int = 200, tokens: Tokens | None = None, text_col: str = "text") -> DataFrame:
    """Windows of tokens; texts for which the tokenizer gives none (null), or all without one, have word_windows.

    tokens: a column of a text's tokens, null where they can't be told.
    """
    if tokens is None:
        return word_windows(docs, window, overlap, text_col)
    (told,) = unused(docs, "told")
    rows = docs.withColumn(told, tokens(F.coalesce(F.col(text_col), F.lit(""))))
    good = windows(rows.where(F.col(told).isNotNull()), window, overlap, lambda _: F.col(told), text_col=text_col).drop(told)
    return good.unionByName(word_windows(rows.where(F.col(told).isNull()).drop(told), window, overlap, text_col))


def packed(counts: Column, hits: Column, size: int, overlap: bool) -> Column:
    """Array of (first, last, n, score): sentences packed while they fit. Only whole numbers go to Python, in Arrow batches."""

    @F.pandas_udf("array<struct<first:int,last:int,n:int,score:int>>")
    def fold(counts: pd.Series, hits: pd.Series) -> pd.Series:
        def one(c, h) -> list[dict]:
            out, start, n, score = [], 0, 0, 0
            c, h = c.tolist(), h.tolist()
            for i in range(len(c)):
                if i and n + c[i] > size:
                    out.append({"first": start, "last": i - 1, "n": n, "score": score})
                    start = max(start, i - 2) if overlap else i
                    n, score = sum(c[start : i + 1]), h[i]
                else:
                    n, score = n + c[i], score + h[i]
            return [*out, {"first": start, "last": len(c) - 1, "n": n, "score": score}] if c else []

        return pd.Series([one(c, h) for c, h in zip(counts, hits)])

    return fold(counts, hits)


def sentence_chunks(docs: DataFrame, size: int = 800, overlap: bool = True, terms: Sequence[str] = (), text_col: str = "text", count: Tokens = word_count) -> DataFrame:
    """docs with chunk_index, chunk, token_count, score and sentence_count.

    Sentences are packed while they fit; a full chunk is put out and the next begins with its last two sentences, whose tokens count
    again. score: terms found in the chunk's sentences, those carried over excepted. count: tokens of a sentence.
    """
    parts, place, part = unused(docs, "sentences", "place", "part")
    rows = docs.withColumn(parts, sentences(F.coalesce(F.col(text_col), F.lit(""))))
    # Lower-cased whole, once: within the lambda each term would lower its sentence again.
    low = sentences(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    hits = F.transform(low, lambda s: reduce(Column.__add__, [F.contains(s, F.lit(t)).cast("int") for t in terms], F.lit(0)))
    rows = rows.withColumn(place, packed(F.transform(parts, lambda s: count(s).cast("int")), hits, size, overlap))
    rows = rows.select("*", F.posexplode(place).alias("chunk_index", part))
    chunk = strip(F.array_join(F.slice(parts, F.col(f"{part}.first") + 1, F.col(f"{part}.last") - F.col(f"{part}.first") + 1), " "))
    rows = rows.withColumn("chunk", chunk).where((F.col("chunk") != "") | (F.col("chunk_index") < F.size(place) - 1))
    ends = F.size(F.regexp_extract_all("chunk", F.lit("[.!?]"), F.lit(0))) + 1
    return rows.select(*docs.columns, "chunk_index", "chunk", F.col(f"{part}.n").alias("token_count"), F.col(f"{part}.score").alias("score"), ends.alias("sentence_count"))


def scored_chunks(docs: DataFrame, size: int = 400, terms: Sequence[str] = (), faithful: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """As sentence_chunks, with density (terms to words, the best sentence's) and rank by it within the document (ties by place).

    faithful: a chunk after the first carries the document's last sentence over, not its predecessor's.
    """
    base = sentence_chunks(docs, size, overlap=False, terms=terms, text_col=text_col)
    dense = F.array_max(F.transform(sentences(F.col("chunk")), lambda s: count_terms(s, terms) / F.greatest(word_count(s), F.lit(1))))
    rows = base.withColumn("density", F.coalesce(dense, F.lit(0.0)))
    if faithful:
        tail = F.element_at(sentences(F.coalesce(F.col(text_col), F.lit(""))), -1)
        rows = rows.withColumn("chunk", F.when(F.col("chunk_index") > 0, F.concat_ws(" ", tail, "chunk")).otherwise(F.col("chunk")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("density"), "chunk_index")))


def thinned(chunks: DataFrame, most: int, doc_col: str = "doc_id", index_col: str = "chunk_index") -> DataFrame:
    """At most `most` chunks of a document, evenly over it: places round(i (n - 1) / (most - 1)), half to even.

    The documents of more chunks are written first: where they are few, or none, no chunk is shuffled.
    """
    if most < 2:
        return chunks.where(F.col(index_col) == 0)
    total, doc = unused(chunks, "total", "doc")
    large = chunks.groupBy(F.col(doc_col).alias(doc)).agg((F.max(index_col) + 1).alias(total)).where(F.col(total) > most)
    large = materialised(large, "documents-thinned")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col(total) - 1) / F.lit(most - 1)).cast("int"))
    rows = chunks.join(large, F.col(doc_col).eqNullSafe(F.col(doc)), "left")
    return rows.where(F.col(total).isNull() | F.array_contains(wanted, F.col(index_col))).select(*chunks.columns)

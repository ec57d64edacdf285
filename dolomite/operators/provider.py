"""Calls to language and embedding models, behind a small interface with an offline default."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions import rules as rule_columns
from dolomite.functions.text import canonical, json_part, reading_ease, strip, unused
from dolomite.sources.writers import materialised


class Provider(Protocol):
    def complete(self, task: str, text: str) -> str:
        """The answer to a text under a task (a key of prompts.REQUESTS)."""
        ...


@dataclass(frozen=True)
class Offline:
    """Answers from the text alone, the same each time: sentences with a number or a modal are rules."""

    most: int = 20

    def complete(self, task: str, text: str) -> str:
        if task == "extract":
            found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if re.search(r"\d|\b(must|shall|should)\b", s)]
            return json.dumps([{"rule_text": s, "rule_type": self.kind(s), "confidence": 0.8 if re.search(r"\d", s) else 0.6, "supporting_quote": s[:200]} for s in found[: self.most]])
        if task == "intent":
            number, tolerance = re.search(r"\d", text) is not None, re.search(r"±|toleranc|flatness|runout", text, re.I) is not None
            geometry = re.search(r"\b(distance|spacing|between|from the edge)\b", text, re.I) is not None
            return json.dumps({"is_quantifiable": number, "rule_intent": {"type": "min" if re.search(r"minimum|at least|>=", text, re.I) else "max" if number else "advisory", "requires_geometry": geometry, "requires_tolerance": tolerance}})
        if task == "classify":
            return rule_class(text)
        if task == "bulk":
            found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if re.search(r"\d|\b(must|shall|should)\b", s)]
            return json.dumps({"rules": [{"text": s, "confidence_score": 0.6} for s in found]})
        if task in ("single", "enhance"):
            best = max(re.split(r"(?<=[.!?])\s+", text), key=lambda s: (len(re.findall(r"\d|\b(?:must|shall|should)\b", s)), len(s)))
            return json.dumps({"rule_text": best.strip(), "rule_type": self.kind(best), "confidence": 0.8 if re.search(r"\d", best) else 0.5, "supporting_quote": best[:200]})
        if task == "validate":
            return json.dumps({"is_valid": True, "issues": []})
        if task == "normalise":
            return " ".join(text.split())
        number = re.search(r"\d+\.?\d*", text)
        name = re.search(r"[A-Z]\w*\.[A-Z]\w*", text)
        return f"{name[0]} {'>=' if re.search('minimum|at least', text, re.I) else '<='} {number[0]}" if number and name else "null"

    def kind(self, text: str) -> str:
        return "dimensional" if re.search(r"\d", text) else "quality"


def rule_class(text: str, title: str = "") -> str:
    """As functions.rules.rule_class, for one text."""
    for table, of in ((lexicon.CLASS_TITLES, title), (lexicon.CLASS_PROCESSES, text), (lexicon.CLASS_FEATURES, text), (lexicon.CLASS_GENERIC, text)):
        for name, words in table.items():
            if any(w in of.lower() for w in words):
                return name
    return "General"


def seconds_to_wait(message: str, default: float = 20.0) -> float:
    """Of "try again in 17m18s", and five more."""
    m = re.search(r"try again in (?:\d+h)?(?:(\d+)m)?(?:([0-9.]+)s)?", message, re.I)
    return float(m[1] or 0) * 60 + float((m[2] or "0").rstrip(".")) + 5 if m and (m[1] or m[2]) else default


@dataclass(frozen=True)
class Timed:
    """An error where the provider takes longer than so many seconds; the call is left behind in its thread."""

    provider: Provider
    seconds: float

    def complete(self, task: str, text: str) -> str:
        from threading import Thread

        got: list = []

        def call() -> None:
            try:
                got.append((self.provider.complete(task, text), None))
            except Exception as e:  # noqa: BLE001
                got.append((None, e))

        worker = Thread(target=call, daemon=True)
        worker.start()
        worker.join(self.seconds)
        if not got:
            raise TimeoutError(f"no answer in {self.seconds} seconds")
        if got[0][1]:
            raise got[0][1]
        return got[0][0]


@dataclass
class DailyLimit:
    """After an error that tells of the day's tokens all calls fail at once until the time it names, `least` seconds at least."""

    provider: Provider
    least: float = 300.0
    until: float = 0.0

    def complete(self, task: str, text: str) -> str:
        if time.time() < self.until:
            raise RuntimeError("the day's tokens are used up")
        try:
            return self.provider.complete(task, text)
        except Exception as e:
            if "429" in str(e) and "tokens per day" in str(e):
                self.until = time.time() + max(self.least, seconds_to_wait(str(e), self.least + 5) - 5)
            raise


@dataclass(frozen=True)
class Failover:
    """The first of some providers that answers, each tried a bounded number of times with a growing wait.

    After an error of too many requests (429) the wait is what its message names, from `interval` up to `most` seconds.
    """

    providers: tuple[Provider, ...]
    tries: int = 3
    wait: float = 0.0
    interval: float = 2.0
    most: float = 60.0

    def complete(self, task: str, text: str) -> str:
        error: Exception | None = None
        for p in self.providers:
            for i in range(self.tries):
                try:
                    return p.complete(task, text)
                except Exception as e:  # noqa: BLE001  a provider's own errors are its own
                    error = e
                    limited = "429" in str(e) and i + 1 < self.tries
                    time.sleep(min(self.most, max(self.interval * (i + 1), seconds_to_wait(str(e), 0.0))) if limited else self.wait * (i + 1))
        raise RuntimeError("no provider answered") from error


@dataclass(frozen=True)
class Throttled:
    """Waits between calls of one task."""

    provider: Provider
    seconds: float

    def complete(self, task: str, text: str) -> str:
        time.sleep(self.seconds)
        return self.provider.complete(task, text)


def asked(rows: DataFrame, provider: Provider, task: str | None, text_col: str, answer: str = "answer", error: str = "error", task_col: str | None = None) -> DataFrame:
    """rows with the provider's answer, or an error and no answer: a failed call fails no task. Equal texts of a batch are asked once.

    task_col: the column that names each row's task, in place of one for all. Lazy: what is used twice must be written first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], tuple[str | None, str | None]] = {}
        for b in batches:
            got = []
            for t, job in zip(b[text_col], b[task_col] if task_col else [task] * len(b), strict=True):
                key = job, hashlib.md5((t or "").encode()).hexdigest()
                if key not in known:
                    try:
                        known[key] = provider.complete(job, t or ""), None
                    except Exception as e:  # noqa: BLE001
                        known[key] = None, str(e)
                got.append(known[key])
            yield b.assign(**{answer: [a for a, _ in got], error: [e for _, e in got]})
            known.clear()

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{answer}` string, `{error}` string")


def cached(chunks: DataFrame, cache: DataFrame, provider: Provider, task: str, keys: Sequence[str] = ("document_id", "chunk_index"), text_col: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """(every chunk with answer and error, new rows for the cache). cache: keys and answer; an answer of null is a miss.

    Only misses are asked, once: their answers are written before both results read them.
    """
    known = cache.where(F.col("answer").isNotNull()).dropDuplicates([*keys]).select(*keys, "answer")
    misses = materialised(asked(chunks.join(known, [*keys], "left_anti"), provider, task, text_col), "answers")
    hits = chunks.join(known, [*keys]).withColumn("error", F.lit(None).cast("string"))
    return hits.unionByName(misses), misses.where("answer is not null").select(*keys, "answer")


def parsed_rules(answers: DataFrame, most: int = 20, answer: str = "answer") -> DataFrame:
    """A row per rule of a JSON answer (a list, or an object with rules, or one rule), the first `most` valid ones of each, with rule_index.

    Entries that are no objects, and objects without text, are passed over; so is a field of an unexpected kind, and neither takes others along.
    """
    (rule,) = unused(answers, "parsed_rule")
    found = F.transform(rule_columns.entries(json_part(F.col(answer))), rule_columns.rule_of)
    good = F.filter(found, lambda r: F.coalesce(rule_columns.truthy(r["rule_text"]), rule_columns.truthy(r["canonical_statement"])).isNotNull())
    rows = answers.select("*", F.posexplode(F.slice(good, 1, most)).alias("rule_index", rule)).drop(answer)
    return rows.withColumns(rule_columns.normalised(F.col(rule))).drop(rule)


def raw_rules(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """A row per text of bulk answers ({rules: [{text, confidence_score}]}), with the constants of rules that were only listed."""
    (one,) = unused(answers, "listed")
    field = rule_columns.field
    listed = F.transform(rule_columns.entries(json_part(F.col(answer))), lambda v: F.struct(field(v, "text").alias("text"), field(v, "confidence_score", "double").alias("confidence_score")))
    rows = answers.select("*", F.posexplode(F.filter(listed, lambda r: rule_columns.truthy(r["text"]).isNotNull())).alias("rule_index", one)).drop(answer)
    text = canonical(strip(F.col(f"{one}.text")))
    score = F.coalesce(F.nullif(F.col(f"{one}.confidence_score"), F.lit(0.0)), F.lit(0.6))
    return rows.withColumns(
        {
            "rule_text": F.substring(text, 1, 500), "category": F.lit("General"), "rule_type": F.lit("general"), "confidence": score, "confidence_level": F.lit("medium"),
            "correctness_tag": F.lit("needs_review"), "relevance": F.lit(0.5), "extraction_method": F.lit("raw_bulk"), "readability": reading_ease(text),
        }
    ).drop(one)


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """Offline: signed hashes of words, added up to a vector of length 1."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embedded(rows: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding", batch: int = 32, keep: int = 1000) -> DataFrame:
    """rows with the embedding of each text, asked for in batches of `batch` new texts.

    Each text is embedded once a batch of rows, and a task keeps the `keep` texts it used last. For texts of low density optimise them
    first (pipelines.embedding_chunks).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import OrderedDict

        known: OrderedDict[str, list[float]] = OrderedDict()
        for b in batches:
            texts = b[text_col].fillna("").tolist()
            own = {t: known[t] for t in dict.fromkeys(texts) if t in known}
            new = [t for t in dict.fromkeys(texts) if t not in own]
            for i in range(0, len(new), batch):
                part = new[i : i + batch]
                own |= zip(part, embedder.embed(part), strict=True)
            for t, v in own.items():
                known[t] = v
                known.move_to_end(t)
            while len(known) > keep:
                known.popitem(last=False)
            yield b.assign(**{out: [own[t] for t in texts]})

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` array<double>")


def reranked(hits: DataFrame, score: Callable[[list[str]], list[float]] | None, k: int, text_col: str = "text") -> DataFrame:
    """hits by a model's score of their text, the top k; without a model the first k, with score 1.

    retrieval.context_reranked is the way without a model that looks at the query.
    """
    if score is None:
        return hits.withColumn("score", F.lit(1.0)).orderBy("id").limit(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=score(b[text_col].tolist()))

    return hits.withColumn("score", F.lit(0.0)).mapInPandas(run, hits.withColumn("score", F.lit(0.0)).schema).orderBy(F.desc("score"), "id").limit(k)

"""Parts of speech and entity labels by an averaged perceptron, trained from tagged sentences that are given.

Training is by iterative parameter mixing: in each epoch every task trains on its own sentences, from the weights all tasks ended the last epoch
with; the tasks' averaged weights are averaged again by feature and tag, in a shuffle. Weights are kept for the `most` features of greatest
weight, which is the model's size. Sentences are tagged greedily from left to right, in Arrow batches; the model is broadcast, its size is
`most` times the tags at most.

Entities are runs of words of one label (a label B-X or I-X counts as X; O, or a tag that is not among the labels asked for, is none).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions.text import reading_ease, unused, word_count
from dolomite.operators.candidates import features as keyword_features
from dolomite.sources.writers import materialised

#: Words and signs apart, as the taggers' training data has them.
TOKEN = r"[\p{L}\p{N}_]+(?:[.,'’-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"
# Tags of which a candidate phrase must hold one, tags and length of a technical word, entity labels.
PRIORITY, TECHNICAL, LONG, LABELS = ("NOUN", "PROPN", "ADJ", "VERB"), ("NOUN", "ADJ"), 6, ("QUANTITY", "CARDINAL", "ORDINAL", "PRODUCT", "ORG")


def clues(words: Sequence[str], i: int, before: str, last: str) -> list[str]:
    """Features of a word: itself, its ends and shape, its neighbours, and the two tags before it."""
    w = words[i]
    low = w.lower()
    shape = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in w[:6])
    left, right = words[i - 1].lower() if i else "<", words[i + 1].lower() if i + 1 < len(words) else ">"
    return ["bias", f"w={low}", f"3={low[-3:]}", f"2={low[-2:]}", f"p={low[:2]}", f"s={shape}", f"t={last}", f"tt={before},{last}", f"tw={last},{low}", f"l={left}", f"r={right}"]


def best(scores: dict[str, float], tags: Sequence[str]) -> str:
    return max(tags, key=lambda t: (scores.get(t, 0.0), t))


def tagged(words: Sequence[str], weights: dict[str, dict[str, float]], tags: Sequence[str]) -> list[str]:
    out, before, last = [], "<<", "<"
    for i in range(len(words)):
        scores: dict[str, float] = defaultdict(float)
        for c in clues(words, i, before, last):
            for t, x in weights.get(c, {}).items():
                scores[t] += x
        out.append(best(scores, tags))
        before, last = last, out[-1]
    return out


def trained_on(sentences: Sequence[tuple[Sequence[str], Sequence[str]]], start: dict[str, dict[str, float]], tags: Sequence[str]) -> dict[tuple[str, str], float]:
    """The averaged weights after one pass, begun with `start`."""
    now = {c: dict(x) for c, x in start.items()}
    sums: dict[tuple[str, str], float] = defaultdict(float)
    seen: dict[tuple[str, str], int] = defaultdict(int)
    step = 0

    def change(clue: str, tag: str, by: float) -> None:
        own = now.setdefault(clue, {})
        sums[clue, tag] += (step - seen[clue, tag]) * own.get(tag, 0.0)
        seen[clue, tag] = step
        own[tag] = own.get(tag, 0.0) + by

    for words, truth in sentences:
        before, last = "<<", "<"
        for i, right in enumerate(truth):
            own = clues(words, i, before, last)
            scores: dict[str, float] = defaultdict(float)
            for c in own:
                for t, x in now.get(c, {}).items():
                    scores[t] += x
            guess = best(scores, tags)
            step += 1
            if guess != right:
                for c in own:
                    change(c, right, 1.0)
                    change(c, guess, -1.0)
            before, last = last, guess
    return {(c, t): (sums[c, t] + (step - seen[c, t]) * x) / max(step, 1) for c, of in now.items() for t, x in of.items()}


@dataclass(frozen=True)
class Tagger:
    weights: dict[str, dict[str, float]]
    tags: tuple[str, ...]

    @staticmethod
    def train(rows: DataFrame, words: str = "words", tags: str = "tags", epochs: int = 5, most: int = 200_000, parts: int | None = None) -> Tagger:
        """rows: an array of words and one of their tags, as long, a row per sentence. parts: tasks that train apart in an epoch."""
        own = rows.where((F.size(words) == F.size(tags)) & (F.size(words) > 0)).select(F.col(words).alias("words"), F.col(tags).alias("tags"))
        own = own.withColumn("h", F.xxhash64("words"))
        own = materialised(own.repartition(parts or rows.sparkSession.sparkContext.defaultParallelism, "h").sortWithinPartitions("h", "tags"), "tagged-sentences")
        named = tuple(r[0] for r in own.select(F.explode("tags").alias("t")).distinct().orderBy("t").collect())  # the tag set
        weights: dict[str, dict[str, float]] = {}
        n = max(1, own.select(F.spark_partition_id().alias("p")).distinct().count())
        for _ in range(epochs):
            shared = rows.sparkSession.sparkContext.broadcast(weights)

            def epoch(batches, shared=shared):
                sentences = [(list(w), list(t)) for b in batches for w, t in zip(b["words"], b["tags"], strict=True)]
                if sentences:
                    got = trained_on(sentences, shared.value, named)
                    yield pd.DataFrame([(c, t, x) for (c, t), x in got.items()], columns=["clue", "tag", "weight"])

            mixed = own.select("words", "tags").mapInPandas(epoch, "clue string, tag string, weight double").groupBy("clue", "tag").agg((F.sum("weight") / n).alias("weight"))
            mixed = materialised(mixed.where("weight != 0"), "tagger-weights")
            heavy = mixed.groupBy("clue").agg(F.max(F.abs("weight")).alias("size")).orderBy(F.desc("size"), "clue").limit(most)
            weights = {}
            for r in mixed.join(heavy.select("clue"), "clue").toLocalIterator():
                weights.setdefault(r["clue"], {})[r["tag"]] = r["weight"]
        return Tagger(weights, named)

    def tag(self, rows: DataFrame, words: str = "words", out: str = "tags") -> DataFrame:
        """rows with the tags of an array of words."""
        model = rows.sparkSession.sparkContext.broadcast((self.weights, self.tags))

        def run(batches):
            weights, tags = model.value
            for b in batches:
                yield b.assign(**{out: [tagged(list(w), weights, tags) if w is not None and tags else [] for w in b[words]]})

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out)
        return rows.drop(out).mapInPandas(run, f"{fields}, `{out}` array<string>")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


def entities(words: Column, tags: Column, labels: Sequence[str] = LABELS) -> Column:
    """Array of (text, label): runs of words of one label, in order. B-X begins a run of its own."""
    none = F.array().cast("array<struct<text:string,label:string,open:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        label = F.regexp_replace(x["tag"], "^[BI]-", "")
        known = label.isin(*labels)
        last = F.element_at(acc, -1)
        goes_on = F.coalesce((F.size(acc) > 0) & known & last["open"] & (last["label"] == label) & ~x["tag"].startswith("B-"), F.lit(False))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.concat_ws(" ", last["text"], x["word"]).alias("text"), label.alias("label"), F.lit(True).alias("open"))))
        fresh = F.concat(acc, F.array(F.struct(x["word"].alias("text"), label.alias("label"), F.lit(True).alias("open"))))
        closed = F.transform(acc, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), F.lit(False).alias("open")))
        return F.when(goes_on, joined).when(known, fresh).otherwise(closed)

    pairs = F.zip_with(words, tags, lambda w, t: F.struct(w.alias("word"), t.alias("tag")))
    return F.transform(F.aggregate(pairs, none, step), lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")))


def text_features(rows: DataFrame, parts: Tagger, named: Tagger | None = None, text_col: str = "text", out: str = "features") -> DataFrame:
    """rows with matches and density of the domain's words, entities, complexity (long nouns and adjectives to words) and readability.

    parts: tags of parts of speech; named: labels of entities (none: no entities).
    """
    w, p, e = unused(rows, "words", "parts", "labels")
    own = parts.tag(rows.withColumn(w, words_of(F.col(text_col))), w, p)
    own = named.tag(own, w, e) if named else own.withColumn(e, F.transform(w, lambda _: F.lit("O")))
    technical = F.filter(F.zip_with(w, p, lambda x, t: F.struct(x.alias("x"), t.alias("t"))), lambda s: s["t"].isin(*TECHNICAL) & (F.length(s["x"]) > LONG))
    found, text = keyword_features(F.col(text_col)), F.coalesce(F.col(text_col), F.lit(""))
    n = word_count(text)
    complexity = F.when(n > 0, F.size(technical) / n).otherwise(0.0)
    value = F.struct(found["matches"].alias("matches"), found["density"].alias("density"), entities(F.col(w), F.col(e)).alias("entities"), complexity.alias("complexity"), F.coalesce(reading_ease(text), F.lit(0.0)).alias("readability"))
    return own.withColumn(out, value).drop(w, p, e)


def tagged_phrases(docs: DataFrame, tagger: Tagger, most: int = 3, stop: Sequence[str] = lexicon.STOPWORDS, id_col: str = "doc_id", text_col: str = "text", priority: Sequence[str] = PRIORITY) -> DataFrame:
    """(id, phrase): distinct 1- to most-grams of words and signs over two characters, of which one at least has a priority tag and at most half are stop words."""
    rows = tagger.tag(docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")), "w", "t")
    both = rows.select("id", F.zip_with("w", "t", lambda w, t: F.struct(w.alias("w"), t.alias("t"))).alias("x"))
    stops = F.array(*map(F.lit, stop))
    each = lambda n: F.when(F.size("x") >= n, F.transform(F.sequence(F.lit(1), F.size("x") - (n - 1)), lambda i: F.slice("x", i, F.lit(n)))).otherwise(F.array().cast("array<array<struct<w:string,t:string>>>"))
    found = both.select("id", F.explode(F.concat(*[each(n) for n in range(1, most + 1)])).alias("p"))
    few = F.size(F.filter("p", lambda x: F.array_contains(stops, F.lower(x["w"])))) / F.size("p") <= 0.5
    good = F.exists("p", lambda x: x["t"].isin(*priority)) & few
    phrase = F.lower(F.array_join(F.transform("p", lambda x: x["w"]), " "))
    return found.where(good).select("id", phrase.alias("phrase")).where(F.length("phrase") > 2).distinct()

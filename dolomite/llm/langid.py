"""Language identification by a string kernel.

The kernel of two texts is the number of n-grams (n = 1, 2, 3, of folded characters) present in both, over the root of the product of
the numbers present in each; a blended-spectrum presence kernel over a vocabulary of n-grams of the training texts. Landmarks
among the training texts give Nystroem features, on which one-versus-rest kernel ridge regression is fitted. A batch is
scored by matrix products: presence times landmarks' presence, normalised, times coefficients.

The model is fitted on at most PER_LANGUAGE labelled documents a language (MOST_LEARNED in all), chosen by a hash of the identifier, whose
crc32(identifier as text) mod 4 is not 2. Of each it takes the first CHARS characters, so that what reaches the driver has a bound in
bytes, too, and no long document is left out for it. Of more languages than MOST_LEARNED the most frequent are learned. Every text is scored
whole.

Null text, or one without a letter: "und", score 0. No labelled rows: "und" for all. One language only: that, score 1.
A row per input row, repeated rows too; columns other than those named play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dolomite.llm.common import slices, small_or_shuffled, spread, written

PER_LANGUAGE, CHARS, LANDMARKS, VOCABULARY, ALPHABET = 300, 20_000, 64, 5000, 128
RIDGE, SHARPNESS, ROWS = 1e-2, 4.0, 256
OWN, SEPARATOR = 96, ALPHABET - 1  # characters with a place of their own, and the sign between texts
#: Documents to learn from over all languages; of many languages each has fewer than PER_LANGUAGE.
MOST_LEARNED = 6000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def folded(texts: list[str]) -> np.ndarray:
    """Code points of all texts in lower case, each text ended by the separator's."""
    return np.frombuffer("".join(t.lower() + "\U0010ffff" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Model:
    letters: np.ndarray  # code point -> place in the alphabet
    grams: tuple[np.ndarray, ...]  # for n = 1, 2, 3: n-gram -> place in the vocabulary, or -1
    landmarks: np.ndarray  # presence, vocabulary x landmarks, columns of length 1
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    languages: list[str]

    def scores(self, texts: list[str]) -> np.ndarray:
        p = presence(texts, self.letters, self.grams, self.landmarks.shape[0])
        kernel = (p @ self.landmarks) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
        z = SHARPNESS * (kernel @ self.weights + self.bias)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def ngrams(code: np.ndarray) -> list[np.ndarray]:
    one = code.astype(np.int32)
    two = one[:-1] * ALPHABET + one[1:]
    return [one, two, two[:-1] * ALPHABET + one[2:]]


def presence(texts: list[str], letters: np.ndarray, grams: tuple[np.ndarray, ...], size: int) -> np.ndarray:
    code = letters[folded(texts)]
    row = np.cumsum(code == SEPARATOR) - (code == SEPARATOR)  # of a text that has the separator's character itself, corrected below
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    if len(row) and (row[-1] + 1 != len(texts)):
        row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    out = np.zeros(len(texts) * size, np.float32)
    for table, gram in zip(grams, ngrams(code), strict=True):
        place = table[gram]
        on = place >= 0
        out[row[: len(gram)][on] * size + place[on]] = 1
    return out.reshape(len(texts), size)


def fit(texts: list[str], langs: list[str]) -> Model | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    points, counts = np.unique(folded(texts), return_counts=True)
    counts = np.where(points == 0x10FFFF, 0, counts)
    # Frequent characters have a place of their own; the others share the rest, so that no script becomes one symbol.
    letters = (OWN + np.arange(0x110000) % (SEPARATOR - OWN)).astype(np.uint8)
    common = points[np.argsort(-counts, kind="stable")][:OWN]
    letters[common] = np.arange(len(common))
    letters[0x10FFFF] = SEPARATOR
    seen = [np.zeros(ALPHABET**n, np.int32) for n in (1, 2, 3)]
    for t in texts:
        for count, gram in zip(seen, ngrams(letters[folded([t])]), strict=True):
            count[np.unique(gram)] += 1
    place = np.arange(ALPHABET)
    for n, count in enumerate(seen, 1):  # n-grams that touch a text's end are none
        view = count.reshape((ALPHABET,) * n)
        for axis in range(n):
            view[(slice(None),) * axis + (place == SEPARATOR,)] = 0
    df = np.concatenate(seen)
    chosen = np.argsort(-df, kind="stable")[:VOCABULARY]
    chosen = chosen[df[chosen] >= min(2, len(texts))]
    table = np.full(len(df), -1, np.int16)
    table[chosen] = np.arange(len(chosen))
    grams = tuple(np.split(table, np.cumsum([len(x) for x in seen])[:-1]))
    p = np.concatenate([presence(texts[a : a + ROWS], letters, grams, len(chosen)) for a in range(0, len(texts), ROWS)])
    p /= np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
    lang = np.array([languages.index(x) for x in langs])
    marks = np.concatenate([np.flatnonzero(lang == k)[:LANDMARKS] for k in range(len(languages))])
    kernel = (p @ p[marks].T).astype(float)
    value, vector = np.linalg.eigh(kernel[marks])
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    feature = kernel @ root
    target = np.where(lang[:, None] == np.arange(len(languages)), 1.0, -1.0)
    each = 1 / np.bincount(lang, minlength=len(languages))[lang]  # languages weigh the same
    each /= each.sum()
    middle, mean = each @ feature, each @ target
    x, y = feature - middle, target - mean
    solved = np.linalg.solve(x.T @ (x * each[:, None]) + RIDGE / len(texts) * np.eye(x.shape[1]), x.T @ (y * each[:, None]))
    return Model(letters, grams, p[marks].T.copy(), (root @ solved).astype(np.float32), (mean - middle @ solved).astype(np.float32), languages)


def training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """A bounded sample for each label, from the documents to learn from."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LEARNED), "languages")
    languages = counts.count()
    if not languages:
        return [], []
    most = max(1, min(PER_LANGUAGE, MOST_LEARNED // languages))
    shares = counts.select("lang", (F.least(F.lit(1.0), 4 * most / F.col("n")) * (1 << 30)).cast("long").alias("share"))
    near = rows.join(small_or_shuffled(shares), "lang").where(hashed < F.col("share")).withColumns({"text": F.substring("text", 1, CHARS), "h": hashed})
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("k") <= most)
    got = sorted((r["k"], r["lang"], r["text"]) for r in first.select("k", "lang", "text").collect())
    return [t for _, _, t in got], [x for _, x, _ in got]


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(*training(docs, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the constants above alone

    def run(batches):
        own = shared.value
        for b in slices(batches, "text"):
            text = b.column("text").to_pylist()
            best, score = ["und"] * len(text), np.zeros(len(text))
            rows = [i for i, t in enumerate(text) if own and t and any(map(str.isalpha, t))]
            for a in range(0, len(rows), ROWS):
                part = rows[a : a + ROWS]
                p = own.scores([text[i] for i in part])
                score[part] = p.max(axis=1)
                for i, k in zip(part, p.argmax(axis=1), strict=True):
                    best[i] = own.languages[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(best, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

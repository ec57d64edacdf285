"""Keyword search by a stored inverted index: one tokenisation, postings by term in blocks of falling weight, top k without reading all of them.

The vocabulary is the `features` most frequent n-grams (ties by the alphabet) of the words left after the stop words; weights are TF-IDF, each
document's vector of length 1. Tables in the index's folder: terms (code, term, df, total, idf), postings/bucket=<n> (term, top, low, ids,
weights: up to BLOCK postings between two weights, sorted by falling weight), documents (id, codes, tfs: the terms' counts by document, each file
sorted by id), meta (one row: settings and the number of documents).

A search reads blocks in rounds of halving weight. What it has read of a document is a lower bound of its score, and with the round's weight
in place of each term not met yet an upper one. When no document outside the best k can reach the k-th any more, those that still
can are scored from their vectors. Only the blocks of the query's terms that a round asks for are read (bucket, term and weight are filters of
the scan).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.operators.retrieval import few_rows, known_counts, numbered
from dolomite.sources.writers import materialised

FEATURES, BLOCK, BUCKETS, GRAMS = 5000, 1024, 32, (1, 3)
#: Postings that a task sorts.
TASK = 1_000_000
POSTINGS = "bucket int, term string, top double, low double, ids array<{kind}>, weights array<double>"
#: Weights are compared with this much room, so that rounding drops no document.
SLACK = 1e-9


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def weights_of(x, idf):
    """row, code, weight of an Arrow batch of documents (codes, tfs): each row's vector of length 1."""
    import numpy as np
    import pyarrow.compute as pc

    row = np.repeat(np.arange(x.num_rows), np.asarray(pc.list_value_length(x.column("codes"))))
    code, tf = (np.asarray(x.column(c).flatten()) for c in ("codes", "tfs"))
    weight = tf * idf[code]
    return row, code, weight / np.sqrt(np.bincount(row, weight * weight, x.num_rows))[row]


@dataclass(frozen=True)
class InvertedIndex:
    spark: SparkSession
    folder: str

    @staticmethod
    def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", grams: tuple[int, int] = GRAMS, stop: Sequence[str] = lexicon.ENGLISH, features: int = FEATURES, block: int = BLOCK) -> InvertedIndex:
        """Rows of equal identifier are one document; documents without a known term have no postings. Texts are tokenised once.

        Postings go to their tasks as one row a term and batch of documents; a term of very many documents is dealt to several tasks.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        spark = docs.sparkSession
        counts, names = known_counts(docs, id_col, text_col, grams, stop, features)
        counts.sortWithinPartitions("id").write.parquet(f"{folder}/documents")
        stored = spark.read.schema(counts.schema).parquet(f"{folder}/documents")
        kind = dict(stored.dtypes)["id"]
        n = docs.select(F.count(F.lit(1))).first()[0]

        def summed(batches):
            df, total = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for x in batches:
                code, tf = (np.asarray(x.column(c).flatten()) for c in ("codes", "tfs"))
                df += np.bincount(code, minlength=len(names))
                total += np.bincount(code, tf, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names)), pa.int32()), pa.array(df), pa.array(total)], ["code", "df", "total"])

        known = stored.select("codes", "tfs").mapInArrow(summed, "code int, df long, total long").groupBy("code").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        known = known.join(F.broadcast(numbered(spark, names)), "code").select("code", "term", "df", "total")  # `features` rows
        known.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).coalesce(1).write.parquet(f"{folder}/terms")
        terms = spark.read.parquet(f"{folder}/terms").withColumn("bucket", bucket_of(F.col("term"))).orderBy("bucket", "term").collect()
        idf, bucket = np.ones(len(names)), np.zeros(len(names), np.int32)
        begins, pieces = np.zeros(len(names), np.int64), np.ones(len(names), np.int64)
        size = max(block, min(TASK, -(-sum(r["df"] for r in terms) // (2 * spark.sparkContext.defaultParallelism))))
        part, filled = 0, 0
        for r in terms:
            several = -(-r["df"] // size)
            if filled and (several > 1 or filled + r["df"] > size):
                part, filled = part + 1, 0
            idf[r["code"]], bucket[r["code"]], begins[r["code"]], pieces[r["code"]] = r["idf"], r["bucket"], part, several
            part, filled = (part + several, 0) if several > 1 else (part, filled + r["df"])

        def weighed(batches):
            seen = 0
            for x in few_rows(batches, 4000):
                row, code, weight = weights_of(x, idf)
                to = begins[code] + (seen + row) % pieces[code]
                seen += x.num_rows
                key = to * max(len(names), 1) + code
                order = np.argsort(key, kind="stable")
                at = np.flatnonzero(np.diff(key[order], prepend=-1))
                ends = pa.array(np.append(at, len(order)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, v) for v in (x.column("id").take(pa.array(row[order])), pa.array(weight[order])))
                yield pa.RecordBatch.from_arrays([pa.array(to[order][at], pa.int32()), pa.array(code[order][at], pa.int32()), *lists], ["part", "code", "ids", "weights"])

        def blocks(batches):
            key, ids, weights = None, [], []

            def made():
                i, w = pa.concat_arrays(ids), np.concatenate(weights)
                order = pc.sort_indices(pa.table({"w": w, "i": i}), sort_keys=[("w", "descending"), ("i", "ascending")])
                i, w = i.take(order), w[np.asarray(order)]
                ends = np.append(np.arange(0, len(w), block), len(w))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (i, pa.array(w))]
                many = len(ends) - 1
                return pa.RecordBatch.from_arrays([pa.array([bucket[key]] * many, pa.int32()), pa.array([names[key]] * many, pa.string()), pa.array(w[ends[:-1]]), pa.array(w[ends[1:] - 1]), *lists], ["bucket", "term", "top", "low", "ids", "weights"])

            for x in batches:
                for at, code in enumerate(x.column("code").to_pylist()):
                    if code != key:
                        if ids:
                            yield made()
                        key, ids, weights = code, [], []
                    ids.append(x.column("ids")[at].values)
                    weights.append(np.asarray(x.column("weights")[at].values))
            if ids:
                yield made()

        one = stored.mapInArrow(weighed, f"part int, code int, ids array<{kind}>, weights array<double>").repartitionById(part + 1, F.col("part")).sortWithinPartitions("part", "code")
        one.select("code", "ids", "weights").mapInArrow(blocks, POSTINGS.format(kind=kind)).write.partitionBy("bucket").parquet(f"{folder}/postings")
        meta = {"n": n, "grams": list(grams), "stop": list(stop), "kind": kind}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{folder}/meta")
        return InvertedIndex(spark, folder)

    def meta(self) -> dict:
        return json.loads(self.spark.read.parquet(f"{self.folder}/meta").first()["meta"])

    def asked(self, query: str, meta: dict) -> dict[str, float]:
        """The query's vector of length 1 over the vocabulary."""
        low, high = meta["grams"]
        stops = set(meta["stop"])
        w = [x for x in re.findall(r"\w{2,}", query.lower()) if x not in stops]
        count = Counter(" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1))
        if not count:
            return {}
        idf = {r["term"]: r["idf"] for r in self.spark.read.parquet(f"{self.folder}/terms").where(F.col("term").isin(*count)).collect()}  # of the query's terms
        size = sum((count[t] * x) ** 2 for t, x in idf.items()) ** 0.5
        return {t: count[t] * x / size for t, x in idf.items()}

    def postings(self, terms: Sequence[str], kind: str, least: float = 0.0, below: float = 2.0) -> DataFrame:
        """term, id, weight of the blocks of the terms whose first weight is over `least` and at most `below`."""
        buckets = {r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).collect()}
        rows = self.spark.read.schema(POSTINGS.format(kind=kind)).parquet(f"{self.folder}/postings")
        rows = rows.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms) & (F.col("top") > least) & (F.col("top") <= below))
        return rows.select("term", F.explode(F.arrays_zip("ids", "weights")).alias("x")).select("term", F.col("x.ids").alias("id"), F.col("x.weights").alias("weight"))

    def search(self, query: str, k: int = 10, least: float = 0.1) -> DataFrame:
        """(id, score): cosine over `least` of the query's vector with each document's, the top k (ties by id)."""
        return self.traced(query, k, least)[0]

    def traced(self, query: str, k: int = 10, least: float = 0.1) -> tuple[DataFrame, list[float]]:
        """search's result and the weights that its rounds went down to (the last 0 if all blocks were read)."""
        meta = self.meta()
        q = self.asked(query, meta)
        kind = meta["kind"]
        if not q:
            return self.spark.createDataFrame([], f"id {kind}, score double"), []
        of = F.create_map(*[F.lit(x) for item in q.items() for x in item])
        total, level, levels, partial = sum(q.values()), 1.0, [], None
        while True:
            below, level = level if levels else 2.0, level / 2
            if level * total <= max(least, 1e-3) * 0.25:
                level = 0.0
            levels.append(level)
            read = self.postings([*q], kind, level, below).groupBy("id").agg(F.sum(F.col("weight") * of[F.col("term")]).alias("score"), F.sum(of[F.col("term")]).alias("met"))
            partial = materialised(read if partial is None else partial.unionByName(read).groupBy("id").agg(F.sum("score").alias("score"), F.sum("met").alias("met")), "partial-scores")
            if not level:
                return partial.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k).select("id", "score"), levels
            best = [r["score"] for r in partial.orderBy(F.desc("score")).limit(k).select("score").collect()]
            bar = max(least, best[-1]) if len(best) == k else least
            if level * total >= bar - SLACK:
                continue  # a document that no round has met could still come in
            upper = F.col("score") + level * (total - F.col("met"))
            open_ = partial.where(upper >= bar - SLACK).select("id")
            vectors = self.spark.read.schema(f"id {kind}, codes array<int>, tfs array<int>").parquet(f"{self.folder}/documents")
            few = [r["id"] for r in open_.limit(1001).collect()]
            vectors = vectors.where(F.col("id").isin(*few)) if len(few) <= 1000 else vectors.join(open_, "id", "left_semi")
            scored = vectors.mapInArrow(self.product(q), f"id {kind}, score double")
            return scored.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k), levels

    def product(self, q: dict[str, float]):
        """Of Arrow batches of documents: their products with the query's vector."""
        import numpy as np
        import pyarrow as pa

        terms = self.spark.read.parquet(f"{self.folder}/terms").select("code", "term", "idf").collect()  # `features` rows
        idf, asked = np.ones(len(terms)), np.zeros(len(terms))
        for r in terms:
            idf[r["code"]], asked[r["code"]] = r["idf"], q.get(r["term"], 0.0)

        def scored(batches):
            for x in batches:
                row, code, weight = weights_of(x, idf)
                yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(np.bincount(row, weight * asked[code], x.num_rows))], ["id", "score"])

        return scored

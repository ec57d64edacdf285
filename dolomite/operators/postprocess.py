"""After extraction: exact and similarity dedup, filters, clustering, caps, and counts of what each step left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions.text import squeezed, unused
from dolomite.operators import graphs
from dolomite.sources.writers import materialised


def first_of_each(rules: DataFrame, key: Column, order: Sequence[str], scope: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The first rule of each key within scope. Least rows are found by an aggregate, which combines before its shuffle."""
    k, r = unused(rules, "key", "row")
    rows = rules.withColumn(k, key)
    best = rows.groupBy(*scope, k).agg(F.min_by(F.struct(*rules.columns), F.struct(*order)).alias(r))
    return best.select(f"{r}.*")


def squeezed_dedupe(rules: DataFrame, order: Sequence[str], scope: Sequence[str] = ("doc_id",), text: str = "rule_text") -> DataFrame:
    return first_of_each(rules, squeezed(F.col(text)), order, scope)


def vectors_of_rules(rules: DataFrame, doc: str, index: str, text: str, stop: Sequence[str], features: int) -> DataFrame:
    """doc, index, terms, weights: TF-IDF vectors of length 1 over the document's own rules, terms rare before frequent.

    1- to 3-grams without stop words; of a document's n-grams the `features` most frequent count (ties by the alphabet).
    """
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if stop:
        stops = F.array(*map(F.lit, stop))
        w = F.filter(w, lambda x: ~F.array_contains(stops, x))
    rows = rules.select(F.col(doc).alias("doc"), F.col(index).alias("at"), w.alias("w"))
    each = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    grams = rows.select("doc", "at", F.explode(F.concat(each(1), each(2), each(3))).alias("term"))
    tf = materialised(grams.groupBy("doc", "at", "term").agg(F.count(F.lit(1)).alias("tf")), "rule-terms")
    known = tf.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("total"), "term"))
    known = known.withColumn("place", place).where(F.col("place") <= features)
    n = rules.groupBy(F.col(doc).alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    idf = known.join(n, "doc").select("doc", "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = tf.join(idf, ["doc", "term"]).groupBy("doc", "at").agg(F.sort_array(F.collect_list(F.struct("df", "term", (F.col("tf") * F.col("idf")).alias("w")))).alias("x"))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, t: a + t["w"] * t["w"]))
    return weighed.withColumn("size", size).select("doc", "at", F.col("x.term").alias("terms"), F.transform("x", lambda t: t["w"] / F.col("size")).alias("weights"))


def similar_shapes(shapes: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b): shapes (shape, doc, terms, weights) of one document whose cosine is over the threshold.

    In the terms' order a vector whose rest, from some term on, is no longer than the threshold can resemble no other by the rest alone:
    two that resemble each other share a term before it in both. They meet by those terms alone, and are verified whole.
    """
    squares = F.transform("weights", lambda w: w * w)
    rest = lambda i: F.aggregate(F.slice(squares, i, F.size("weights")), F.lit(0.0), lambda a, w: a + w)
    long = F.size(F.filter(F.sequence(F.lit(1), F.size("weights")), lambda i: rest(i) > threshold * threshold - 1e-9))
    first = materialised(shapes.select("shape", "doc", F.explode(F.slice("terms", 1, long)).alias("term")), "prefix-terms")
    several = first.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = first.join(several, ["doc", "term"])
    met = first.alias("x").join(first.alias("y"), (F.col("x.doc") == F.col("y.doc")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.shape") < F.col("y.shape")))
    pairs = materialised(met.select(F.col("x.shape").alias("a"), F.col("y.shape").alias("b")).distinct(), "candidate-pairs")
    of = lambda name: shapes.select(F.col("shape").alias(name), F.map_from_arrays("terms", "weights").alias(f"{name}_v"))
    product = F.aggregate(F.map_entries("a_v"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.col("b_v")[e["key"]], F.lit(0.0)))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(product > threshold).select("a", "b")


def similar_leaders(rules: DataFrame, doc_col: str = "doc_id", index_col: str = "rule_index", text_col: str = "rule_text", score_col: str = "confidence", threshold: float = 0.8, stop: Sequence[str] = lexicon.ENGLISH, features: int = 1000, most: int = 2_000) -> DataFrame:
    """(doc, index, leader): greedily, in order, each rule joins the first kept rule of its document it resembles.

    Resemblance is the cosine of TF-IDF vectors of 1- to 3-grams, without stop words, over the document's own rules; of the n-grams the
    `features` most frequent count (ties by the alphabet). A rule of higher score than the leader takes its place, behind all kept so far.
    Documents of at most `most` rules are led whole, in one group each; larger ones by a join over prefixes (leaders_by_join), with the
    same result.
    """
    names = (doc_col, index_col, text_col, score_col)
    (size,) = unused(rules, "size")
    own = materialised(rules.select(*names), "rules-led")
    large = own.groupBy(doc_col).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > most).select(doc_col)
    if large.isEmpty():
        return leaders_in_groups(own, *names, threshold, stop, features)
    large = materialised(large, "large-documents")
    few = leaders_in_groups(own.join(large, doc_col, "left_anti"), *names, threshold, stop, features)
    return few.unionByName(leaders_by_join(own.join(large, doc_col, "left_semi"), *names, threshold, stop, features))


def leaders_in_groups(rules: DataFrame, doc_col: str, index_col: str, text_col: str, score_col: str, threshold: float, stop: Sequence[str], features: int) -> DataFrame:
    """Rows of a document come one behind the other, sorted, so that thousands of documents share a batch; a document is held whole."""
    import pyarrow as pa

    stops, nan = frozenset(stop), float("nan")

    def lead(index: list, texts: list, score: list) -> list:
        import math
        import re
        from collections import Counter, defaultdict

        texts, score = [t or "" for t in texts], [nan if x is None else x for x in score]
        grams = []
        for t in texts:
            w = [x for x in re.findall(r"\w\w+", t.lower()) if x not in stops]
            grams.append(Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)))
        total: Counter = Counter()
        for c in grams:
            total.update(c)
        if len(total) > features:
            known = set(sorted(total, key=lambda g: (-total[g], g))[:features])
            grams = [Counter({g: k for g, k in c.items() if g in known}) for c in grams]
        df = Counter(g for c in grams for g in c)
        vectors = []
        for c in grams:
            v = {g: k * (math.log((1 + len(grams)) / (1 + df[g])) + 1) for g, k in c.items()}
            size = math.sqrt(sum(x * x for x in v.values())) or 1.0
            vectors.append({g: x / size for g, x in v.items()})
        kept: dict[int, int] = {}  # rule -> its turn; least first
        posted: dict[str, set[int]] = defaultdict(set)
        leader, turn = list(range(len(texts))), 0
        for i, v in enumerate(vectors):
            near: dict[int, float] = defaultdict(float)
            for g, x in v.items():
                for j in posted.get(g, ()):
                    near[j] += x * vectors[j][g]
            hit = min((j for j, s in near.items() if s > threshold and j in kept), key=kept.__getitem__, default=None)
            if hit is not None and score[i] <= score[hit]:
                leader[i] = hit
                continue
            if hit is not None:
                leader[hit] = i
                del kept[hit]
                for g in vectors[hit]:
                    posted[g].discard(hit)
            kept[i] = turn = turn + 1
            for g in v:
                posted[g].add(i)

        def top(i: int) -> int:
            while leader[i] != i:
                i = leader[i]
            return i

        return [index[top(i)] for i in range(len(index))]

    def run(batches):
        doc, own, out = None, ([], [], []), ([], [], [])  # own: a document whose rows may go on in the next batch

        def close() -> None:
            for column, more in zip(out, ([doc] * len(own[0]), own[0], lead(*own)), strict=True):
                column.extend(more)

        def told(schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, schema.field(c).type) for x, c in zip(out, (doc_col, index_col, index_col), strict=True)], [doc_col, index_col, "leader"])

        for b in batches:
            for d, *row in zip(*(b.column(c).to_pylist() for c in (doc_col, index_col, text_col, score_col)), strict=True):
                if own[0] and d != doc:
                    close()
                    own = ([], [], [])
                doc = d
                for column, x in zip(own, row, strict=True):
                    column.append(x)
            yield told(b.schema)
            out, schema = ([], [], []), b.schema
        if own[0]:
            close()
            yield told(schema)

    kinds = dict(rules.dtypes)
    rows = rules.select(doc_col, index_col, text_col, score_col).repartition(doc_col).sortWithinPartitions(doc_col, F.asc_nulls_last(index_col))
    return rows.mapInArrow(run, f"{doc_col} {kinds[doc_col]}, {index_col} {kinds[index_col]}, leader {kinds[index_col]}")


def leaders_by_join(rules: DataFrame, doc_col: str, index_col: str, text_col: str, score_col: str, threshold: float, stop: Sequence[str], features: int) -> DataFrame:
    """similar_leaders of large documents.

    Rules of equal vectors are one shape. Shapes that resemble each other are found by a join over prefixes; what they link is a component, and
    rules of different components never meet, so the greedy choice runs within a component, over numbers alone, however large the document.
    Rules without a known word resemble none. Rules of one index are taken in the order of their vectors.
    """
    import pandas as pd

    kinds = dict(rules.dtypes)
    vectors = vectors_of_rules(rules, doc_col, index_col, text_col, stop, features)
    vectors = materialised(vectors.withColumn("name", F.xxhash64("doc", "terms", "weights")), "rule-vectors")
    shapes = vectors.groupBy("doc", "name").agg(F.first("terms").alias("terms"), F.first("weights").alias("weights"), F.count(F.lit(1)).alias("n"))
    shapes = materialised(shapes.withColumnRenamed("name", "shape"), "rule-shapes")
    links = materialised(similar_shapes(shapes, threshold), "similar-shapes")
    found = graphs.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("shape"), "component")
    alike = shapes.select("shape", "n").join(found, "shape", "left").where((F.col("n") > 1) | F.col("component").isNotNull()).select("shape", F.coalesce("component", "shape").alias("component"))
    both = links.select(F.col("a").alias("shape"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("shape"), F.col("a").alias("other")))
    near = alike.join(both.groupBy("shape").agg(F.collect_list("other").alias("others")), "shape", "left")
    scores = rules.select(F.col(doc_col).alias("doc"), F.col(index_col).alias("at"), F.col(score_col).cast("double").alias("score"))
    placed = vectors.select("doc", "at", F.col("name").alias("shape")).join(near, "shape").join(scores, ["doc", "at"])

    def lead(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "shape"], kind="stable")
        near = {s: {s, *(o if o is not None else ())} for s, o in zip(rows["shape"], rows["others"], strict=True)}
        index, shape, score = rows["at"].tolist(), rows["shape"].tolist(), rows["score"].tolist()
        leader, kept, turn = list(range(len(rows))), {}, 0  # kept: shape -> its kept rules (turn, rule)
        for i, own in enumerate(shape):
            hit = min((k for s in near[own] for k in kept.get(s, ())), default=None)
            if hit is not None:
                if score[i] <= score[hit[1]]:
                    leader[i] = hit[1]
                    continue
                leader[hit[1]] = i
                kept[shape[hit[1]]].discard(hit)
            turn += 1
            kept.setdefault(own, set()).add((turn, i))

        def top(i: int) -> int:
            while leader[i] != i:
                i = leader[i]
            return i

        return pd.DataFrame({"doc": rows["doc"], "at": rows["at"], "leader": [index[top(i)] for i in range(len(index))]})

    chosen = placed.select("component", "shape", "doc", "at", "score", "others").groupBy("component").applyInPandas(lead, f"doc {kinds[doc_col]}, at {kinds[index_col]}, leader {kinds[index_col]}")
    chosen = materialised(chosen, "leaders")
    every = rules.select(F.col(doc_col).alias("doc"), F.col(index_col).alias("at")).join(chosen, ["doc", "at"], "left")
    return every.select(F.col("doc").alias(doc_col), F.col("at").alias(index_col), F.coalesce("leader", "at").alias("leader"))


def quality_filter(rules: DataFrame, least: float = 0.3, least_relevance: float = 0.2) -> DataFrame:
    return rules.where((F.col("confidence") >= least) & (F.col("relevance") >= least_relevance))


def escalations(rules: DataFrame, tag: str = "correctness_tag") -> DataFrame:
    return rules.where(F.col(tag).isin("out_of_scope", "low_confidence"))


def capped(rules: DataFrame, most: int, by: Sequence[Column], scope: str = "doc_id") -> DataFrame:
    """The first `most` of each document: the feature is a cap for each document."""
    (r,) = unused(rules, "rank")
    return rules.withColumn(r, F.row_number().over(Window.partitionBy(scope).orderBy(*by))).where(F.col(r) <= most).drop(r)


def cluster_best(rules: DataFrame, doc_col: str = "doc_id", index_col: str = "rule_index", text_col: str = "rule_text", score_col: str = "confidence", most: int = 5, above: int = 5, features: int = 1000, rounds: int = 50, stop: Sequence[str] = lexicon.ENGLISH, whole: int = 2_000) -> DataFrame:
    """Of each document with more than `above` rules the one of highest score (first of equals) of each of min(most, n // 3) clusters.

    Other documents keep all. K-means over the TF-IDF vectors of similar_leaders (a rule without a known word is the zero vector). Seeds are
    drawn as by k-means++, with a share of the squared distance, by a hash of the rule's place in place of a random number, so the same each
    time. Documents of at most `whole` rules are clustered in one group each, larger ones in rounds of joins, with the same draws.
    """
    sizes = rules.groupBy(F.col(doc_col).alias("doc")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.least(F.lit(most), F.floor(F.col("n") / 3)).cast("int"))
    sizes = materialised(sizes.where((F.col("n") > above) & (F.col("k") > 1)), "clustered-documents")
    vectors = vectors_of_rules(rules, doc_col, index_col, text_col, stop, features)
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(float("-inf")))
    own = rules.select(F.col(doc_col).alias("doc"), F.col(index_col).alias("at"), score.alias("score")).join(sizes, "doc").join(vectors, ["doc", "at"], "left")
    own = materialised(own.withColumns({"terms": F.coalesce("terms", F.array().cast("array<string>")), "weights": F.coalesce("weights", F.array().cast("array<double>"))}), "rule-vectors")
    small, large = own.where(F.col("n") <= whole), own.where(F.col("n") > whole)
    placed = clusters_in_groups(small, rounds)
    if not large.isEmpty():
        placed = placed.unionByName(clusters_by_joins(large.select("doc", "at", "score", "k", "terms", "weights"), rounds))
    (best,) = unused(rules, "best")
    chosen = placed.groupBy("doc", "cluster").agg(F.max_by("at", F.struct("score", -F.col("at"))).alias("at")).select(F.col("doc").alias(doc_col), F.col("at").alias(index_col), F.lit(True).alias(best))
    led = sizes.select(F.col("doc").alias(doc_col))
    return rules.join(led, doc_col, "left_anti").unionByName(rules.join(chosen, [doc_col, index_col], "left_semi"))


def drawn(at: Column, turn: int) -> Column:
    """A number between 0 and 1 by the hash of a rule's place and the seed's turn."""
    return (F.pmod(F.xxhash64(at.cast("long"), F.lit(turn)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)


def clusters_in_groups(rows: DataFrame, rounds: int) -> DataFrame:
    """doc, at, score, cluster of rows (doc, at, score, k, terms, weights)."""
    import pandas as pd

    most = rows.agg(F.max("k")).first()[0] or 0
    rows = rows.withColumn("draws", F.array(*[drawn(F.col("at"), i) for i in range(most)]) if most else F.array().cast("array<double>"))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("at", kind="stable")
        term = {t: i for i, t in enumerate(sorted({t for x in rows["terms"] for t in x}))}
        v = np.zeros((len(rows), len(term)))
        for i, (names, weights) in enumerate(zip(rows["terms"], rows["weights"], strict=True)):
            v[i, [term[t] for t in names]] = weights
        draws, k = np.stack(rows["draws"].to_list()), int(rows["k"].iloc[0])
        far = lambda c: np.maximum(((v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1)).round(9), 0)
        centre = v[[draws[:, 0].argmax()]]
        while len(centre) < k:
            left = far(centre).min(1)
            # The largest of u^(1/w) is drawn with a share of w.
            centre = np.vstack([centre, v[np.where(left > 0, np.log(draws[:, len(centre)]) / np.where(left > 0, left, 1), -np.inf).argmax()]])
        at = far(centre).argmin(1)
        for _ in range(rounds):
            centre = np.stack([v[at == c].mean(0) if (at == c).any() else centre[c] for c in range(k)])
            new = far(centre).argmin(1)
            if (new == at).all():
                break
            at = new
        return pd.DataFrame({"doc": rows["doc"], "at": rows["at"], "score": rows["score"], "cluster": at.astype("int32")})

    kinds = dict(rows.dtypes)
    return rows.select("doc", "at", "score", "k", "terms", "weights", "draws").groupBy("doc").applyInPandas(place, f"doc {kinds['doc']}, at {kinds['at']}, score double, cluster int")


def clusters_by_joins(rows: DataFrame, rounds: int) -> DataFrame:
    """The same, a round a join of the rules' terms with the centres' (k of them a document). Rounds are written."""
    flat = materialised(rows.select("doc", "at", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("doc", "at", F.col("x.terms").alias("term"), F.col("x.weights").alias("w")), "rule-terms")
    square = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w)
    nodes = materialised(rows.select("doc", "at", "score", "k", square.alias("square")), "rule-nodes")

    def distances(centre: DataFrame, clusters: DataFrame) -> DataFrame:
        """doc, at, cluster, far: centre (doc, cluster, term, c), clusters (doc, cluster) all of them."""
        size = clusters.join(centre.groupBy("doc", "cluster").agg(F.sum(F.col("c") * F.col("c")).alias("size")), ["doc", "cluster"], "left").fillna(0.0, ["size"])
        product = flat.join(centre, ["doc", "term"]).groupBy("doc", "at", "cluster").agg(F.sum(F.col("w") * F.col("c")).alias("product"))
        every = nodes.select("doc", "at", "square").join(size, "doc").join(product, ["doc", "at", "cluster"], "left")
        return every.select("doc", "at", "cluster", F.greatest(F.round(F.col("square") + F.col("size") - 2 * F.coalesce("product", F.lit(0.0)), 9), F.lit(0.0)).alias("far"))

    def first_of(chosen: DataFrame, cluster: int) -> tuple[DataFrame, DataFrame]:
        seeds = chosen.select("doc", F.lit(cluster).alias("cluster"), "at")
        return flat.join(seeds, ["doc", "at"]).select("doc", "cluster", "term", F.col("w").alias("c")), seeds.select("doc", "cluster")

    most = nodes.agg(F.max("k")).first()[0]
    centre, clusters = first_of(nodes.groupBy("doc").agg(F.max_by("at", F.struct(drawn(F.col("at"), 0), -F.col("at"))).alias("at")), 0)
    for turn in range(1, most):
        centre, clusters = materialised(centre, "centres"), materialised(clusters, "clusters")
        left = distances(centre, clusters).groupBy("doc", "at").agg(F.min("far").alias("left"))
        key = F.when(F.col("left") > 0, F.log(drawn(F.col("at"), turn)) / F.col("left")).otherwise(float("-inf"))
        wanted = left.join(nodes.select("doc", "at", "k"), ["doc", "at"]).where(F.col("k") > turn)
        more, named = first_of(wanted.groupBy("doc").agg(F.max_by("at", F.struct(key, -F.col("at"))).alias("at")), turn)
        centre, clusters = centre.unionByName(more), clusters.unionByName(named)
    clusters = materialised(clusters, "clusters")
    nearest = lambda c: distances(c, clusters).groupBy("doc", "at").agg(F.min_by("cluster", F.struct("far", "cluster")).alias("cluster"))
    centre = materialised(centre, "centres")
    at = materialised(nearest(centre), "clustered")
    for _ in range(rounds):
        n = at.groupBy("doc", "cluster").agg(F.count(F.lit(1)).alias("n"))
        mean = flat.join(at, ["doc", "at"]).groupBy("doc", "cluster", "term").agg(F.sum("w").alias("c")).join(n, ["doc", "cluster"]).select("doc", "cluster", "term", (F.col("c") / F.col("n")).alias("c"))
        centre = materialised(mean.unionByName(centre.join(n, ["doc", "cluster"], "left_anti")), "centres")
        new = materialised(nearest(centre), "clustered")
        changed = not new.join(at.withColumnRenamed("cluster", "old"), ["doc", "at"]).where("cluster != old").isEmpty()
        at = new
        if not changed:
            break
    return nodes.select("doc", "at", "score").join(at, ["doc", "at"])


def funnel(rules: DataFrame, steps: dict[str, Column], doc_col: str = "doc_id") -> DataFrame:
    """Per document the rules that pass the first step, the first two, and so on; one scan, one aggregate."""
    so_far, out = F.lit(True), [F.count(F.lit(1)).alias("n_raw")]
    for name, passes in steps.items():
        so_far = so_far & F.coalesce(passes, F.lit(False))
        out.append(F.count_if(so_far).alias(name))
    return rules.groupBy(doc_col).agg(*out)

"""Search: TF-IDF, vectors, rank fusion, context, and phrase graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dolomite import lexicon
from dolomite.functions.text import SPACE, strip, unused
from dolomite.operators import graphs
from dolomite.operators.provider import Embedder, embedded
from dolomite.sources.writers import materialised

#: Vectors that a task of a search for many queries holds.
BLOCK_ROWS = 50_000
#: Queries of such a search that a task holds.
QUERY_ROWS = 10_000
#: Terms whose numbers of documents go to every task.
OFTEN = 200_000
WORD = r"[\p{L}\p{N}_]{2,}"


def gram_lists(docs: DataFrame, id_col: str, text_col: str, grams: tuple[int, int], stop: Sequence[str]) -> DataFrame:
    """(id, w): a row per row of docs, w the n-grams of the words left after the stop words."""
    rows = word_lists(docs, id_col, text_col, stop)
    each = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return rows if grams == (1, 1) else rows.select("id", F.concat(*[each(n) for n in range(grams[0], grams[1] + 1)]).alias("w"))


def terms_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams: tuple[int, int] = (1, 1), stop: Sequence[str] = ()) -> DataFrame:
    """(id, term, tf): n-grams of the words left after the stop words."""
    rows = gram_lists(docs, id_col, text_col, grams, stop)
    return rows.select("id", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted_terms(docs: DataFrame, id_col: str, text_col: str, grams: tuple[int, int], stop: Sequence[str]) -> DataFrame:
    """As terms_of, written. Terms are counted within their row; only where rows share an id are counts shuffled."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def counted(batches):
        for x in batches:
            lists = x.column("w")
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)))
            many = max(len(coded.dictionary), 1)
            both, tf = np.unique(row * many + np.asarray(coded.indices), return_counts=True)
            yield pa.RecordBatch.from_arrays([x.column("id").take(pa.array(both // many)), coded.dictionary.take(pa.array(both % many)), pa.array(tf)], ["id", "term", "tf"])

    rows = gram_lists(docs, id_col, text_col, grams, stop)
    tf = rows.mapInArrow(counted, f"id {dict(rows.dtypes)['id']}, term string, tf long")
    if not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        tf = tf.groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    return materialised(tf, "terms-counted")


#: Words or n-grams of a level that may go to every task; where more could be among the most frequent, n-grams are counted as texts.
LEVEL = 1_000_000


def word_lists(docs: DataFrame, id_col: str, text_col: str, stop: Sequence[str]) -> DataFrame:
    """(id, w): the words left after the stop words."""
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    if stop:
        stops = F.array(*map(F.lit, stop))
        w = F.filter(w, lambda x: ~F.array_contains(stops, x))
    return docs.select(F.col(id_col).alias("id"), w.alias("w"))


#: Words of the documents whose counts and codes are one row.
PAGE = 100_000
#: N-grams that a task holds before it counts them.
HELD = 2_000_000


def pages_of(docs: DataFrame, id_col: str, text_col: str, stop: Sequence[str]) -> DataFrame:
    """(ids, sizes, words, counts, codes), written: documents in pages of about PAGE words, so that texts are tokenised once.

    sizes: how many words are left of each document after the stop words; words, counts: the page's distinct words and how often they come;
    codes: the places in `words` of all its documents' words one behind the other, as whole numbers of 2 bytes, or of 4 where words are many.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    stops = pa.array(list(stop), pa.string())

    def paged(batches):
        for x in few_rows(batches, 1000):
            lists = x.column("w")
            coded = lists.flatten().dictionary_encode()
            code, row = np.asarray(coded.indices), np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            left = ~pc.is_in(coded.dictionary, value_set=stops).to_numpy(zero_copy_only=False)[code]
            code, sizes = code[left], np.bincount(row[left], minlength=len(lists))
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff((ends - sizes) // PAGE, prepend=-1))
            for at, end in zip(cuts, [*cuts[1:], len(lists)], strict=True):
                once, place, count = np.unique(code[ends[at] - sizes[at] : ends[end - 1]], return_inverse=True, return_counts=True)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [x.column("id").slice(at, end - at), pa.array(sizes[at:end], pa.int32()), coded.dictionary.take(pa.array(once)), pa.array(count, pa.int64())]
                yield pa.RecordBatch.from_arrays([*map(one, columns), pa.array([place.astype(code_type(len(once))).tobytes()], pa.binary())], ["ids", "sizes", "words", "counts", "codes"])

    rows = word_lists(docs, id_col, text_col, ())
    return materialised(rows.mapInArrow(paged, f"ids array<{dict(rows.dtypes)['id']}>, sizes array<int>, words array<string>, counts array<long>, codes binary"), "word-pages")


def code_type(words: int) -> str:
    return "<u2" if words <= 1 << 16 else "<i4"


def words_of(batches, vocabulary):
    """Of each page: its row in Arrow (batch, number), and row, word of its documents' words in order; word: the place in the vocabulary or -1."""
    import numpy as np
    import pyarrow.compute as pc

    for x in batches:
        for at in range(x.num_rows):
            words, sizes = x.column("words")[at].values, np.asarray(x.column("sizes")[at].values)
            place = np.asarray(pc.fill_null(pc.index_in(words, vocabulary), -1)).astype(np.int64)
            code = np.frombuffer(x.column("codes")[at].as_buffer(), code_type(len(words)))
            yield (x, at), np.repeat(np.arange(len(sizes)), sizes), place[code]


def coded_grams(row, word, width: int, levels: Sequence):
    """row, n, code of each n-gram of rows of words that is known: words and the packed n-grams of each level from 2, ascending.

    A word's code is its place among `width` words (-1: not known); an n-gram is packed as the code of its first n - 1 words times the number of words
    plus the code of its last, its code being its place in its level.
    """
    import numpy as np

    at = np.flatnonzero(word >= 0)
    code = word[at]
    yield row[at], 1, code
    for n, level in enumerate(levels, 2):
        end = at + n - 1
        on = end < len(word)
        at, code, end = at[on], code[on], end[on]
        on = (row[end] == row[at]) & (word[end] >= 0)
        at, packed = at[on], code[on] * width + word[end[on]]
        if level is not None:
            place = np.minimum(np.searchsorted(level, packed), max(len(level) - 1, 0))
            on = level[place] == packed if len(level) else np.zeros(len(packed), bool)
            at, packed = at[on], place[on]
        yield row[at], n, packed
        code = packed


def frequent_grams(pages: DataFrame, most: int, features: int) -> list[tuple[str, ...]] | None:
    """The `features` most frequent 1- to most-grams of pages (ties by the alphabet), as tuples of words; None: more could be than LEVEL.

    Level by level: an n-gram is no more frequent than the n-1-grams it is made of, so that those under the bound so far leave it out.
    """
    import numpy as np
    import pyarrow as pa

    def best(counts: DataFrame, known: list[int]) -> tuple[int, list] | None:
        """The bound with these counts, and the rows over it."""
        top = [r[0] for r in counts.select("n").orderBy(F.desc("n")).limit(features).collect()]
        bound = min(sorted(known + top, reverse=True)[:features], default=1) if len(known) + len(top) >= features else 1
        rows = counts.where(F.col("n") >= bound).limit(LEVEL + 1).collect()
        return None if len(rows) > LEVEL else (bound, rows)

    each = pages.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("gram"))
    found = best(materialised(each.agg(F.sum("x.counts").alias("n")), "words-counted"), [])
    if found is None:
        return None
    words = sorted(r["gram"] for r in found[1])
    grams = {(r["gram"],): r["n"] for r in found[1]}
    vocabulary, levels, named = pa.array(words, pa.string()), [], [(w,) for w in words]
    for n in range(2, most + 1):

        def counted(batches, levels=tuple(levels)):
            def made():
                gram, count = np.unique(np.concatenate(held), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(count, pa.int64())], ["gram", "c"])

            held = []
            for _, row, word in words_of(batches, vocabulary):
                *_, (_, _, packed) = coded_grams(row, word, len(vocabulary), [*levels, None])
                held.append(packed)
                if sum(map(len, held)) >= HELD:
                    yield made()
                    held.clear()
            if held:
                yield made()

        if not named:
            break
        counts = materialised(pages.select("sizes", "words", "codes").mapInArrow(counted, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("n")), "grams-counted")
        found = best(counts, list(grams.values()))
        if found is None:
            return None
        rows = sorted((r["gram"], r["n"]) for r in found[1])
        levels.append(np.array([g for g, _ in rows], np.int64))
        named = [(*named[g // len(words)], words[g % len(words)]) for g, _ in rows]
        grams |= {g: c for g, (_, c) in zip(named, rows, strict=True)}
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], " ".join(x[0])))[:features]]


def known_counts(docs: DataFrame, id_col: str, text_col: str, grams: tuple[int, int], stop: Sequence[str], features: int) -> tuple[DataFrame, list[str]]:
    """(id, codes, tfs), a row of each id with a known term, and the terms: the `features` most frequent n-grams (ties by the alphabet).

    codes: ascending places among the terms. They are found first, so that of all other n-grams no row is made; what is shuffled are counts of ids
    that several rows share.
    """
    import numpy as np
    import pyarrow as pa

    pages = pages_of(docs, id_col, text_col, stop) if grams[0] == 1 else None
    known = frequent_grams(pages, grams[1], features) if pages is not None else None
    together = lambda rows: rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("code", "tf"))).alias("x")).select("id", F.col("x.code").alias("codes"), F.col("x.tf").alias("tfs"))  # noqa: E731  `features` at most
    if known is None:
        tf = materialised(terms_of(docs, id_col, text_col, grams, stop), "index-terms")
        names = [r["term"] for r in tf.groupBy("term").agg(F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(features).collect()]
        return together(tf.join(F.broadcast(numbered(docs.sparkSession, names)), "term").select("id", "code", F.col("tf").cast("int").alias("tf"))), names
    words = sorted({w for g in known for w in g})
    place, vocabulary = {w: i for i, w in enumerate(words)}, pa.array(words, pa.string())
    # A known n-gram's first words are a known n-gram too: as frequent, and before it in the alphabet.
    levels, number = [], {(w,): i for w, i in place.items()}
    for n in range(2, grams[1] + 1):
        packed = sorted((number[g[:-1]] * len(words) + place[g[-1]], g) for g in known if len(g) == n)
        levels.append(np.array([p for p, _ in packed], np.int64))
        number |= {g: i for i, (_, g) in enumerate(packed)}
    # Numbers of all levels in one: a level's n-grams behind those of the level before.
    first = np.cumsum([0, len(words), *map(len, levels)])
    terms = np.full(first[-1], -1, np.int64)
    for at, g in enumerate(known):
        terms[first[len(g) - 1] + number[g]] = at

    def told(batches):
        for (x, at), row, word in words_of(batches, vocabulary):
            rows, code = zip(*((r, terms[first[n - 1] + c]) for r, n, c in coded_grams(row, word, len(vocabulary), levels)), strict=True)
            rows, code = np.concatenate(rows), np.concatenate(code)
            both, tf = np.unique((rows * max(len(known), 1) + code)[code >= 0], return_counts=True)
            rows, begins = np.unique(both // max(len(known), 1), return_index=True)
            ends = pa.array(np.append(begins, len(both)), pa.int32())
            each = (pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (both % max(len(known), 1), tf))
            yield pa.RecordBatch.from_arrays([x.column("ids")[at].values.take(pa.array(rows)), *each], ["id", "codes", "tfs"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    counts = pages.select("ids", "sizes", "words", "codes").mapInArrow(told, f"id {kind}, codes array<int>, tfs array<int>")
    if not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        each = counts.select("id", F.explode(F.arrays_zip("codes", "tfs")).alias("x")).groupBy("id", F.col("x.codes").alias("code"))
        counts = together(each.agg(F.sum("x.tfs").cast("int").alias("tf")))
    return counts, [" ".join(g) for g in known]


def numbered(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(code, term): names and their places."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"code": pa.array(range(len(names)), pa.int32()), "term": pa.array(names, pa.string())}))


def known_terms(docs: DataFrame, id_col: str, text_col: str, grams: tuple[int, int], stop: Sequence[str], features: int) -> DataFrame:
    """(id, term, tf) of the `features` most frequent n-grams alone (ties by the alphabet), written."""
    counts, names = known_counts(docs, id_col, text_col, grams, stop, features)
    tf = materialised(counts, "known-terms").select("id", F.explode(F.arrays_zip("codes", "tfs")).alias("x")).select("id", F.col("x.codes").alias("code"), F.col("x.tfs").cast("long").alias("tf"))
    return tf.join(F.broadcast(numbered(docs.sparkSession, names)), "code").select("id", "term", "tf")  # `features` rows


def with_df(tf: DataFrame, most: int = OFTEN) -> DataFrame:
    """tf (id, term, tf; written) with df, how many ids have the term.

    The `most` terms of the most ids, which are most rows, go to every task; rows of other terms alone are shuffled. Where no more are of two
    ids or more none are: terms that are not among them have one.
    """
    stats = materialised(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "document-counts")
    if stats.limit(most + 1).count() <= most:
        return tf.join(F.broadcast(stats), "term", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    least, seen = 0, 0
    for r in stats.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).collect():  # a row per number of ids
        if (seen := seen + r["n"]) > most:
            least = r["df"] + 1
            break
    often = F.broadcast(stats.where(F.col("df") >= least))
    rest = tf.join(often, "term", "left_anti").join(stats.where(F.col("df") < least).hint("merge"), "term", "left")
    return tf.join(often, "term").unionByName(rest.withColumn("df", F.coalesce("df", F.lit(1))))


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams: tuple[int, int] = (1, 1), stop: Sequence[str] = (), features: int | None = None, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """(id, term, weight): tf (ln((1 + n) / (1 + df)) + 1), each document's vector of length 1.

    features: so many terms of the highest total tf (ties by the alphabet), which is the vocabulary's size by definition.
    """
    tf = counted_terms(docs, id_col, text_col, grams, stop)
    n = docs.agg(F.count(F.lit(1)).alias("n"))  # a single row
    if features:
        stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
        known = tf.join(stats.where(F.col("df") <= max_df if max_df is not None else F.lit(True)).orderBy(F.desc("total"), "term").limit(features), "term")
    else:
        known = with_df(tf).where((F.col("df") >= min_df) & (F.col("df") <= max_df if max_df is not None else F.lit(True)))
    # Dealt out before the weights are made: whole numbers are less to shuffle.
    raw = known.select("id", "term", "tf", "df").repartition("id").crossJoin(F.broadcast(n)).select("id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # the terms of one document
    return raw.select("id", "term", (F.col("w") / length).alias("weight"))


def keyword_search(docs: DataFrame, query: str, k: int = 10, least: float = 0.1, id_col: str = "doc_id", text_col: str = "text", grams: tuple[int, int] = (1, 3), stop: Sequence[str] = lexicon.ENGLISH, features: int = 5000) -> DataFrame:
    """(id, score): cosine of the query's TF-IDF vector with each document's over `least`, the top k (ties by id).

    The vocabulary has `features` n-grams, the most frequent ones (ties by the alphabet), so its table is small by definition and
    goes to every task; a document's length and its product with the query come from one pass over its terms.
    """
    import re
    from collections import Counter

    stops, found = set(stop), re.findall(r"\w{2,}", query.lower())
    w = [x for x in found if x not in stops]
    asked = Counter(" ".join(w[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1))
    if not asked:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    tf = known_terms(docs, id_col, text_col, grams, stop, features)
    known = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))  # a single row
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    of = F.create_map(*[F.lit(x) for item in asked.items() for x in item])
    vocabulary = known.crossJoin(F.broadcast(n)).select("term", idf.alias("idf"), F.coalesce(of[F.col("term")], F.lit(0)).alias("q"))
    weighed = tf.join(F.broadcast(vocabulary), "term")  # `features` rows
    size = vocabulary.agg(F.sqrt(F.sum(F.pow(F.col("q") * F.col("idf"), 2))).alias("q_size"))
    w_ = F.col("tf") * F.col("idf")
    each = weighed.groupBy("id").agg(F.sqrt(F.sum(w_ * w_)).alias("size"), F.sum(w_ * F.col("q") * F.col("idf")).alias("product"))
    scored = each.crossJoin(F.broadcast(size)).select("id", F.try_divide("product", F.col("size") * F.col("q_size")).alias("score"))
    return scored.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k)


def context_reranked(hits: DataFrame, query: str, k: int, stop: Sequence[str] = lexicon.ENGLISH, features: int = 3000) -> DataFrame:
    """hits (id, text, score; a few dozen) with score: the cosine of 1- to 2-gram TF-IDF vectors fitted on the query and the hits' texts.

    The top k, ties by the score before. A blank query gives the first k as they are.
    """
    if not query.strip():
        return hits.orderBy(F.desc("score"), "id").limit(k)
    (place,) = unused(hits, "place")
    rows = hits.withColumn(place, F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # hits of a search
    asked = hits.sparkSession.createDataFrame([(0, query)], f"{place} int, text string")
    weights = tfidf(rows.select(place, "text").unionByName(asked), place, "text", (1, 2), stop, features)
    near = weights.where("id > 0").alias("a").join(weights.where("id = 0").alias("b"), "term").groupBy(F.col("a.id").alias(place)).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("cosine"))
    return rows.join(near, place, "left").withColumn("score", F.coalesce("cosine", F.lit(0.0))).orderBy(F.desc("score"), place).limit(k).drop("cosine", place)


def similarity_search(rows: DataFrame, query: str, vector: Sequence[float], k: int = 5, least: float = 0.0, where: dict | None = None, hybrid: bool = True, rerank: bool = True, grams: tuple[int, int] = (1, 3), stop: Sequence[str] = lexicon.ENGLISH) -> DataFrame:
    """(id, text, score): by vectors, fused with keywords where more than ten rows are there; four times k are fetched and reranked to k.

    rows: id, text, embedding. Rows of equal text are one, by the least id. `where` holds for the vectors' side alone.
    """
    fetch = 4 * k if rerank else k
    found = vector_search(rows, vector, fetch, least, where, "id", "embedding")
    texts = rows.select("id", "text")
    if hybrid and rows.limit(11).count() > 10:
        words = keyword_search(texts, query, fetch, 0.1, "id", "text", grams, stop)
        found = fused_by_text([x.join(texts, "id") for x in (found, words)], fetch)
    else:
        found = found.join(texts, "id")
    return context_reranked(found.select("id", "text", "score"), query, k, stop) if rerank else found.select("id", "text", "score").orderBy(F.desc("score"), "id").limit(k)


def fused_by_text(ranked: Sequence[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """As fused, of lists (id, text, score): what has the same text is one, and a list's second place for it counts too."""
    every = None
    for i, r in enumerate(ranked):
        part = r.select("id", "text", F.lit(i).alias("list"), "score")
        every = part if every is None else every.unionByName(part)
    ranks = every.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id")))  # lists of k rows
    return ranks.groupBy("text").agg(F.min("id").alias("id"), F.sum(1 / (constant + F.col("rank"))).alias("score")).select("id", "text", "score").orderBy(F.desc("score"), "id").limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normal(v: Column) -> Column:
    """Of length 1; zeros stay zeros. Scaling by domain before this changes no cosine, so there is none."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), F.sqrt(dot(v, v))), F.lit(0.0)))


def vector_search(rows: DataFrame, query: Sequence[float], k: int = 10, least: float | None = None, where: dict | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): cosine top k (ties by id), 0 where a vector is zero. where: numbers ask for at least that, other values for equality."""
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name) >= value if isinstance(value, (int, float)) and not isinstance(value, bool) else F.col(name) == value)
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(float(x) ** 2 for x in query) ** 0.5
    lengths = F.sqrt(dot(F.col(vector_col), F.col(vector_col))) * size
    scored = rows.select(F.col(id_col).alias("id"), F.coalesce(F.try_divide(dot(F.col(vector_col), q), lengths), F.lit(0.0)).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def vector_search_many(rows: DataFrame, queries: DataFrame, k: int = 10, blocks: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None) -> DataFrame:
    """(query_id, id, score): the cosine top k of every query vector over all rows (ties by id; a query finds itself too).

    Rows are dealt to blocks of about BLOCK_ROWS, queries to parts of about QUERY_ROWS, and every part meets every block; a task multiplies matrices in bounded pieces and
    hands on its own top k of each query, so what is ranked at last is k rows a block and query.
    """
    import pandas as pd

    blocks = blocks or max(1, rows.rdd.getNumPartitions(), -(-rows.count() // BLOCK_ROWS))
    parts = parts or max(1, -(-queries.count() // QUERY_ROWS))
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"), every(parts, "part"))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q"), F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(parts)).alias("part"), every(blocks, "block"))

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        unit = lambda c: (m := np.stack(c.to_list())) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        left = left.sort_values("id")
        v, ids, out = unit(left["v"]), left["id"].to_numpy(), []
        step = max(1, 4_000_000 // len(ids))
        for a in range(0, len(right), step):
            part = right.iloc[a : a + step]
            score = unit(part["q"]) @ v.T
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), top.shape[1]), "id": ids[top.ravel()], "score": np.take_along_axis(score, top, 1).ravel()}))
        return pd.concat(out)

    found = own.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(best, "query_id long, id long, score double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k).drop("r")


def fused(*ranked: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """(id, score) of ranked top-k lists (id, score): sum of 1 / (constant + rank), ranks from 1, over the lists."""
    every = None
    for i, r in enumerate(ranked):
        part = r.select("id", F.lit(i).alias("list"), "score")
        every = part if every is None else every.unionByName(part)
    ranks = every.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id")))  # lists of k rows
    return ranks.groupBy("id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def with_context(hits: DataFrame, rows: DataFrame, source: str = "source", id_col: str = "id", text_col: str = "text", most: int = 3, least: float = 0.5) -> DataFrame:
    """hits (id, source, text, score) with the texts of up to most - 1 others of the same source over `least`, best first."""
    i, t, s, r, n = unused(hits, "other_id", "other_text", "other_score", "place", "others")
    others = rows.where(F.col("score") > least).select(F.col(source), F.col(id_col).alias(i), F.col(text_col).alias(t), F.col("score").alias(s))
    near = hits.join(others, source).where(F.col(id_col) != F.col(i))
    near = near.withColumn(r, F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(s), i))).where(F.col(r) < most)
    joined = near.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(r, t))).alias(n))
    out = hits.join(joined, id_col, "left")
    texts = F.concat(F.array(F.col(text_col)), F.coalesce(F.transform(n, lambda x: x[t]), F.array().cast("array<string>")))
    return out.withColumns({"context": F.array_join(texts, " ... "), "context_size": F.size(texts) - 1}).drop(n)


def phrase_arrays(w: Column, most: int, stop: Sequence[str]) -> Column:
    """The 1- to most-grams of words over two characters, at most half of whose words are stop words, each an array of words."""
    stops = F.array(*map(F.lit, stop))
    each = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))
    found = F.concat(*[each(n) for n in range(1, most + 1)])
    return F.filter(found, lambda p: (F.size(F.filter(p, lambda x: F.array_contains(stops, x))) / F.size(p) <= 0.5) & (F.length(F.array_join(p, " ")) > 2))


def phrase_lists(docs: DataFrame, most: int = 3, stop: Sequence[str] = lexicon.STOPWORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, phrases): phrases as an ascending array, and a bound of their number; texts of one id together, which are all that is shuffled."""
    texts = docs.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(text_col).alias("texts"))
    w = texts.select("id", F.transform("texts", lambda x: F.filter(F.split(F.lower(x), SPACE), lambda y: y != "")).alias("ws"))
    n = F.aggregate("ws", F.lit(0), lambda s, x: s + most * F.size(x))
    found = F.transform(F.flatten(F.transform("ws", lambda x: phrase_arrays(x, most, stop))), lambda p: F.array_join(p, " "))
    return w.select("id", n.alias("n"), F.array_sort(F.array_distinct(found)).alias("phrases"))


def pairs_of(lists):
    """row, a, b, shared, longer of an Arrow array of phrase lists: the pairs a < b of places (in all its phrases) of a row that share words."""
    import numpy as np
    import pyarrow.compute as pc

    words = pc.split_pattern(lists.flatten(), " ")
    row_of = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    code = np.asarray(words.flatten().dictionary_encode().indices).astype(np.int64)
    phrase = np.repeat(np.arange(len(words)), np.asarray(pc.list_value_length(words)))
    once = np.unique(phrase * (span := int(code.max(initial=0)) + 1) + code)  # a phrase's distinct words
    phrase, code = once // span, once % span
    n = np.bincount(phrase, minlength=len(words))
    order = np.lexsort((phrase, code, row_of[phrase]))
    phrase, key = phrase[order], row_of[phrase[order]] * span + code[order]
    last = np.searchsorted(key, key, "right")
    length = last - np.arange(len(key)) - 1
    a = np.repeat(phrase, length)
    b = phrase[np.repeat(np.arange(len(key)) + 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())]
    met, shared = np.unique(a * max(len(words), 1) + b, return_counts=True)
    a, b = met // max(len(words), 1), met % max(len(words), 1)
    return row_of[a], a, b, shared, np.maximum(n[a], n[b])


def few_rows(batches, rows: int = 256):
    """Batches of at most so many rows, which a worker holds at once with what it makes of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def local_graphs(lists: DataFrame) -> DataFrame:
    """As phrase_graph of phrase_lists, made row by row."""

    def run(batches):
        import pyarrow as pa

        for x in few_rows(batches):
            row, a, b, shared, longer = pairs_of(x.column("phrases"))
            text = x.column("phrases").flatten()
            yield pa.RecordBatch.from_arrays([x.column("id").take(pa.array(row)), text.take(pa.array(a)), text.take(pa.array(b)), pa.array(shared + shared / longer)], ["id", "src", "dst", "weight"])

    return lists.select("id", "phrases").mapInArrow(run, f"id {dict(lists.dtypes)['id']}, src string, dst string, weight double")


def graph_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2_000) -> DataFrame:
    """phrase_graph of the phrases of docs: of an id with at most `most` phrases within its row, of others by joins. Edges are not shuffled for the former."""
    lists = phrase_lists(docs, id_col=id_col, text_col=text_col)
    return local_graphs(lists.where(F.col("n") <= most)).unionByName(phrase_graph(lists.where(F.col("n") > most).select("id", F.explode("phrases").alias("phrase"))))


def phrase_words(texts, stop: Sequence[str], most: int):
    """row, words, dictionary of an Arrow array of lists of texts in lower case: each row's distinct phrases (as phrase_arrays) by row, as `most` rows of places in the dictionary (-1: none)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    length = lambda lists: np.asarray(pc.list_value_length(lists))
    words = pc.split_pattern_regex(texts.flatten(), SPACE)
    coded = words.flatten().dictionary_encode()
    dictionary = coded.dictionary
    size, stopped = np.asarray(pc.utf8_length(dictionary)).astype(np.int64), pc.is_in(dictionary, value_set=pa.array(list(stop), pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    code, text = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(words)), length(words))
    code, text = code[size[code] > 0], text[size[code] > 0]
    row, width, found = np.repeat(np.arange(len(texts)), length(texts))[text], len(dictionary) + 1, []
    for n in range(1, most + 1):
        at = np.arange(max(len(code) - n + 1, 0))
        at = at[text[at] == text[at + n - 1]]
        on = (2 * sum(stopped[code[at + i]] for i in range(n)) <= n) & (sum(size[code[at + i]] for i in range(n)) + n - 1 > 2)
        key = row[at := at[on]]
        for i in range(most):
            key = key * width + (code[at + i] + 1 if i < n else 0)
        found.append(key)
    key = np.sort(np.concatenate(found))
    key = key[np.diff(key, prepend=-1) > 0]
    places = []
    for _ in range(most):
        key, place = np.divmod(key, width)
        places.append(place - 1)
    return key, np.stack(places[::-1]), dictionary


def phrase_texts(words, dictionary):
    """The phrases of places of words in a dictionary (Arrow), as texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(*(dictionary.take(pa.array(w, mask=w < 0)) for w in words), " ", null_handling="skip")


def ranked_phrases(texts, rounds: int, damping: float, keep: int, stop: Sequence[str] = lexicon.STOPWORDS, most: int = 3):
    """row, phrase, score of an Arrow array of lists of texts in lower case: the best `keep` phrases of each row's graph, as `ranked` of its pairs.

    No pairs are made: the weight of two phrases hangs on the words they share and on the longer one's length alone, so that a round adds scores up
    by word and length of phrase and hands the sums on to the phrases of the word. All rows' graphs are ranked side by side.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    row, words, dictionary = phrase_words(texts, stop, most)
    once = words.copy()  # a phrase's distinct words
    for i in range(1, most):
        for j in range(i):
            once[i, words[i] == words[j]] = -1
    n = (once >= 0).sum(0)
    # Sums are kept by word of a row and number of distinct words; weights are times the least common multiple of those, so that they are whole.
    unit = int(np.lcm.reduce(np.arange(1, most + 1)))
    longer = np.maximum.outer(np.arange(1, most + 1), np.arange(1, most + 1))
    weight = (unit + unit // longer).astype(float)
    there, base = np.zeros(len(texts) * len(dictionary), bool), row * len(dictionary)
    for w in once:
        there[(base + w)[w >= 0]] = True
    word, number = np.flatnonzero(there), np.zeros(len(there), np.int64)
    number[word] = np.arange(len(word))
    place = np.stack([np.where(w >= 0, number[base + w] * most + n - 1, len(word) * most) for w in once])
    own, held = n * weight[n - 1, n - 1], np.zeros(len(word) * most + 1)  # its last is of no word

    def given(score, place, own):
        """What phrases get of the others' scores; place: a row a word of theirs."""
        sums = np.bincount(place.ravel(), np.tile(score, most), len(held))[:-1]
        np.matmul(sums.reshape(-1, most), weight, out=held[:-1].reshape(-1, most))
        return sum(held.take(p) for p in place) - own * score

    out = given(np.ones(len(row)), place, own)
    joined = out > 0  # phrases that share no word are not in the graph
    row, words, place, own, out = row[joined], words.compress(joined, 1), place.compress(joined, 1), own[joined], out[joined]
    nodes = np.bincount(row, minlength=len(texts))
    final, open_, left, r = np.zeros(len(row)), nodes > 0, np.arange(len(row)), row
    score, rest, begins = 1 / nodes[row], (1 - damping) / nodes[row], np.flatnonzero(np.diff(row, prepend=-1))
    for _ in range(rounds):
        if not open_.any():
            break
        new = rest + damping * given(score / out, place, own)
        graph = r[begins]
        graph = graph[open_[graph] & (np.add.reduceat(np.abs(new - score), begins) < 1e-6 * nodes[graph])]
        score = new
        if len(graph):
            going = open_[r]
            open_[graph] = False
            mine, going = going & ~open_[r], open_[r]
            final[left[mine]] = new[mine]
            if going.mean() < 0.75:  # else those that stand still are let run along
                place, left, r, score, rest, own, out = place.compress(going, 1), left[going], r[going], score[going], rest[going], own[going], out[going]
                begins = np.flatnonzero(np.diff(r, prepend=-1))
    for graph in np.flatnonzero(open_):  # they do not converge: degree centrality
        mine = np.flatnonzero(row == graph)
        _, a, b, *_ = pairs_of(pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), phrase_texts(words[:, mine], dictionary)))
        final[mine] = np.bincount(np.concatenate([a, b]), minlength=len(mine)) / max(len(mine) - 1, 1)
    near = np.round(final, 12)
    grid = np.full((len(texts), max(nodes.max(initial=0), keep)), -1.0)
    grid[row, np.arange(len(row)) - (np.cumsum(nodes) - nodes)[row]] = near
    bar = np.partition(grid, -keep, 1)[:, -keep]
    some = np.flatnonzero(near >= bar[row])  # with those as good as the last
    text = phrase_texts(words[:, some], dictionary)
    order = np.asarray(pc.sort_indices(pa.table({"row": row[some], "score": near[some], "text": text}), sort_keys=[("row", "ascending"), ("score", "descending"), ("text", "ascending")])).astype(np.int64)
    r = row[some][order]
    order = order[np.arange(len(r)) - np.searchsorted(r, r) < keep]
    return row[some][order], text.take(pa.array(order)), np.minimum(2 * final[some][order], 1.0)


def rank_of_texts(docs: DataFrame, rounds: int = 100, damping: float = 0.85, keep: int = 5, id_col: str = "doc_id", text_col: str = "text", most: int = 2_000) -> DataFrame:
    """text_rank of the graphs of docs' phrases: of an id with at most `most` phrases within its row, of others by joins. Neither edges nor phrases of the former are shuffled."""
    texts = docs.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(text_col).alias("texts"))
    n = F.aggregate("texts", F.lit(0), lambda s, x: s + 3 * F.size(F.split(x, SPACE)))
    texts = materialised(texts.select("id", F.transform("texts", F.lower).alias("texts"), n.alias("n")), "texts-together")

    def run(batches):
        import pyarrow as pa

        for x in few_rows(batches, 128):
            row, phrase, score = ranked_phrases(x.column("texts"), rounds, damping, keep)
            yield pa.RecordBatch.from_arrays([x.column("id").take(pa.array(row)), phrase, pa.array(score)], ["id", "phrase", "score"])

    found = texts.where(F.col("n") <= most).select("id", "texts").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, phrase string, score double")
    large = texts.where(F.col("n") > most)
    if large.isEmpty():
        return found
    lists = phrase_lists(large.select("id", F.explode("texts").alias("text")), id_col="id")
    edges = materialised(phrase_graph(lists.select("id", F.explode("phrases").alias("phrase"))), "large-graphs")
    return found.unionByName(text_rank(edges, rounds, damping, keep))


def phrases(docs: DataFrame, most: int = 3, stop: Sequence[str] = lexicon.STOPWORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phrase): distinct 1- to most-grams over two characters, at most half of whose words are stop words."""
    w = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SPACE), lambda x: x != "")
    rows = docs.select(F.col(id_col).alias("id"), w.alias("w"))
    return rows.select("id", F.explode(phrase_arrays(F.col("w"), most, stop)).alias("p")).select("id", F.array_join("p", " ").alias("phrase")).distinct()


def phrase_graph(candidates: DataFrame) -> DataFrame:
    """(id, src, dst, weight), src < dst: words shared by two phrases of a document, and their share of the longer one.

    Phrases meet by the words they share; a document's own phrases bound the join. Neither side is broadcast: it is far larger than Spark takes
    it to be, which does not know what explode makes of a row.
    """
    w = candidates.select("id", "phrase", F.array_distinct(F.split("phrase", " ")).alias("ws"))
    by = w.select("id", "phrase", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    pairs = by.alias("a").join(by.alias("b").hint("merge"), (F.col("a.id") == F.col("b.id")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.phrase") < F.col("b.phrase")))
    shared = pairs.groupBy("a.id", F.col("a.phrase").alias("src"), F.col("b.phrase").alias("dst")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.greatest("a.n", "b.n")).alias("longer"))
    return shared.select("id", "src", "dst", (F.col("shared") + F.col("shared") / F.col("longer")).alias("weight"))


def ranked(src, dst, weight, rounds: int, damping: float, keep: int):
    """The best `keep` nodes of one graph and their scores; src, dst: nodes as ascending numbers."""
    import numpy as np

    nodes, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, w = place, np.concatenate([place[len(src) :], place[: len(src)]]), np.tile(weight, 2)
    out = np.bincount(a, w, len(nodes))
    share = w / np.where(out > 0, out, 1)[a]
    score, done = np.full(len(nodes), 1 / len(nodes)), False
    for _ in range(rounds):
        new = (1 - damping) / len(nodes) + damping * (np.bincount(b, share * score[a], len(nodes)) + score[out <= 0].sum() / len(nodes))
        done = np.abs(new - score).sum() < 1e-6 * len(nodes)
        score = new
        if done:
            break
    if not done:
        score = np.bincount(a, minlength=len(nodes)) / max(len(nodes) - 1, 1)
    best = np.lexsort((nodes, -np.round(score, 12)))[:keep]
    return nodes[best], np.minimum(2 * score[best], 1.0)


def text_rank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, keep: int = 5, most: int = 500_000) -> DataFrame:
    """(id, phrase, score): PageRank of each document's own graph, least of 2 score and 1; the best `keep` of each.

    A graph of at most `most` edges is ranked whole in one group, a larger one in rounds of joins (graphs.page_rank) with the same result.
    Where the rounds do not converge, degree centrality takes the place of rank.
    """
    import pandas as pd

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        nodes, place = np.unique(np.concatenate([rows["src"], rows["dst"]]).astype(str), return_inverse=True)
        best, score = ranked(place[: len(rows)], place[len(rows) :], rows["weight"].to_numpy(), rounds, damping, keep)
        return pd.DataFrame({"id": rows["id"].iloc[0], "phrase": nodes[best], "score": score})

    few, many = graphs.in_groups(edges, most)
    small = few.groupBy("id").applyInPandas(rank, f"id {dict(edges.dtypes)['id']}, phrase string, score double")
    if many.isEmpty():
        return small
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 12)), "phrase"))
    large = graphs.page_rank(materialised(many, "large-graphs"), rounds, damping).withColumn("r", place).where(F.col("r") <= keep)
    return small.unionByName(large.select("id", "phrase", F.least(2 * F.col("score"), F.lit(1.0)).alias("score")))


def optimised_text(text: Column, density: Column, key_phrases: Column) -> Column:
    """Texts of low density begin with their key phrases. key_phrases: array of (phrase, score)."""
    strong = F.transform(F.filter(key_phrases, lambda p: p["score"] > 0.3), lambda p: p["phrase"])
    return F.when((density <= 0.1) & (F.size(strong) > 0), F.concat(F.lit("Key concepts: "), F.array_join(strong, ", "), F.lit(". "), text)).otherwise(text)


def add_texts(store: str, rows: DataFrame, id_col: str = "text") -> DataFrame:
    """Appends rows with id = md5 of the text, so that a repeated write gives equal ids; readers take one row of each."""
    out = rows.withColumn("id", F.md5(F.col(id_col).cast("binary")))
    out.write.mode("append").parquet(store)
    return out


def create_store(spark: SparkSession, store: str, schema: str = "id string, text string, embedding array<double>") -> DataFrame:
    """The store's rows; an empty one is written where there is none."""
    try:
        return spark.read.schema(schema).parquet(store)
    except AnalysisException:
        spark.createDataFrame([], schema).write.parquet(store)
        return spark.read.schema(schema).parquet(store)


def store_chunks(store: str, chunks: DataFrame, embedder: Embedder, text_col: str = "chunk") -> DataFrame:
    """Appends the chunks that are not blank with their metadata, embedding and id; embeddings are made once, by the write."""
    texts = chunks.where(strip(F.col(text_col)) != "").withColumnRenamed(text_col, "text")
    create_store(chunks.sparkSession, store)
    add_texts(store, embedded(texts, embedder, "text"))
    return chunks.sparkSession.read.option("mergeSchema", "true").parquet(store)


def delete_by(rows: DataFrame, where: dict) -> DataFrame:
    """rows without those that equal all the given values."""
    hit = F.lit(True)
    for name, value in where.items():
        hit = hit & F.col(name).eqNullSafe(F.lit(value))
    return rows.where(~hit)


def collection_stats(rows: DataFrame, sample: int = 100, id_col: str = "doc_id") -> DataFrame:
    """total over all rows; the means and the share over 0.1 over the first `sample` by id, which is this report's definition."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    first = rows.orderBy(id_col).limit(sample)
    means = first.agg(F.avg("density").alias("mean_density"), F.avg("word_count").alias("mean_words"), F.avg((F.col("density") > 0.1).cast("double")).alias("dense_share"))
    return total.crossJoin(F.broadcast(means))  # one row each

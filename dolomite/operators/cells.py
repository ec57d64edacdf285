"""Vector search by an inverted file: rows stored by the k-means cell they lie in, queries compared with the nearest cells alone.

The cells' centres come from a bounded sample (FIT_EACH unit vectors a cell, chosen by a hash of the identifier); every row is stored. A
search probes the nearest cells, as many as tuned() measured for a recall; exact=True goes on, for the queries for which a cell not probed could still hold a better row by
the triangle inequality of angles, with those cells. A cell with more than BLOCK rows, or asked by more than BLOCK queries, is
compared in parts, so that no task holds more than a block of each.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dolomite.sources.writers import materialised

FIT_EACH, ROUNDS, BLOCK = 64, 12, 50_000
#: Angles are widened by this much, so that rounding excludes no cell.
SLACK = 1e-6


def units(vectors):
    import numpy as np

    m = np.asarray(vectors, float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fitted(rows: DataFrame, cells: int, id_col: str = "vec_id", vector_col: str = "embedding"):
    """Centres (unit vectors): Lloyd's rounds on the sample, begun with its first rows by hash; an empty cell keeps its centre."""
    import numpy as np

    place = F.xxhash64(F.lit(3), id_col)
    near = rows.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"), place.alias("h")).orderBy("h").limit(FIT_EACH * cells)
    sample = near.toPandas().sort_values("h", kind="stable")
    if sample.empty:
        return np.zeros((0, 0))
    v = units(np.stack(sample["v"].to_list()))
    centre = np.unique(v.round(12), axis=0)
    centre = units(centre[np.random.default_rng(5).permutation(len(centre))[:cells]])
    for _ in range(ROUNDS):
        at = (v @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, at, v)
        centre = units(np.where((np.bincount(at, minlength=len(centre)) > 0)[:, None], sums, centre))
    return centre


@dataclass(frozen=True)
class CellIndex:
    """A stored index: folder/rows/cell=<n> (id, v: unit vector), folder/cells (cell, n, nearness: least cosine to the centre), folder/centres."""

    spark: SparkSession
    folder: str

    @staticmethod
    def write(rows: DataFrame, folder: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> CellIndex:
        """cells: by default the square root of the number of rows, at most 16,384. Null vectors are in no cell."""
        import numpy as np

        cells = cells or int(min(16_384, max(1, round(rows.count() ** 0.5))))
        centre = fitted(rows, cells, id_col, vector_col)
        spark = rows.sparkSession
        shared = spark.sparkContext.broadcast(centre)

        def assign(batches):
            for b in batches:
                v = units(np.stack(b["v"].to_list())) if len(b) else np.zeros((0, centre.shape[1]))
                score = v @ shared.value.T
                at = score.argmax(1) if len(b) else np.zeros(0, int)
                yield pd.DataFrame({"id": b["id"], "v": list(v), "near": score[np.arange(len(v)), at], "cell": at.astype("int32")})

        own = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        kind = dict(own.dtypes)["id"]
        placed = own.mapInPandas(assign, f"id {kind}, v array<double>, near double, cell int")
        # Cells to tasks by hash; a cell of many rows is dealt to several files.
        placed.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{folder}/rows")
        stored = spark.read.schema(f"id {kind}, v array<double>, near double, cell int").parquet(f"{folder}/rows")
        stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("nearness")).write.parquet(f"{folder}/cells")
        spark.createDataFrame([(json.dumps(c.tolist()),) for c in centre], "centre string").withColumn("cell", F.monotonically_increasing_id()).coalesce(1).write.parquet(f"{folder}/centres")
        return CellIndex(spark, folder)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def _centres(self):
        import numpy as np

        rows = self.spark.read.parquet(f"{self.folder}/centres").orderBy("cell").collect()  # as many as cells
        return np.array([json.loads(r["centre"]) for r in rows])

    def probed(self, queries: DataFrame, probes: int, id_col: str, vector_col: str) -> DataFrame:
        """query_id, q, cells: the nearest `probes` cells of each query, and `bounds`: of every cell the greatest cosine that a row of it could have."""
        import numpy as np

        centre = self._centres()
        known = {r["cell"]: r["nearness"] for r in self.spark.read.parquet(f"{self.folder}/cells").collect()}
        radius = np.array([np.arccos(np.clip(known.get(c, 2.0), -1, 1)) if c in known else -np.inf for c in range(len(centre))])
        shared = self.spark.sparkContext.broadcast((centre, radius))

        def find(batches):
            centre, radius = shared.value
            filled = np.flatnonzero(radius >= 0)
            for b in batches:
                if not len(b):
                    continue
                q = units(np.stack(b["q"].to_list()))
                score = q @ centre.T
                order = filled[np.argsort(-score[:, filled], axis=1, kind="stable")]
                bound = np.cos(np.maximum(np.arccos(np.clip(score, -1, 1)) - np.maximum(radius, 0) - SLACK, 0.0))
                yield pd.DataFrame({"query_id": b["query_id"], "q": list(q), "cells": list(order[:, :probes].astype("int32")), "rest": list(order[:, probes:].astype("int32")), "bounds": [x[o] for x, o in zip(bound, order[:, probes:], strict=True)]})

        own = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q"))
        return own.mapInPandas(find, f"query_id {dict(own.dtypes)['query_id']}, q array<double>, cells array<int>, rest array<int>, bounds array<double>")

    def compared(self, asked: DataFrame, k: int, block: int) -> DataFrame:
        """(query_id, id, score), the best k of each query and part: asked (query_id, q, cell) with the rows of its cell."""
        sizes = self.spark.read.parquet(f"{self.folder}/cells").select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        parts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        shape = F.broadcast(sizes.join(parts, "cell"))  # a row a cell
        of = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows().join(shape, "cell").select("cell", of("id", "blocks", 1).alias("block"), every("parts").alias("part"), "id", "v")
        right = asked.join(shape, "cell").select("cell", every("blocks").alias("block"), of("query_id", "parts", 2).alias("part"), "query_id", "q")

        def best(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            import numpy as np

            if not len(mine) or not len(theirs):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            mine = mine.sort_values("id")
            v, ids, out = np.stack(mine["v"].to_list()), mine["id"].to_numpy(), []
            step = max(1, 4_000_000 // len(ids))
            for a in range(0, len(theirs), step):
                some = theirs.iloc[a : a + step]
                score = np.stack(some["q"].to_list()) @ v.T
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), top.shape[1]), "id": ids[top.ravel()], "score": np.take_along_axis(score, top, 1).ravel()}))
            return pd.concat(out)

        keys = ["cell", "block", "part"]
        kinds = dict(left.dtypes) | dict(right.dtypes)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")

    def tuned(self, k: int = 10, target: float = 0.95, sample: int = 400) -> int:
        """The least number of probes with which so large a share of the true top k of `sample` rows (by hash) is found.

        One full scan for the sample's truth; then each neighbour's cell has a place in its query's order of cells, and that is all
        that a number of probes decides.
        """
        rows = self.rows()
        asked = materialised(rows.select("id", "v").orderBy(F.xxhash64(F.lit(9), "id")).limit(sample), "tuning-queries")
        cells = self.spark.read.parquet(f"{self.folder}/cells").count()
        order = self.probed(asked, cells, "id", "v").select("query_id", F.posexplode("cells").alias("place", "cell"))
        truth = self.compared(self.probed(asked, cells, "id", "v").select("query_id", "q", F.explode("cells").alias("cell")), k, BLOCK)
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        truth = truth.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).join(rows.select("id", "cell"), "id")
        found = truth.join(order, ["query_id", "cell"]).groupBy("place").count().orderBy("place").collect()  # a row a cell at most
        total, so_far = sum(r["count"] for r in found), 0
        for r in found:
            so_far += r["count"]
            if so_far >= target * total:
                return r["place"] + 1
        return max(1, cells)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
        """(query_id, id, score): the cosine top k (ties by id) among the rows of the nearest cells; exact: among all rows."""
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

        def ranked(found: DataFrame) -> DataFrame:
            return found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")

        if not len(self._centres()):
            kind = dict(queries.dtypes)[id_col]
            return self.spark.createDataFrame([], f"query_id {kind}, id {kind}, score double")
        asked = materialised(self.probed(queries, probes, id_col, vector_col), "probes")
        found = ranked(self.compared(asked.select("query_id", "q", F.explode("cells").alias("cell")), k, block))
        if not exact:
            return found
        found = materialised(found, "probed")
        worst = found.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
        open_ = F.filter(F.arrays_zip("rest", "bounds"), lambda c: (F.col("n") < k) | (c["bounds"] >= F.col("worst")))
        left = asked.join(worst, "query_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "worst": F.coalesce("worst", F.lit(-2.0))})
        more = materialised(left.select("query_id", "q", F.explode(F.transform(open_, lambda c: c["rest"])).alias("cell")), "probes-left")
        return ranked(found.unionByName(self.compared(more, k, block)))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth (query_id, id) that was found."""
    both = truth.select("query_id", "id").join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").count()
    return both / max(1, truth.count())

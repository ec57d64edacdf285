"""Tables of one row a key that grow by batches: only the key-hash parts that a batch touches are written anew.

Layout: data/v=<batch>/part=<n> holds a part as that batch left it, manifest/v=<batch> says which version of each part is current. A
batch writes its parts first and its manifest last, which is its commit: readers follow the newest whole manifest, so a batch that
was lost midway leaves nothing to be seen, and one that runs again writes over its own version. Versions that none of the last `keep`
manifests names are deleted. A part has about rows / parts rows; parts is fixed when the table begins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dolomite.functions.text import unused
from dolomite.sources.writers import materialised

MANIFEST = "part int, version long, parts int"


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    folder: str
    key: str = "path"
    parts: int = 64
    keep: int = 2

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, folder: str, begin: str) -> list[str]:
        files, at = self._files(), self._path(folder)
        return [x.getPath().getName() for x in files.listStatus(at) if x.getPath().getName().startswith(begin)] if files.exists(at) else []

    def versions(self) -> list[int]:
        """Of whole manifests, ascending."""
        files = self._files()
        found = [int(n[2:]) for n in self._names("manifest", "v=")]
        return sorted(v for v in found if files.exists(self._path(f"manifest/v={v}/_SUCCESS")))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """part -> version by the newest manifest (older than `before`): at most `parts` entries."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/v={known[-1]}").collect()
        if any(r["parts"] != self.parts for r in rows):
            raise ValueError(f"the table has {rows[0]['parts']} parts, not {self.parts}")
        return {r["part"]: r["version"] for r in rows}

    def _read(self, of: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/data/v={v}/part={p}" for p, v in sorted(of.items())]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths).select("row.*") if paths else None

    def rows(self) -> DataFrame | None:
        """All current rows; None before the first batch."""
        return self._read(self.manifest())

    def part_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def matching(self, rows: DataFrame, before: int | None = None) -> tuple[DataFrame, DataFrame | None, dict[int, int]]:
        """rows (written, with their part), the current rows of the parts they touch, and the manifest. Only those parts are read."""
        now = self.manifest(before)
        (part,) = unused(rows, "part_of_key")
        own = materialised(rows.withColumn(part, self.part_of(self.key)), "arrived")
        touched = {r[0] for r in own.select(part).distinct().collect()}  # at most `parts`
        return own, self._read({p: v for p, v in now.items() if p in touched}), now

    def upsert(self, rows: DataFrame, version: int) -> set[int]:
        """rows take the place of those of equal key (a null key is a key); of a batch's rows of one key all are kept. The parts written."""
        own, old, now = self.matching(rows, version)
        part = own.columns[-1]
        if own.isEmpty():
            return set()
        kept = own
        if old is not None:
            keys = own.select(F.col(self.key).alias(part)).distinct()
            old = old.join(keys, old[self.key].eqNullSafe(keys[part]), "left_anti")
            kept = own.unionByName(old.withColumn(part, self.part_of(self.key)), allowMissingColumns=True)
        data = f"{self.folder}/data/v={version}"
        whole = kept.select(F.col(part).alias("part"), F.struct(*[c for c in kept.columns if c != part]).alias("row"))
        whole.repartition("part").write.mode("overwrite").partitionBy("part").parquet(data)
        written = {int(n[5:]) for n in self._names(f"data/v={version}", "part=")}
        entries = [(p, v, self.parts) for p, v in sorted((now | {p: version for p in written}).items())]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={version}")
        self.expire()
        return written

    def expire(self) -> None:
        """Deletes manifests but the last `keep`, and the parts that those do not name."""
        files, versions = self._files(), self.versions()
        live: set[tuple[int, int]] = set()
        for v in versions[-self.keep :]:
            live |= {(r["version"], r["part"]) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/v={v}").collect()}
        for v in versions[: -self.keep]:
            files.delete(self._path(f"manifest/v={v}"), True)
        for name in self._names("data", "v="):
            version = int(name[2:])
            if versions and version > versions[-1]:
                continue  # of a batch that has not committed
            parts = [int(n[5:]) for n in self._names(f"data/{name}", "part=")]
            for p in parts:
                if (version, p) not in live:
                    files.delete(self._path(f"data/{name}/part={p}"), True)
            if not any((version, p) in live for p in parts):
                files.delete(self._path(f"data/{name}"), True)


def upserting(stream: DataFrame, work: Callable[[DataFrame], DataFrame], table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Each batch through work, and its rows upserted into the table. A restart neither loses nor repeats rows: a batch's number is its version."""

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(work(batch), number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str = "path", time: str = "modified", within: str = "1 hour") -> DataFrame:
    """Rows whose key has not come within the time before; the state holds that span's keys alone.

    resuming() tells keys of any age apart, by a table in place of state.
    """
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def resuming(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: KeyedTable, seen: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Each key's first row through work and into `out`, once and for all: keys done before are passed over, whenever they come again.

    What is done is the table `seen`, a row a key, of which a batch reads the touched parts alone; the stream itself has no state. `out` is
    written first, so that a batch lost between the two runs again as a whole; a batch that runs again sees the table as before it.
    """

    def put(batch: DataFrame, number: int) -> None:
        own, done, _ = seen.matching(batch, number)
        new = own.drop(own.columns[-1])
        if done is not None:
            keys = done.select(F.col(seen.key).alias("seen_key")).distinct()
            new = new.join(keys, new[seen.key].eqNullSafe(keys["seen_key"]), "left_anti")
        (row,) = unused(new, "row")
        first = new.groupBy(seen.key).agg(F.min(F.struct(*[c for c in new.columns if c != seen.key])).alias(row)).select(seen.key, f"{row}.*").select(*new.columns) if len(new.columns) > 1 else new.distinct()
        first = materialised(first, "first")
        out.upsert(work(first), number)
        seen.upsert(first.select(seen.key), number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

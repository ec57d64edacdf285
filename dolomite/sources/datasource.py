"""Folders of documents and single-file exports as Spark data sources.

    register(spark)
    spark.read.format("documents").option("suffixes", "md, pdf").option("modifiedAfter", "2024-01-01T00:00:00").load(folder)
    spark.readStream.format("documents").load(folder)
    rows.write.format("single_file").option("format", "csv").mode("overwrite").save("file:///exports/rules.csv")

documents: a row per file, parsed by its suffix; a file that cannot be read or parsed is a row with an error. Reads are planned: files that pass
glob, suffixes, modifiedAfter, modifiedBefore (UTC) and mostBytes are packed to splits of about `split` bytes; others are not opened. These
filters are options, as those of Spark's own file sources, and not pushed down from where(): Spark 4.1 keeps what a Python source was
pushed with the frame, and a second query on the same frame would miss files. As a stream, files are taken in order of (modified,
path), behind the last one taken.

single_file: one file, as readers of exports expect it. Tasks write parts beside it; the commit joins the parts of the tasks that
succeeded, in order, a piece at a time, and moves the whole into place. A task that was killed leaves nothing in the file, and a job that
fails leaves the file as it was. CSV has its header once, also where rows are appended; JSON is {summary, results}.

Paths are URIs of any store that pyarrow.fs knows (plain paths are local), and must be reachable from driver and executors alike.
"""

from __future__ import annotations

import csv
import fnmatch
import importlib
import io
import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from dolomite.sources.readers import DOCUMENT, PARSERS, Parser, parse_text

SPLIT, PIECE = 64 << 20, 1 << 20
FILES = f"{DOCUMENT}, modified timestamp, length long"


def store(uri: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass(frozen=True)
class Found:
    path: str
    ns: int
    length: int

    @property
    def suffix(self) -> str:
        name = self.path.rpartition("/")[2]
        return name.rpartition(".")[2].lower() if "." in name else ""

    @property
    def modified(self) -> datetime:
        return datetime.fromtimestamp(self.ns // 1000 / 1e6, UTC)


def moment(text: str) -> int:
    at = datetime.fromisoformat(text.strip())
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1e6) * 1000


@dataclass(frozen=True)
class Filters:
    """What is decided before a file is opened."""

    glob: str = "*"
    suffixes: frozenset[str] | None = None
    after: int | None = None
    before: int | None = None
    most: int | None = None

    @staticmethod
    def of(options) -> Filters:
        suffixes = options.get("suffixes")
        return Filters(
            options.get("glob", "*"),
            frozenset(x.strip().lower().lstrip(".") for x in suffixes.split(",")) if suffixes else None,
            moment(options["modifiedAfter"]) if options.get("modifiedAfter") else None,
            moment(options["modifiedBefore"]) if options.get("modifiedBefore") else None,
            int(options["mostBytes"]) if options.get("mostBytes") else None,
        )

    def passes(self, f: Found) -> bool:
        named = fnmatch.fnmatch(posixpath.basename(f.path), self.glob) and (self.suffixes is None or f.suffix in self.suffixes)
        timed = (self.after is None or f.ns > self.after) and (self.before is None or f.ns < self.before)
        return named and timed and (self.most is None or f.length <= self.most)


def listed(uri: str, filters: Filters = Filters()) -> list[Found]:
    """Files below a folder (or the one file) that pass, by path; names that begin with a dot or underscore are left out."""
    from pyarrow import fs

    system, root = store(uri)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    alone = info.type == fs.FileType.File
    shown = lambda p: alone or not any(x[:1] in "._" for x in posixpath.relpath(p, root).split("/"))
    every = [info] if alone else system.get_file_info(fs.FileSelector(root, recursive=True))
    files = [Found(x.path, x.mtime_ns or 0, x.size or 0) for x in every if x.type == fs.FileType.File and shown(x.path)]
    return sorted(filter(filters.passes, files), key=lambda f: f.path)


@dataclass
class Split(InputPartition):
    files: tuple[Found, ...]


def splits(files: Sequence[Found], most: int) -> list[Split]:
    """Files in order, packed while they fit; a larger one is alone."""
    out, held, size = [], [], 0
    for f in files:
        if held and size + f.length > most:
            out.append(Split(tuple(held)))
            held, size = [], 0
        held.append(f)
        size += f.length
    return [*out, Split(tuple(held))] if held else out


def parsers(option: str | None) -> dict[str, Parser]:
    """PARSERS, and those of an option "suffix=module:function, ..."."""
    more = {}
    for item in filter(None, (x.strip() for x in (option or "").split(","))):
        suffix, _, where = item.partition("=")
        module, _, name = where.partition(":")
        more[suffix.strip().lower()] = getattr(importlib.import_module(module.strip()), name.strip())
    return PARSERS | more


def rows_of(files: Sequence[Found], uri: str, option: str | None) -> Iterator[tuple]:
    """A row per file; one whole file is in memory at a time."""
    system, _ = store(uri)
    by = parsers(option)
    for f in files:
        try:
            with system.open_input_stream(f.path) as stream:
                text, pages = by.get(f.suffix, parse_text)(stream.read())
            error = None
        except Exception as e:  # noqa: BLE001  one bad file fails no job
            text, pages, error = "", None, str(e) or type(e).__name__
        yield f.path, f.suffix, text, pages, error, f.modified, f.length


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.filters, self.split, self.parsers = options["path"], Filters.of(options), int(options.get("split", SPLIT)), options.get("parsers")

    def partitions(self):
        return splits(listed(self.uri, self.filters), self.split)

    def read(self, partition):
        # A source without files has one partition, which is none of ours.
        return rows_of(getattr(partition, "files", ()), self.uri, self.parsers)


class DocumentStream(DataSourceStreamReader):
    """Offsets are the (modified, path) of the last file taken. A file that comes later with an earlier time is passed over."""

    def __init__(self, options):
        self.uri, self.filters, self.split, self.parsers = options["path"], Filters.of(options), int(options.get("split", SPLIT)), options.get("parsers")

    def initialOffset(self):
        return {"ns": -1, "path": ""}

    def latestOffset(self):
        last = max(((f.ns, f.path) for f in listed(self.uri, self.filters)), default=(-1, ""))
        return {"ns": last[0], "path": last[1]}

    def partitions(self, start, end):
        low, high = (start["ns"], start["path"]), (end["ns"], end["path"])
        return splits(sorted((f for f in listed(self.uri, self.filters) if low < (f.ns, f.path) <= high), key=lambda f: (f.ns, f.path)), self.split)

    def read(self, partition):
        return rows_of(getattr(partition, "files", ()), self.uri, self.parsers)

    def commit(self, end):
        pass


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return DocumentStream(self.options)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


def plain(value):
    """A value as JSON holds it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, datetime | date):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value.decode("utf-8", "replace") if isinstance(value, bytes | bytearray) else value


def cell(value) -> str:
    value = plain(value)
    return "" if value is None else json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else str(value).lower() if isinstance(value, bool) else str(value)


class SingleFile(DataSourceWriter):
    """Two phases: parts beside the file, and a commit that joins them and moves the whole into place."""

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.uri, self.format, self.overwrite = options["path"], options.get("format", "csv").strip().lower(), overwrite
        if self.format not in ("csv", "json"):
            raise ValueError(f"a single file is csv or json, not {self.format!r}")
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else schema.names
        if missing := [c for c in self.columns if c not in schema.names]:
            raise ValueError(f"no columns {missing} in the rows")
        self.payload, self.summary = options.get("payload"), json.loads(options.get("summary", "{}"))
        if not isinstance(self.summary, dict):
            raise ValueError("the summary is no object")
        self.parts = f"{store(self.uri)[1]}.parts-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        system, _ = store(self.uri)
        partition, rows = TaskContext.get().partitionId(), 0
        path = f"{self.parts}/{partition}-{uuid.uuid4().hex}"  # of this attempt alone
        system.create_dir(self.parts, recursive=True)
        with system.open_output_stream(path) as out:
            for row in iterator:
                out.write(self.line(row, rows))
                rows += 1
        return Part(partition, path, rows)

    def line(self, row: Row, place: int) -> bytes:
        if self.format == "csv":
            text = io.StringIO()
            csv.writer(text, lineterminator="\n").writerow([cell(row[c]) for c in self.columns])
            return text.getvalue().encode()
        if self.payload:  # a column of JSON texts, each of which must be an object
            said = row[self.payload]
            value = json.loads(said) if said else None
            if not isinstance(value, dict):
                raise ValueError(f"a result is no JSON object: {str(said)[:80]!r}")
        else:
            value = {c: plain(row[c]) for c in self.columns}
        return ((",\n" if place else "") + json.dumps(value, ensure_ascii=False)).encode()

    def commit(self, messages):
        from pyarrow import fs

        system, path = store(self.uri)
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        there = system.get_file_info(path).type == fs.FileType.File
        fresh = f"{self.parts}-whole"
        if parent := posixpath.dirname(path):
            system.create_dir(parent, recursive=True)
        with system.open_output_stream(fresh) as out:
            if self.format == "csv":
                if there and not self.overwrite:
                    self.copied(system, path, out)
                else:
                    out.write((",".join(self.columns) + "\n").encode())
                for m in done:
                    self.copied(system, m.path, out)
            else:
                if there and not self.overwrite:
                    raise FileExistsError(f"{self.uri} is there; a JSON export is not appended to")
                if not done:
                    raise ValueError("no results to export")
                out.write(f'{{"summary": {json.dumps(self.summary, ensure_ascii=False)}, "results": [\n'.encode())
                for k, m in enumerate(done):
                    if k:
                        out.write(b",\n")
                    self.copied(system, m.path, out)
                out.write(b"\n]}\n")
        system.move(fresh, path)
        self.swept(system)

    def abort(self, messages):
        self.swept(store(self.uri)[0])

    def copied(self, system, path: str, out) -> None:
        with system.open_input_stream(path) as part:
            while piece := part.read(PIECE):
                out.write(piece)

    def swept(self, system) -> None:
        """Without the parts, those of killed attempts among them."""
        from pyarrow import fs

        for path in (self.parts, f"{self.parts}-whole"):
            kind = system.get_file_info(path).type
            if kind == fs.FileType.Directory:
                system.delete_dir(path)
            elif kind == fs.FileType.File:
                system.delete_file(path)


class SingleFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_file"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SingleFile(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    for source in (Documents, SingleFileSource):
        spark.dataSource.register(source)

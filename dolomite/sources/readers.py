"""Documents and rules from files: text, JSON, tables, and formats that need a parser."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dolomite.functions.text import strip, unused
from dolomite.operators.candidates import document_metadata

DOCUMENT = "path string, suffix string, text string, page_count int, error string"
#: A parser takes a file's bytes and gives its text and number of pages.
Parser = Callable[[bytes], tuple[str, int | None]]


def parse_text(data: bytes) -> tuple[str, int | None]:
    return data.decode("utf-8", "ignore"), None


def parse_json(data: bytes) -> tuple[str, int | None]:
    return json.dumps(json.loads(data.decode("utf-8")), indent=2, ensure_ascii=False), None


def parse_csv(data: bytes, most: int = 100) -> tuple[str, int | None]:
    """The header and the first `most` rows, cells joined by bars: the format's own limit."""
    import io

    rows = pd.read_csv(io.BytesIO(data), nrows=most, dtype=str, keep_default_na=False)
    return "\n".join([" | ".join(rows.columns), *(" | ".join(r) for r in rows.itertuples(index=False))]), None


def pages_joined(pages: Sequence[str]) -> tuple[str, int]:
    """Pages that are not blank, each under its number."""
    real = [(i, p.strip()) for i, p in enumerate(pages, 1) if p.strip()]
    return "\n\n".join(f"--- Page {i} ---\n{p}" for i, p in real), len(real)


def parse_pdf(data: bytes) -> tuple[str, int | None]:
    import io

    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf, or a parser of your own") from e
    return pages_joined([p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages])


def parse_docx(data: bytes) -> tuple[str, int | None]:
    """Paragraphs and then table rows, from the file's own XML."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    lines = [x for p in body.findall(f"{w}p") if (x := said(p))]
    for row in (r for t in body.findall(f"{w}tbl") for r in t.iter(f"{w}tr")):
        if cells := [c for cell in row.findall(f"{w}tc") if (c := said(cell))]:
            lines.append(" | ".join(cells))
    return "\n\n".join(lines), None


def parse_xlsx(data: bytes, most: int = 100) -> tuple[str, int | None]:
    """Every sheet under its name, the header and its first `most` rows, cells joined by bars, from the file's own XML; empty sheets are left out."""
    import io
    import zipfile
    from xml.etree import ElementTree

    pack = zipfile.ZipFile(io.BytesIO(data))
    read = lambda name: ElementTree.fromstring(pack.read(name))
    own = lambda e: e.tag.rpartition("}")[2]
    said = lambda e: "".join(t.text or "" for t in e.iter() if own(t) == "t")
    shared = [said(e) for e in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in pack.namelist() else []
    target = {r.get("Id"): r.get("Target").lstrip("/") for r in read("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in (e for e in read("xl/workbook.xml").iter() if own(e) == "sheet"):
        path = target[next(v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id" and "}" in k)]
        lines = []
        for row in (e for e in read(path if path.startswith("xl/") else f"xl/{path}").iter() if own(e) == "row"):
            cells: dict[int, str] = {}
            for cell in row:
                at = 0
                for c in (x for x in cell.get("r", "") if x.isalpha()):
                    at = 26 * at + ord(c.upper()) - 64
                value = next((v.text or "" for v in cell if own(v) == "v"), "")
                cells[at or len(cells) + 1] = shared[int(value)] if cell.get("t") == "s" and value else said(cell) if cell.get("t") == "inlineStr" else value
            lines.append(" | ".join(cells.get(i, "") for i in range(1, max(cells, default=0) + 1)))
            if len(lines) > most:
                break
        if any(x.strip(" |") for x in lines):
            out.append("\n".join([f"--- Sheet {sheet.get('name')} ---", *lines]))
    return "\n\n".join(out), None


PARSERS: dict[str, Parser] = {"txt": parse_text, "md": parse_text, "json": parse_json, "csv": parse_csv, "pdf": parse_pdf, "docx": parse_docx, "xlsx": parse_xlsx}


def list_files(spark: SparkSession, roots: Sequence[str], glob: str = "*") -> DataFrame:
    """path, modified, size of files below roots, each path once, sorted."""
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(r).select("path", "modificationTime", "length") for r in roots]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.dropDuplicates(["path"]).orderBy("path")


def load_documents(spark: SparkSession, root: str, glob: str = "*", parsers: dict[str, Parser] | None = None, metadata: bool = False) -> DataFrame:
    """A row per file as DOCUMENT; unknown suffixes are read as text, and a file that cannot be parsed gives an error and no text.

    metadata: with char_count, word_count, keywords, readability and density of the text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rows = parsed(files.select("path", "content"), parsers)
    return document_metadata(rows.withColumn("whole", F.col("text")), text_col="whole") if metadata else rows


def load_cached(spark: SparkSession, root: str, store: str, glob: str = "*", parsers: dict[str, Parser] | None = None) -> DataFrame:
    """As load_documents, by way of the table at store: a file whose path, time and size are there already is not read again."""
    keys, schema = ["path", "modificationTime", "length"], f"{DOCUMENT}, modificationTime timestamp, length long"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    there = files.select(*keys)
    try:
        known = spark.read.schema(schema).parquet(store)
    except AnalysisException:
        known = spark.createDataFrame([], schema)
    new = there.join(known.select(*keys), keys, "left_anti")
    read = parsed(files.join(new.select("path"), "path", "left_semi").select("path", "content"), parsers)
    read.join(new, "path").select(*known.columns).write.mode("append").parquet(store)
    return spark.read.schema(schema).parquet(store).dropDuplicates(keys).join(there, keys, "left_semi").drop("modificationTime", "length")


def parsed(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Files (path, content) as DOCUMENT."""
    by = PARSERS | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                suffix = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
                try:
                    text, pages = by.get(suffix, parse_text)(bytes(content))
                    out.append((path, suffix, text, pages, None))
                except Exception as e:  # noqa: BLE001  one bad file fails no job
                    out.append((path, suffix, "", None, str(e)))
            yield pd.DataFrame(out, columns=["path", "suffix", "text", "page_count", "error"])

    return files.mapInPandas(run, DOCUMENT)


def rule_files(spark: SparkSession, path: str) -> DataFrame:
    """source, rule_count (as the file says it, 0 where it does not) and its rules (JSON texts), a row per exported file."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("source"), strip(F.col("value")).alias("j"))
    rules = F.from_json(F.get_json_object("j", "$.rules"), "array<string>")
    return raw.select("source", F.coalesce(F.get_json_object("j", "$.rule_count").try_cast("int"), F.lit(0)).alias("rule_count"), F.coalesce(rules, F.array().cast("array<string>")).alias("rules"))


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, with bytes that are no UTF-8 left out; a replacement character that a file has itself stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [bytes(x).decode("utf-8", "ignore") for x in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def load_rules(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """source, rule (JSON text): of {documents: [{rules}]}, {rules}, a list of rules or one rule, file by file.

    strict: only {rules} or a list; anything else is an error. Files that are no JSON give no rows, or the error.
    """
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("source"), strip(F.col("value")).alias("j"))
    many = lambda c: F.from_json(c, "array<string>")
    documents = F.get_json_object("j", "$.documents")
    nested = F.flatten(F.transform(many(documents), lambda d: F.coalesce(many(F.get_json_object(d, "$.rules")), F.array().cast("array<string>"))))
    own = many(F.get_json_object("j", "$.rules"))
    plain = F.when(F.col("j").startswith("["), many(F.col("j")))
    found = F.coalesce(own, plain, F.when(F.lit(strict), F.raise_error(F.concat(F.lit("no rules in "), F.col("source"))).cast("array<string>")), nested, F.when(F.get_json_object("j", "$.rule_text").isNotNull(), F.array("j")))
    return raw.select("source", F.explode(found).alias("rule"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quotes and line ends inside cells; a byte-order mark is dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def resume_rows(spark: SparkSession, path: str, key: str = "path", order: str | None = None) -> DataFrame:
    """The last row of each key that is not blank. order: the column that tells later from earlier, else place in the files."""
    rows = read_csv(spark, path).where(strip(F.col(key)) != "")
    place, last = unused(rows, "place", "last")
    others = [c for c in rows.columns if c != key]
    rows = rows.withColumn(place, F.col(order) if order else F.monotonically_increasing_id())
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), place).alias(last)).select(key, f"{last}.*")


def feature_schema(spark: SparkSession, blobs: dict[str, str], faithful: bool = False) -> DataFrame:
    """domain, object, attribute, kind: of blobs of "Object: X" and "Attributes: A, B (Kind)" lines.

    faithful: a line that says "Attribute:" is passed over.
    """
    label = r"^Attributes:\s*(.*)$" if faithful else r"^Attributes?:\s*(.*)$"
    lines = spark.createDataFrame([*blobs.items()], "domain string, blob string").select("domain", F.posexplode(F.split("blob", "\n")).alias("at", "line")).withColumn("line", strip(F.col("line")))
    found = lines.withColumn("object", F.expr("last_value(nullif(regexp_extract(line, '^Object:\\\\s*(.*)$', 1), '')) ignore nulls over (partition by domain order by at)"))
    listed = found.select("domain", "object", F.explode_outer(F.when(F.col("line").rlike(label), F.split(F.regexp_extract("line", label, 1), r"\s*,\s*"))).alias("a"), F.col("line").startswith("Object:").alias("head"))
    rows = listed.where(F.col("object").isNotNull() & (F.col("head") | F.col("a").isNotNull()))
    return rows.select("domain", "object", F.nullif(F.regexp_extract("a", r"^([^( ]*)", 1), F.lit("")).alias("attribute"), F.nullif(F.regexp_extract("a", r"\(([^)]*)\)", 1), F.lit("")).alias("kind")).distinct()


def domain_summary(spark: SparkSession, blobs: dict[str, str], faithful: bool = False) -> DataFrame:
    """domain, summary: "**Domain**: Object (its attributes), Object", a row per domain in the order given.

    faithful: a line that says "Attribute:" names no attributes, and an object's are cut at a second "Attributes:".
    """
    label = r"(?m)^.*Attributes:([^\n]*)$" if faithful else r"(?m)^\s*Attributes?:([^\n]*)$"
    rows = spark.createDataFrame([(i, d, b) for i, (d, b) in enumerate(blobs.items())], "place int, domain string, blob string")
    parts = F.filter(F.split("blob", "Object:"), lambda x: strip(x) != "")

    def said(block: Column) -> Column:
        name, listed = strip(F.split(strip(block), "\n")[0]), strip(F.regexp_extract(block, label, 1))
        return F.when(listed != "", F.concat(name, F.lit(" ("), listed, F.lit(")"))).otherwise(name)

    return rows.orderBy("place").select("domain", F.concat(F.lit("**"), "domain", F.lit("**: "), F.array_join(F.transform(parts, said), ", ")).alias("summary"))


def missing_requirements(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """name, version, installed, status of each wanted (name, version): ok, other version, or missing."""
    have = installed.select(F.lower(strip("name")).alias("name"), F.col("version").alias("installed")).dropDuplicates(["name"])
    rows = wanted.select(F.lower(strip("name")).alias("name"), "version").join(have, "name", "left")
    return rows.withColumn("status", F.when(F.col("installed").isNull(), "missing").when(F.col("installed") == F.col("version"), "ok").otherwise("other version"))


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """name, version of name==version lines; comments and others are left out."""
    line = strip(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(F.lower(F.regexp_extract(line, r"^([A-Za-z0-9._\[\]-]+)==(\S+)$", 1)).alias("name"), F.regexp_extract(line, r"^([A-Za-z0-9._\[\]-]+)==(\S+)$", 2).alias("version")).where(F.col("name") != "")

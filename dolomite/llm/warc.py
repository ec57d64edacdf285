"""WARC: a content-addressed archive.

Two tables: payloads (digest, payload), which holds every payload's bytes once, and headers, which holds each record's
exact WARC header and HTTP head with the digest of its payload. The address is SHA-256; every address that is
used more than once is verified by comparing the bytes of all payloads under it. Original records come back by
joining the two. Of records with equal payloads the one with the smallest identifier is a response, the others revisit it.

Null html is an empty payload. Repeated identifiers: rows of the same identifier and payload are all responses. A null
url is written as urn:page:ID. Empty input gives an empty archive. Other columns play no part.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dolomite.llm.common import small_or_shuffled, written

#: The digits of Spark's base 32 and those of RFC 4648.
DIGITS, RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF, DATE = "\r\n", "2024-01-01T00:00:00Z"
HEADERS = "page_id bigint, header binary, head binary, digest string"


def base32(hexed: Column) -> Column:
    """Of 40 hexadecimal digits, ten at a time."""
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]), DIGITS, RFC4648)


def payload_digest(payload: Column) -> Column:
    return base32(F.sha1(payload))


def head(payload: Column) -> Column:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    return F.concat(F.lit(CRLF.join(lines) + CRLF + "Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF * 2))


def record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes folder/payloads and folder/headers."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    addressed = rows.withColumn("digest", F.sha2("payload", 256))
    records = written(addressed.select("page_id", "url", "digest", payload_digest(F.col("payload")).alias("sha1"), head(F.col("payload")).alias("head"), F.octet_length("payload").alias("n")), "records")
    # Written, so that the joins below deal out both sides anew and a frequent digest (an empty payload's) can be split.
    owners = written(records.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n_records")), "owners")
    reused = owners.where("n_records > 1")
    # Verification and the choice of one copy in one pass over the reused addresses; min and max are pre-aggregated.
    several = addressed.join(small_or_shuffled(reused.select("digest")), "digest").groupBy("digest").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
    one = several.select("digest", F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads under one address: "), F.col("digest"))).cast("binary")).alias("payload"))
    alone = addressed.join(small_or_shuffled(reused.select("digest")), "digest", "left_anti").select("digest", "payload")
    alone.unionByName(one).write.parquet(f"{folder}/payloads")
    of = records.join(owners.select("digest", "owner"), "digest")
    first = F.col("page_id").eqNullSafe(F.col("owner"))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:page:"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.when(first, "response").otherwise("revisit")),
        field("WARC-Record-ID", F.coalesce(record_id(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
        field("WARC-Target-URI", uri),
        field("WARC-Date", F.lit(DATE)),
        F.when(first, F.lit("")).otherwise(
            F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", F.coalesce(record_id(F.col("owner")), F.lit(""))))
        ),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", (F.octet_length("head") + F.when(first, F.col("n")).otherwise(0)).cast("string")),
        F.lit(CRLF),
    )
    of.select("page_id", header.cast("binary").alias("header"), F.col("head").cast("binary").alias("head"), "digest").write.parquet(f"{folder}/headers")


def open_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """headers, payloads."""
    return spark.read.schema(HEADERS).parquet(f"{folder}/headers"), spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")


def header_field(name: str, header: str = "header") -> Column:
    return F.nullif(F.regexp_extract(F.col(header).cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, digest, record_type, record: the exact bytes of every WARC record.

    A response is its header, HTTP head and payload, which a join brings back; a revisit has no payload and takes part in no join.
    """
    headers, payloads = open_archive(spark, folder)
    of = headers.withColumn("record_type", header_field("WARC-Type"))
    record = lambda *payload: F.concat("header", "head", *payload, F.lit(b"\r\n\r\n")).alias("record")
    responses = of.where("record_type = 'response'").join(payloads, "digest").select("page_id", "digest", "record_type", record("payload"))
    return responses.unionByName(of.where("record_type <> 'response'").select("page_id", "digest", "record_type", record()))


def parsed(records: DataFrame) -> DataFrame:
    """records with header, head and payload, cut from the record's own bytes at the first empty lines."""
    upto = lambda c: F.octet_length(F.substring_index(F.col(c).cast("string"), CRLF * 2, 1)) + 4
    rows = records.withColumn("at", upto("record"))
    rows = rows.withColumns({"header": F.substr("record", F.lit(1), F.col("at")), "block": F.substr("record", F.col("at") + 1, F.octet_length("record") - F.col("at") - 4)})
    rows = rows.withColumn("at", upto("block"))
    return rows.withColumns({"head": F.substr("block", F.lit(1), F.col("at")), "payload": F.substr("block", F.col("at") + 1)}).drop("at", "record")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the reconstructed records.

    Length and digest are those of the response's own bytes; a revisit takes them from the response it refers to, by a join of
    narrow rows. A record whose Content-Length or digest differs from its bytes, or that refers to no response, raises an error.
    """
    rows = parsed(reconstruct(spark, folder))
    failed = lambda text: F.raise_error(F.lit(text))
    long = F.octet_length("payload").cast("long")
    size = F.when(header_field("Content-Length").cast("long") == F.octet_length("block"), long).otherwise(failed("a record's length differs from its header's").cast("long"))
    said = header_field("WARC-Payload-Digest")
    heads = rows.select("page_id", "digest", "record_type", header_field("WARC-Record-ID").alias("record_id"), header_field("WARC-Refers-To").alias("target"), said.alias("said"), size.alias("n"), F.when(F.col("record_type") == "response", payload_digest(F.col("payload"))).alias("sha1"))
    heads = written(heads, "records-read")
    whole = F.when(F.col("said") == F.concat(F.lit("sha1:"), F.col("sha1")), F.col("sha1")).otherwise(failed("a payload differs from its record's digest"))
    responses = heads.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), whole.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = heads.where("record_type <> 'response'").select("page_id", "digest", "target", "said", "record_type")
    first = heads.where("record_type = 'response'").join(revisits.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("page_id", "record_id", "sha1", "n")).alias("first"))
    again = revisits.join(small_or_shuffled(written(first, "first-records")), "digest", "left")
    meant = F.col("target").eqNullSafe(F.col("first.record_id")) & (F.col("said") == F.concat(F.lit("sha1:"), F.col("first.sha1")))
    refers = F.when(meant, F.col("first.page_id")).otherwise(failed("a revisit refers to no response").cast("long"))
    return responses.unionByName(again.select("page_id", F.col("first.n").alias("payload_bytes"), F.col("first.sha1").alias("payload_digest"), "record_type", refers.alias("refers_to")))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields in lower case, exact header bytes, block) of each record of a WARC file, gzip members or plain."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {stream.tell() - len(line)}")
        lines = [line]
        while (line := stream.readline()).strip():
            lines.append(line)
        exact = b"".join([*lines, line])
        fields = {m[1].decode().lower(): m[2].decode("utf-8", "replace") for m in re.finditer(rb"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)", exact)}
        yield fields, exact, stream.read(int(fields["content-length"]))


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """file, record (number in its file), type, uri, header, block: a row per record of .warc and .warc.gz files."""

    def rows(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                got = [(file, i, f.get("warc-type"), f.get("warc-target-uri"), exact, block) for i, (f, exact, block) in enumerate(parse_records(bytes(content)))]
                yield pd.DataFrame(got, columns=["file", "record", "type", "uri", "header", "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, record long, type string, uri string, header binary, block binary")

"""Operator 7: a content-addressed WARC archive.

``write_archive`` turns pages into two tables: ``headers`` holds the exact header bytes of
every record, ``payloads`` holds each distinct payload once under its SHA-256. Of the records
with equal payloads the one with the largest id is the ``response``, the others are
``revisit`` records that refer to it. ``read_archive`` verifies every stored payload against
its key and joins it back to the headers; ``record_bytes`` gives the original record: header, block
and two line ends. The block of a response is the HTTP header and the payload, that of a
revisit the HTTP header alone; what it was a visit of is the payload it refers to.

Only digests are shuffled to find equal payloads; payload bytes move once, after copies are
removed on the map side. All copies of a payload meet the payload again in a join whose hot
side the engine can split.

Defined cases: a null payload is the empty payload; equal payloads include empty ones.
Repeated rows (equal id, url and payload) are one response or revisit and further revisits,
numbered in the record id. A null id sorts below all others and is written as ``null``.
CR and LF inside a url are percent-encoded, a null url has no target line. An empty table
gives an empty archive. A payload that does not match its digest stops the read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are 8 groups of 5 hex digits, each of
    which is 4 digits of base 32."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _urn(page_id: Column, copy_no: Column) -> Column:
    tail = F.when(copy_no > 1, F.concat(F.lit(":"), copy_no.cast("string"))).otherwise("")
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), tail, F.lit(">"))


def record_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row per page: sha256, header (WARC header with its blank line), http (HTTP header)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = (pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                         payload.alias("payload"))
            .select("id", "url", F.unhex(F.sha2("payload", 256)).alias("sha256"),
                    base32_sha1(F.col("payload")).alias("sha1"),
                    F.octet_length("payload").alias("n"))
            .groupBy("id", "url", "sha256", "sha1", "n").agg(F.count("*").alias("copies")))
    leaders = rows.groupBy("sha256").agg(F.max(F.struct("id", "url")).alias("lead"))
    rows = (rows.join(leaders, "sha256")
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .withColumn("response", F.struct("id", "url").eqNullSafe(F.col("lead")) & (F.col("copy_no") == 1)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(CRLF + CRLF))
    block = F.octet_length("http") + F.when(F.col("response"), F.col("n")).otherwise(0)
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(F.col("response"), "response").otherwise("revisit"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _urn(F.col("id"), F.col("copy_no")),
        F.lit(f"{CRLF}WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), url)).otherwise(""),
        F.when(~F.col("response"), F.concat(
            F.lit(f"{CRLF}WARC-Refers-To: "), _urn(F.col("lead.id"), F.lit(1)),
            F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
        .otherwise(""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        block.cast("string"), F.lit(CRLF + CRLF))
    return rows.withColumn("http", http).select("sha256", header.alias("header"), "http")


def distinct_payloads(pages: DataFrame, payload_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return (pages.select(payload.alias("payload"))
            .groupBy(F.unhex(F.sha2("payload", 256)).alias("sha256")).agg(F.first("payload").alias("payload")))


def write_archive(pages: DataFrame, folder: str | None = None, **columns: str) -> Archive:
    folder = folder or work_dir(pages.sparkSession, "warc")
    out = Archive(f"{folder}/headers", f"{folder}/payloads")
    record_headers(pages, **columns).write.parquet(out.headers)
    distinct_payloads(pages, columns.get("payload_col", "html")).write.parquet(out.payloads)
    return out


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """header, http and the verified payload of every record."""
    payloads = spark.read.parquet(archive.payloads).withColumn(
        "payload", F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))))
    headers = spark.read.parquet(archive.headers)
    # a header without its payload must not vanish: left join, then fail
    return (headers.join(payloads, "sha256", "left")
            .withColumn("payload", F.coalesce("payload", F.raise_error(F.lit("a payload is missing")).cast("binary"))))


def header_field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def _is_response() -> Column:
    return header_field("WARC-Type") == "response"


def record_bytes(records: DataFrame) -> DataFrame:
    """The original records as they stand in a WARC file."""
    payload = F.when(_is_response(), F.col("payload")).otherwise(F.lit(b""))
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"),
                                                 payload, F.lit(CRLF + CRLF).cast("binary")))


def page_digests(records: DataFrame) -> DataFrame:
    """What the rebuilt records say about each page: a response from its own bytes, cut by its
    Content-Length, a revisit from the payload it refers to."""
    r = record_bytes(records)
    block = header_field("Content-Length").cast("int")
    held = F.when(_is_response(), F.substring(F.col("record"), F.octet_length("header") + F.octet_length("http") + 1,
                                              block - F.octet_length("http"))).otherwise(F.col("payload"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)", 1)
    number = lambda c: F.nullif(page(c), F.lit("")).cast("long")
    r = r.select("header", held.alias("held")).withColumn("digest", base32_sha1(F.col("held")))
    digest = F.when(F.col("digest") == F.regexp_extract("header", r"sha1:([A-Z2-7]{32})\r\n", 1), F.col("digest")) \
        .otherwise(F.raise_error(F.lit("a record does not match its payload digest")))
    return r.select(number(header_field("WARC-Record-ID")).alias("page_id"),
                    F.octet_length("held").cast("long").alias("payload_bytes"),
                    digest.alias("payload_digest"), header_field("WARC-Type").alias("record_type"),
                    number(header_field("WARC-Refers-To")).alias("refers_to"))

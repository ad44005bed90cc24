"""A content-addressed archive of WARC records.

An archive is a folder of two tables. ``payloads`` holds each payload once, under its SHA-256, as a Zstandard frame;
``records`` holds for each record its WARC header and its HTTP header, byte for byte, and the payload's SHA-256. A join of
the two gives the original records. The digest is verified both ways: payloads of one SHA-256 must agree in length and
SHA-1 when they are stored, and a payload that is read must have the SHA-256 that it is stored under; otherwise, or if
a payload is missing, the job fails.

From pages: a payload is the html in UTF-8. Of records with equal payloads of at least ``least_bytes`` bytes the one with
the largest page_id (then the largest url) is a ``response``, and the others are ``revisit`` records that refer to it, without
a payload in their block. Headers are made from digests alone, so rows that carry payloads are shuffled only to be
stored once and to be put together again; copies of one payload are reduced by each task first, and the records of a
payload that many share are dealt to several tasks, each with a copy of the frame.

WARC files can be written (each one a run of records) and read, plain or gzip by record, and archived in the same way;
a revisit read from a file has no payload of its own, so its payload is null.

Nulls and edges: a null html is the empty payload; a null page_id is smaller than all others; a null url has no
WARC-Target-URI. Bytes of a url that are no visible ASCII are percent-encoded, so none can end a header line. Rows alike
in all three columns are records of their own, numbered: the first may be a response, the others revisit it. An empty
table gives an archive without records. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, hot_keys, join_hot, limit_batches, shared_folder, table

CRLF = "\r\n"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcSettings:
    least_bytes: int = 1000  # smaller payloads are never revisits
    date: str = "1970-01-01T00:00:00Z"
    content_type: str = "text/html; charset=utf-8"


def _zip(frames: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.compress(x.as_buffer(), asbytes=True) for x in frames], pa.binary())


def _unzip(frames: pa.Array, sizes: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(x.as_buffer(), n, asbytes=True) if n else b"" for x, n in zip(frames, sizes.to_pylist())], pa.binary())


def _uri(url: Column) -> Column:
    """The url, with bytes other than visible ASCII percent-encoded."""
    body = url.cast("binary")

    def byte(at: Column) -> Column:
        one = F.substring(body, at, F.lit(1))
        return F.when((one > F.lit(b"\x20")) & (one < F.lit(b"\x7f")), one.cast("string")).otherwise(F.concat(F.lit("%"), F.hex(one)))

    encoded = F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(url)), byte), "")
    return F.when(url.rlike(r"\A[\x21-\x7e]*\z"), url).otherwise(encoded)


def page_headers(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """header, http and sha256 of the record of each row of pages (page_id, url, html)."""
    payload = _payload()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(payload).alias("n"), F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha256"))
    rows = rows.groupBy("page_id", "url", "n", "sha1", "sha256").agg(F.count("*").alias("copies"))
    found = rows.groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("rows"))
    rows = join_hot(rows, found.select("sha256", "kept"), "sha256", hot_keys(found, "sha256", "rows"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    is_kept = (F.col("copy") == 1) & F.col("page_id").eqNullSafe(F.col("kept.page_id")) & F.col("url").eqNullSafe(F.col("kept.url"))
    revisit = (F.col("n") >= settings.least_bytes) & ~is_kept

    def record_id(page_id: Column, url: Column, copy: Column) -> Column:
        told = F.md5(F.concat_ws("\n", F.col("sha256"), url).cast("binary"))
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), told, F.lit(":"), copy.cast("string"), F.lit(">"))

    def line(name: str, value: Column, only: Column | None = None) -> Column:
        whole = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return F.coalesce(whole if only is None else F.when(only, whole), F.lit(""))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {settings.content_type}{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    rows = rows.withColumns({"revisit": revisit, "http": http})
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        line("WARC-Date", F.lit(settings.date)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Refers-To", record_id(F.col("kept.page_id"), F.col("kept.url"), F.lit(1)), F.col("revisit")),
        line("WARC-Refers-To-Target-URI", _uri(F.col("kept.url")), F.col("revisit")),
        line("WARC-Profile", F.lit(REVISIT_PROFILE), F.col("revisit")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("n"))).cast("string")),
        F.lit(CRLF),
    )
    return rows.select(header.cast("binary").alias("header"), F.col("http").cast("binary").alias("http"), "sha256")


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def write_archive(headers: DataFrame, payloads: DataFrame, folder: str) -> None:
    """An archive of records (header, http, sha256; null where there is no payload) and of all their payloads (payload; any number of copies)."""
    limit_batches(headers.sparkSession)
    rows = payloads.select(F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"), F.arrow_udf(_zip, "binary")("payload").alias("frame"))
    held = rows.groupBy("sha256").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("n", "sha1") for f in (F.min, F.max)], F.first("frame").alias("frame"))
    differ = (F.col("min_n") != F.col("max_n")) | (F.col("min_sha1") != F.col("max_sha1"))
    clash = F.raise_error(F.concat(F.lit("different payloads of SHA-256 "), F.col("sha256")))
    once = held.select("sha256", F.col("min_n").alias("n"), F.when(differ, clash).otherwise(F.col("frame")).alias("frame"))
    # the frames are compressed already
    once.write.option("compression", "none").parquet(f"{folder}/payloads")
    headers.select("header", "http", "sha256").write.option("compression", "zstd").parquet(f"{folder}/records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """header, http, payload (a revisit's is the one that it refers to) and record: the original records."""
    limit_batches(spark)
    records, payloads = (spark.read.parquet(f"{folder}/{name}") for name in ("records", "payloads"))
    counts = records.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("rows"))
    joined = join_hot(records, payloads, "sha256", hot_keys(counts, "sha256", "rows"), "left")
    lacks = F.raise_error(F.concat(F.lit("the archive has no payload "), F.col("sha256")))
    found = joined.select("header", "http", "sha256", F.when(F.col("frame").isNull() & F.col("sha256").isNotNull(), lacks).otherwise(F.col("frame")).alias("frame"), "n")
    # a record without payload goes around the join's columns
    opened = found.withColumn("payload", F.when(F.col("sha256").isNotNull(), F.arrow_udf(_unzip, "binary")(F.coalesce("frame", F.lit(b"")), F.coalesce("n", F.lit(0)))))
    wrong = F.raise_error(F.concat(F.lit("the payload is not that of SHA-256 "), F.col("sha256")))
    checked = opened.withColumn("payload", F.when(F.sha2("payload", 256) != F.col("sha256"), wrong).otherwise(F.col("payload")))
    in_block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b"")))
    record = F.concat("header", "http", in_block, F.lit((CRLF * 2).encode()))
    return checked.select("header", "http", "payload", record.alias("record"))


def field(header: Column, name: str) -> Column:
    """The value of a header's field; null if it has none."""
    found = F.regexp_extract(header.cast("string"), rf"(?imd)^{name}:[ \t]*(.*?)[ \t]*\r$", 1)
    return F.when(header.cast("string").rlike(rf"(?imd)^{name}:"), found)


def page_of(record_id: Column) -> Column:
    """The page_id in a record's id."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d*):", 1).try_cast("long")


def archive_pages(pages: DataFrame, folder: str, settings: WarcSettings = WarcSettings()) -> None:
    """Writes an archive with a record for each row of pages (page_id, url, html)."""
    write_archive(page_headers(pages, settings), pages.select(_payload().alias("payload")), folder)


def write_warc(records: DataFrame, folder: str, records_per_file: int = 10_000) -> None:
    """WARC files of the records (record), so many in each at most."""
    # a text file whose lines end as records do
    end = CRLF * 2
    line = F.substring("record", F.lit(1), F.octet_length("record") - len(end)).cast("string")
    records.select(line.alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", records_per_file).text(folder)


def _members(body: memoryview) -> Iterator[memoryview]:
    """The parts of a file that hold whole records: gzip members, or the plain file."""
    if bytes(body[:2]) != b"\x1f\x8b":
        yield body
        return
    while len(body):
        member = zlib.decompressobj(31)
        yield memoryview(member.decompress(body) + member.flush())
        body = body[len(body) - len(member.unused_data) :]


def _split(body: memoryview) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record, in order."""
    at, end = 0, b"\r\n\r\n"
    while at < len(body):
        upto = at
        while end not in (head := bytes(body[at : (upto := upto + 4096)])):
            if upto >= len(body):
                raise ValueError("a WARC header does not end")
        head = head[: head.index(end) + len(end)]
        sizes = [v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length"]
        if not head.startswith(b"WARC/") or len(sizes) != 1 or not sizes[0].isdigit():
            raise ValueError("not a WARC record")
        start = at + len(head)
        at = start + int(sizes[0])
        if bytes(body[at : at + 4]) != end:
            raise ValueError("a WARC record does not end where its Content-Length says")
        yield head, bytes(body[start:at])
        at += len(end)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([(c, pa.binary()) for c in ("header", "http", "payload")])
    rows, size = [], 0
    for batch in batches:
        for content in batch["content"]:
            for part in _members(memoryview(content.as_buffer())):
                for header, block in _split(part):
                    cut = block.find(b"\r\n\r\n") + 4 if b"application/http" in header.lower() else 0
                    revisit = b"\r\nwarc-type: revisit" in header.lower()
                    rows.append((header, block[:cut] if cut > 3 else b"", None if revisit else block[cut:] if cut > 3 else block))
                    size += len(header) + len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
                        rows, size = [], 0
    yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header, http and payload (null for revisits) of the records in WARC files; each file is read by one task, in batches of ``BATCH_BYTES``."""
    limit_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read_files, "header binary, http binary, payload binary")


def archive_warc(spark: SparkSession, path: str, folder: str) -> None:
    """Writes an archive of the records in WARC files."""
    records = read_warc(spark, path)
    write_archive(records.select("header", "http", F.sha2("payload", 256).alias("sha256")), records.filter("payload IS NOT NULL").select("payload"), folder)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of an archive, read back from it."""
    folder = shared_folder(spark)
    archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    back = read_archive(spark, folder)
    return back.select(
        page_of(field(F.col("header"), "WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field(F.col("header"), "WARC-Type").alias("record_type"),
        page_of(field(F.col("header"), "WARC-Refers-To")).alias("refers_to"),
    )


ORACLE_OP11 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS kept
  FROM pages
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND place > 1 THEN kept END AS refers_to
FROM p
"""

"""WARC archives with revisit resolution.

Archives are written by Spark's own text writer with the record end as line separator, so that files are committed by task
and work on any file system; they are read as binary files of a bounded number of records and cut by Content-Length, whatever
bytes a payload holds. Headers alone are shuffled by payload digest; each group's response is the record with the largest page_id, and only
payloads that occur more than once have their group's page_id joined back, by broadcast while these groups are few. The
other records become revisits that are joined to their original response when they are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import mapped, own_columns, saved, shared_folder, table

#: Records, and bytes of payload by the mean, in one archive file at most.
FILE_RECORDS, FILE_BYTES = 2000, 64 << 20
#: Groups of equal payloads that are broadcast at most; their keys are of fixed length, so that this bounds the bytes (20 MB or so).
FEW_GROUPS = 100_000
#: Bytes of payload that a reader holds before it passes them on.
_STEP = 8 << 20
_DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    A null html is an empty payload. Of rows with equal payloads of least_bytes and more those with the largest page_id are
    responses (each of them, if that row is repeated), the others revisit it; smaller payloads and null page_ids without any other are all responses.
    Payloads count as equal if SHA-1, SHA-256 and length are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = own_columns(pages, "page_id", "url", "html").select(
        "page_id", "url", payload.cast("string").alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"), F.sha2(payload, 256).alias("check")
    )
    key = ["check", "payload_digest", "payload_bytes"]
    first = rows.groupBy(*key).agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    first = saved(first, "repeated")
    first = F.broadcast(first) if first.count() <= FEW_GROUPS else first
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, key, "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to")
    )


def record_text(kept: Column | None = None) -> Column:
    """A record's text without its closing line ends: fresh headers, then the block; a revisit has no payload."""
    response = F.col("record_type") == "response"
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("unknown:")), r"[\x00-\x20\x7f]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    length = F.lit(len(_HTTP)) + F.when(response, F.col("payload_bytes")).otherwise(0)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), urn("page_id"), F.lit("\r\nWARC-Target-URI: "), clean,
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(response, F.lit("")).otherwise(F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), urn("refers_to"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit("\r\n\r\n" + _HTTP), F.when(response, F.col("payload")).otherwise(F.lit("")),
    )


def records_a_file(pages: DataFrame) -> int:
    """How many records of pages (html) make FILE_BYTES by the mean, FILE_RECORDS at most."""
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    return max(1, min(FILE_RECORDS, int(FILE_BYTES / (mean + 1))))


def write_archives(resolved: DataFrame, path: str, records: int = FILE_RECORDS) -> None:
    """One record for each row of resolve_revisits(), in gzip files of that many records at most. Null urls are written as unknown:,
    repeated rows again; an empty table gives archives without records."""
    resolved.select(record_text().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """An archive's records one after the other; no more than one is held unpacked."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as packed, io.BufferedReader(packed, 1 << 18) as file:
        while file.readline():
            head = {}
            while (line := file.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            block = file.read(int(head["Content-Length"]))
            if file.read(4) != b"\r\n\r\n":
                raise ValueError(f"no record end after {head['WARC-Record-ID']}")
            yield head, block


def _page(urn: str | None) -> int | None:
    found = urn and urn.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found and found != "null" else None


_SCHEMA = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary"


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]

        def made(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in _records(content.as_py()):
                    payload = memoryview(block)[len(_HTTP) :] if block.startswith(_HTTP.encode()) else block
                    digest, whole = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "response"
                    if whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't match its digest")
                    rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], digest, _page(head.get("WARC-Refers-To")), len(payload) if whole else None, bytes(payload) if whole and with_payload else None))
                    held += len(payload) if with_payload else 0
                    if held > _STEP:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives under path; a response's digest is checked against its payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return mapped(files, _read(with_payload), _SCHEMA)


def joined_to_originals(records: DataFrame) -> DataFrame:
    """records (of read_archives) with, for revisits, the payload_bytes of the response that they refer to; null if that is missing."""
    whole = records.where("record_type = 'response'")
    originals = whole.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(originals, ["refers_to", "payload_digest"], "left")
    return whole.unionByName(revisits)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    write_archives(resolve_revisits(pages), path, records_a_file(pages))
    return joined_to_originals(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, cast(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((cast('0x' || substr(s, 5 * (i // 4) + 1, 5) AS BIGINT) >> cast(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (h)
"""

QUERIES = {"op3_warc": (op3_warc, ORACLE)}

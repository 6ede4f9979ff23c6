"""WARC archives with revisit records for repeated payloads.

Record headers are shuffled by payload digest to find the originals; the table
of originals is sent to the payloads where it is counted to be small, and only
beyond that are payloads shuffled. Archives are
ordinary WARC/1.1 files (gzip): one record per row of Spark's text writer, with
the two line ends that close a record as the separator, so that they can be
written to and read from any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._shared import read_table, shared_path, small, stored

CRLF = "\r\n"
SIZE_CLASSES = (32 << 10, 512 << 10)  # payload bytes; longer ones are the last class
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def resolve_revisits(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Original responses of repeated payloads: ``payload_digest, refers_to``.

    ``headers`` has ``page_id, payload_digest, payload_bytes`` and may have
    ``record_type``; rows that are already ``revisit`` records are never chosen
    as originals. Only digests that occur in two rows or more and have
    ``min_bytes`` bytes or more are returned. Null page ids are never
    originals; an empty table gives an empty table.
    """
    if "record_type" not in headers.columns:
        headers = headers.withColumn("record_type", F.lit("response"))
    original = F.min(F.when(F.col("record_type") == "response", F.col("page_id")))
    return (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(original.alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL")
        .select("payload_digest", "refers_to")
    )


def join_revisits(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``records`` with ``record_type`` and ``refers_to`` set.

    ``records`` has ``page_id``, ``payload_digest`` and ``payload_bytes``. Of
    equal payloads the smallest page_id is the response (rows repeating that
    page_id too), the others revisit it; null page ids always revisit.
    """
    drop = [c for c in ("record_type", "refers_to") if c in records.columns]
    keys = records.select("page_id", "payload_digest", "payload_bytes", *[c for c in drop if c == "record_type"])
    originals = small(stored(resolve_revisits(keys, min_bytes), "warc-originals"))
    joined = records.drop(*drop).join(originals, "payload_digest", "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.withColumns(
        {
            "record_type": F.when(again, "revisit").otherwise("response"),
            "refers_to": F.when(again, F.col("refers_to")),
        }
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(records: DataFrame, path: str, warc_date: str | None = None, max_file_bytes: int = 64 << 20) -> None:
    """Write ``page_id, url, payload (string), payload_digest, payload_bytes,
    record_type, refers_to`` as WARC records with fresh headers.

    Payloads are written by size class, one folder each, and a file holds at
    most ``max_file_bytes`` of payload (or one record), by a bound on its
    number of records from the longest payload of its class; so a few very
    long pages don't make all files small. ``warc_date`` defaults to the time
    of writing.
    """
    now = F.lit(warc_date) if warc_date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), r"[\x00-\x20]", "%20")
    head = [
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", now),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))),
                line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
        http,
        F.when(revisit, "").otherwise(F.col("payload")),
    ]
    size_class = sum((F.col("payload_bytes") > most).cast("int") for most in SIZE_CLASSES)
    longest = records.groupBy(size_class.alias("class")).agg(F.max("payload_bytes").alias("most")).collect()
    for held, most in longest or [(0, 1)]:
        (
            records.where(size_class == held)
            .select(F.concat(*head).alias("value"))
            .write.option("lineSep", CRLF + CRLF)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", int(max(1, min(4000, max_file_bytes // (most + 1000)))))
            .text(f"{path}/class={held}")
        )


def _headers(raw: bytes) -> dict[str, str]:
    rows = raw.decode("utf-8", "replace").split(CRLF)
    return {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows[1:])}


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of each record, by length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = _headers(data[at:end])
        block = data[end + 4 : end + 4 + int(head["content-length"])]
        if len(block) != int(head["content-length"]) or data[end + 4 + len(block) :][:4] != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, _headers(http), payload
        at = end + 8 + len(block)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data = zlib.decompressobj(31)
            raw = io.BytesIO(data.decompress(content.as_py())).getvalue() + data.flush()
            rows = []
            for head, http, payload in parse_records(raw):
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest differs in {head['warc-record-id']}")
                page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                rows.append((int(page) if page else None, head["warc-target-uri"], int(http["content-length"]), digest, kind, int(refers) if refers else None, payload if with_payload and kind == "response" else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in READ_SCHEMA.split(", ")])


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives at ``path``; response payloads are checked
    against their digests, revisit records have no payload of their own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read(batches, with_payload)

    return files.mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 100) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) and return what is read back.

    Null html is an empty payload, null url ``about:blank``; other columns are
    ignored, whatever their names. One row per page, repeated rows included.
    Payloads are hashed once: what is stored is read by columns after that.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    records = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    write_archives(join_revisits(stored(records, "warc-records"), min_bytes), path)
    return read_archives(pages.sparkSession, path, with_payload=False)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record types of all of ``pages``, read back from their archives; for
    nulls, empty and repeated rows and empty tables see ``archive_pages``."""
    pages = read_table(spark, sf_dir, "pages")
    back = archive_pages(pages, shared_path(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
o AS (SELECT payload_digest AS dg, min(page_id) AS original FROM d WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM d LEFT JOIN o ON dg = payload_digest
"""

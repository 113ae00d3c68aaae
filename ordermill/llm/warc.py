"""WARC archives: written by Spark, indexed by record, read back by coalesced byte ranges.

An archive is a folder of files of gzip members, one member per record (an empty member may
follow one).  Spark's text sink writes them, so task commit, retries and any store Spark can
write to work as usual: a row is a member's raw bytes without its last byte, and the sink's
line separator is that byte.  A member ends with the top byte of its 32-bit length, which is
zero below 16 MB; a larger one gets an empty member appended, which ends with zero too.

``write_index`` scans the files once and writes offset, length, URL, digest and type per
record.  ``read_records`` takes any selection of index rows, sorts them by file and offset,
joins neighbours into byte ranges of at most ``RANGE`` bytes (a single longer record apart)
and opens each range once.

Of pages with equal payloads the one with the smallest page_id is stored as response, the
others as revisits that refer to it.  Payloads are equal if length and SHA-1 are.

Defined results: a null html is an empty payload; a null URL leaves its header out, control
characters in a URL are percent-encoded; pages with a null page_id, and repeated rows with
the smallest page_id of their payload, are responses; an empty table gives an empty archive,
index and result; other columns play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, shared_folder
from .tokenfile import read_tasks

RANGE, GAP = 8 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"  # the pages carry no capture time
_ID = "urn:x-page:"
_EMPTY = gzip.compress(b"", mtime=0)
_CTRL = re.compile(r"[\x00-\x20\x7f]")


def _record(page_id, url, html: bytes, refers_to, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if revisit else http + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        safe = _CTRL.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    key = lambda name: None if (v := fields.get(name, "none").strip("<>").removeprefix(_ID)) == "none" else int(v)
    return {"page_id": key("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": key("WARC-Refers-To"),
            "payload_bytes": size, "payload": body if fields["WARC-Type"] == "response" else None}


def write_archive(pages: DataFrame, folder: str, *, min_revisit: int = 0, date: str = DATE) -> str:
    """Write every row of ``pages`` (page_id, url, html) as a record; payloads of fewer than
    ``min_revisit`` bytes are always responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("html"),
                         F.sha1(body).alias("_sha"), F.length(body).alias("_len"))
    # the table of firsts has one row per payload; a payload with many pages is pre-aggregated
    first = keyed.where(F.col("_len") >= min_revisit).groupBy("_sha", "_len").agg(F.min("page_id").alias("_first"))
    refers = F.when(F.col("page_id") > F.col("_first"), F.col("_first"))
    rows = keyed.join(first, ["_sha", "_len"], "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(lo, 256).to_pylist():
                    gz = gzip.compress(_record(r["page_id"], r["url"], r["html"], r["refers_to"], date), 6, mtime=0)
                    out.append((gz if gz[-1] == 0 else gz + _EMPTY)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")) \
        .write.option("lineSep", "\0").option("compression", "none").text(folder)
    return folder


def _open(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _members(f):
    """(offset, length, bytes) of every non-empty gzip member of an open file; the length
    takes in the empty members that follow it."""
    at, start, data, held = 0, 0, b"", None
    unzip, parts = zlib.decompressobj(31), []
    while True:
        if not data:
            data = f.read(1 << 20)
            if not data:
                break
        parts.append(unzip.decompress(data))
        left = unzip.unused_data if unzip.eof else b""
        at += len(data) - len(left)
        data = left
        if unzip.eof:
            body = b"".join(parts)
            if body:
                if held:
                    yield held
                held = (start, at - start, body)
            elif held:
                held = (held[0], at - held[0], held[2])
            start, unzip, parts = at, zlib.decompressobj(31), []
    if held:
        yield held


INDEX = "path string, offset bigint, length bigint, page_id bigint, url string, digest string, record_type string"


def write_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of an archive, written to ``folder`` + ``-index`` and read back."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length")
    many, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _open(path) as f:
                    for offset, length, body in _members(f):
                        r = _parse(body)
                        rows.append((path, offset, length, r["page_id"], r["url"], r["digest"], r["record_type"]))
                        if len(rows) == 4096:
                            yield _table(rows, INDEX)
                            rows = []
                if rows:
                    yield _table(rows, INDEX)

    out = f"{folder}-index"
    # a stated number of tasks: Spark would merge the few small rows that name the files into one
    files.select("path").repartitionByRange(read_tasks(many, size), "path").mapInArrow(run, INDEX).write.parquet(out)
    return spark.read.schema(INDEX).parquet(out)


def _table(rows, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], [n for n, _ in names])


RECORD = "page_id bigint, url string, record_type string, digest string, refers_to bigint, payload_bytes bigint"


def read_records(index: DataFrame, *, payload: bool = False, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """The records that the rows of ``index`` point to; responses are checked against their
    digest.  ``payload=True`` adds the payload (null for revisits)."""
    order = Window.partitionBy("path").orderBy("offset")  # a file's selected records
    breaks = F.when(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap, 1).otherwise(0)
    spans = index.select("path", "offset", "length", breaks.alias("_new"))
    spans = spans.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = spans.groupBy("path", "_run", F.floor(F.col("offset") / size).alias("_cell")) \
                  .agg(F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("length")).alias("hi"),
                       F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
    schema = RECORD + (", payload binary" if payload else "")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                with _open(r["path"]) as f:
                    f.seek(r["lo"])
                    data = f.read(r["hi"] - r["lo"])
                for spot in r["records"]:
                    at = spot["offset"] - r["lo"]
                    rec = _parse(gzip.decompress(data[at:at + spot["length"]]))
                    if rec["payload"] is not None:
                        seen = base64.b32encode(hashlib.sha1(rec["payload"]).digest()).decode()
                        if seen != rec["digest"] or len(rec["payload"]) != rec["payload_bytes"]:
                            raise ValueError(f"damaged record at {r['path']}:{spot['offset']}")
                    rows.append(tuple(rec[c.split()[0]] for c in schema.split(", ")))
                yield _table(rows, schema)

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # bytes of the selected records
    return ranges.select("path", "lo", "hi", "records") \
        .repartitionByRange(read_tasks(size, size), "path", "lo").mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archive(read_table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return read_records(write_index(spark, folder)).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url")


# base32 of a digest: eight letters for each five bytes
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + (
    (CAST(('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS INT)]), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, url
FROM p
"""

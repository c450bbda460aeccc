"""Operator 8: WARC archives, written by tasks and read back sequentially.

One gzip member a record. Of records with equal payloads the one with the largest
page_id is the response; the others are revisits that carry headers only and refer
to it. Payloads are compared by SHA-1 digest and length, as the revisit profile
does. Each task writes archives of about ARCHIVE_BYTES to the shared folder under
a name of its own attempt and returns their names, so that a task that is run
again leaves only files nobody lists. Files are opened through the file system
that the folder's URI names.

The reader streams: bytes are inflated in bounded steps, a member at a time, headers
are parsed, content-length frames the block, and digests are verified while the
payload passes; a record that doesn't agree raises. Null html is empty, a null url
gives no target header, null page_ids are kept. Rows that share a page_id and its
payload are all responses where no larger page_id has that payload. Html of any
length is one record; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_sized, materialize, new_path, table

ARCHIVE_BYTES = 64 << 20
STEP = 1 << 16
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, payload_digest: str) -> bytes:
    """A record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_records(source) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(record headers, HTTP headers, payload) of each member of a file object; digests are verified."""
    raw = b""
    while True:
        raw = raw or source.read(STEP)
        if not raw:
            return
        member, text = zlib.decompressobj(31), bytearray()
        headers = length = None
        start = 0
        while not member.eof:
            piece = member.decompress(raw, STEP)
            raw = member.unconsumed_tail
            text += piece
            if headers is None and (end := text.find(b"\r\n\r\n")) >= 0:
                headers = _headers(bytes(text[:end]))
                start, length = end + 4, int(headers["content-length"])
            if not piece and not raw and not member.eof:
                raw = source.read(STEP)
                if not raw:
                    raise ValueError("truncated member")
        raw = member.unused_data
        if headers is None or len(text) != start + length + 4 or text[-4:] != b"\r\n\r\n":
            raise ValueError("content-length and record don't agree")
        block = bytes(text[start : start + length])
        if headers["warc-block-digest"] != "sha1:" + digest(block):
            raise ValueError("block digest doesn't agree")
        http, _, payload = block.partition(b"\r\n\r\n")
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != "sha1:" + digest(payload):
            raise ValueError("payload digest doesn't agree")
        yield headers, _headers(http), payload


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _write(base: str, archive_bytes: int):
    def run(batches):
        context = TaskContext.get()
        files, root = _open(base)
        files.create_dir(root, recursive=True)
        sink, name, size, count, number = None, "", 0, 0, 0
        out: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    name = f"part-{context.partitionId()}-{context.taskAttemptId()}-{number}.warc.gz"
                    sink, size, count, number = files.open_output_stream(f"{root}/{name}"), 0, 0, number + 1
                payload = (row["html"] or "").encode()
                raw = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                kind = "response" if row["refers_to"] is None else "revisit"
                data = record(row["page_id"], row["url"], payload, kind, row["refers_to"], raw)
                sink.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    sink.close()
                    out.append((name, count))
                    sink = None
        if sink is not None:
            sink.close()
            out.append((name, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{base}/{n}" for n, _ in out], pa.string()), pa.array([c for _, c in out], pa.int64())], ["archive", "records"]
        )

    return run


def write_archives(pages: DataFrame, base: str, min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html); returns a written table of (archive, records)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn(
        "digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    )
    rows = rows.withColumn("bytes", F.octet_length(F.coalesce("html", F.lit(""))))
    groups = materialize(
        rows.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("of")), "payloads"
    )
    several = groups.where((F.col("of") > 1) & (F.col("bytes") >= min_revisit))
    total = several.agg(F.sum("of")).first()[0] or 0
    if total:
        alone = rows.join(several.select("digest", "bytes"), ["digest", "bytes"], "left_anti").withColumn("last", F.col("page_id"))
        rows = join_sized(rows, several, ["digest", "bytes"], "of", total).drop("of").unionByName(alone)
    else:
        rows = rows.withColumn("last", F.col("page_id"))
    rows = rows.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last")))
    out = materialize(
        rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(base, archive_bytes), "archive string, records long"),
        "archives",
    )
    drop(groups)
    return out


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files that archives(archive) lists."""

    def batch_of(rows: list):
        return pa.RecordBatch.from_pylist(
            rows,
            schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]),
        )

    def run(batches):
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                files, path = _open(uri)
                with files.open_input_stream(path) as source:
                    for headers, http, payload in read_records(source):
                        kind = headers["warc-type"]
                        rows.append({
                            "page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
                            "payload": payload if payloads and kind == "response" else None,
                            "payload_bytes": int(http["content-length"]) if kind == "revisit" else len(payload),
                            "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "record_type": kind,
                            "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None,
                        })
                        held += len(payload) if payloads else 0
                        if len(rows) == 2000 or held > STEP * 64:
                            yield batch_of(rows)
                            rows, held = [], 0
        yield batch_of(rows)

    return archives.select("archive").mapInArrow(run, _READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    tasks = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism))
    rows = read_archives(archives.repartition(tasks), payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT page_id, octet_length(b) AS n, h, array_to_string(list_transform(range(1, 41),
    lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (position(h[i] IN '0123456789abcdef') - 1) + 1, 4)), '') AS bits FROM p),
d AS (SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i: substr('{_B32}', 1 +
    CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(bits[5 * i + j] AS INTEGER) * (1 << (5 - CAST(j AS INTEGER))))) AS INTEGER), 1)), '') AS digest FROM bits),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM g
"""

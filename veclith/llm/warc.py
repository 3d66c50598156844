"""WARC archives: a deterministic sharded writer and its reader.

Records are range-partitioned and sorted by page id. Each task streams its range into files
that roll at a compressed size; every record is a gzip member of its own with regenerated
headers and digests. Files are written under temporary names and renamed, and
``manifest.json``, written last, lists them with their sizes and digests.

Pages whose payload equals an earlier page's become ``revisit`` records. Which they are is
decided on (length, SHA-256) alone, in narrow shuffles; the verdicts then meet the pages in
the range shuffle itself, as small rows sorted in front of their page, so the payloads move
once.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARD_BYTES = 128 << 20
LEVEL = 3
#: Pages carry no date of their own; a fixed one keeps the archives reproducible.
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the upper 64 bits of record ids (a version 8 UUID); the lower ones are the page id.
UUID_TOP = 0x76656C6974688000


def record_id(page_id: int) -> str:
    """The record's URN; the page id can be had back from it."""
    low = page_id & 0xFFFFFFFFFFFFFFFF
    # the variant bits take the two uppermost ones, which move into the upper half
    return uuid.UUID(int=(UUID_TOP | low >> 62) << 64 | 2 << 62 | low & (1 << 62) - 1).urn


def page_of(urn: str) -> int:
    value = uuid.UUID(urn).int
    low = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One uncompressed record. ``refers_to``: the page that has the same payload, or null."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id or 0)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is None:
        head.append("WARC-Page-Without-ID: true")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(refers_to)}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(url: str | None) -> str:
    return "".join(c for c in url or "urn:none" if c >= " ")


def member(record: bytes, level: int = LEVEL) -> bytes:
    """The record as a gzip member without time or name, so equal records are equal bytes."""
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(record) + gz.flush()


def parse(record: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of a record; checks its digests."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]}")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("wrong record length")
    if fields["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError("wrong block digest")
    top, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, v in (x.split(": ", 1) for x in top.decode().split("\r\n")[1:])}
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError("wrong payload digest")
    return {"fields": fields, "http": http, "payload": payload}


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every gzip member of a stream."""
    rest, offset = b"", 0
    while True:
        gz, start, parts = zlib.decompressobj(31), offset, []
        while not gz.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts or offset != start:
                    raise ValueError("cut member")
                return
            parts.append(gz.decompress(rest))
            offset += len(rest) - len(gz.unused_data)
            rest = gz.unused_data
        yield start, b"".join(parts)


def verdicts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """_id and _first of each page that repeats the payload of an earlier page of at least ``min_bytes``.

    Pages without an id are never referred to and never revisits.
    """
    payload = common.text_of(html_col).cast("binary")
    keys = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.unhex(F.sha2(payload, 256)).alias("_sha"), F.octet_length(payload).alias("_size")).where(F.col("_size") >= min_bytes)
    first = keys.groupBy("_sha", "_size").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keys.join(first, ["_sha", "_size"]).where("_id <> _first").select("_id", "_first")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, level: int = LEVEL) -> dict:
    """Write one record a page into ``folder`` in ascending id order; returns the manifest.

    Null html is an empty payload, a null url becomes ``urn:none``. Null ids come first, in an
    order by hash, are responses and are flagged. Rows that repeat an id are each written, in url order; they
    are revisits of the first page with their payload only if that has another id. An empty
    table gives a manifest without files. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.lit(1).alias("_kind"), F.col(url_col).cast("string").alias("_url"), common.text_of(html_col).cast("binary").alias("_html"), F.lit(None).cast("long").alias("_first"))
    told = verdicts(pages, id_col, html_col, min_bytes).select("_id", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_url"), F.lit(None).cast("binary").alias("_html"), "_first").distinct()
    # the hash spreads pages without an id over tasks; they have no verdict that must stand before them
    order = [F.col("_id").asc_nulls_first(), F.when(F.col("_id").isNull(), F.xxhash64("_url", "_html"))]
    rows = rows.unionByName(told).repartitionByRange(*order).sortWithinPartitions(*order, "_kind", "_url")

    def records(batches):
        known, first = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                page, kind, url, html, to = (batch.column(k)[at].as_py() for k in range(5))
                if kind == 0:
                    known, first = page, to
                else:
                    yield build(page, url, html, first if page is not None and page == known else None)

    def archive(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, found, number = TaskContext.get(), records(batches), 0
        pending = next(found, None)
        while pending is not None:
            size, count, digest = 0, 0, hashlib.sha256()

            def put(out):
                nonlocal pending, size, count
                while pending is not None and (size < shard_bytes or not count):
                    data = member(pending, level)
                    out.write(data)
                    digest.update(data)
                    size, count = size + len(data), count + 1
                    pending = next(found, None)

            name = f"part-{task.partitionId():06d}-{number:04d}.warc.gz"
            common.publish(f"{folder}/{name}", str(task.taskAttemptId()), put)
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [count], "bytes": [size], "sha256": [digest.hexdigest()]})
            number += 1

    shards = [r.asDict() for r in rows.mapInArrow(archive, "name string, records long, bytes long, sha256 string").collect()]
    manifest = {"format": "WARC/1.1", "shards": sorted(shards, key=lambda s: s["name"])}
    common.publish(f"{folder}/manifest.json", "driver", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


#: Columns of :func:`read`.
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, shard string, offset long, payload binary"


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives that the manifest lists; a file is one task."""
    files, path = common.file_system(f"{folder}/manifest.json")
    shards = json.loads(files.open_input_stream(path).read())["shards"]
    arrow = common.arrow_schema(SCHEMA)

    def scan(batches):
        import pyarrow as pa
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rows, size, count = [], 0, 0
                files, path = common.file_system(f"{folder}/{shards[number]['name']}")
                with files.open_input_stream(path, compression=None) as stream:
                    for offset, record in members(stream):
                        got = parse(record)
                        head, revisit = got["fields"], got["fields"]["warc-type"] == "revisit"
                        rows.append({
                            "page_id": None if "warc-page-without-id" in head else page_of(head["warc-record-id"][1:-1]),
                            "url": head["warc-target-uri"],
                            "payload_bytes": int(got["http"]["content-length"]),
                            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
                            "record_type": head["warc-type"],
                            "refers_to": page_of(head["warc-refers-to"][1:-1]) if revisit else None,
                            "shard": shards[number]["name"],
                            "offset": offset,
                            "payload": got["payload"] if payloads and not revisit else None,
                        })
                        size, count = size + len(record), count + 1
                        if size > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                if count != shards[number]["records"]:
                    raise ValueError(f"{shards[number]['name']} differs from the manifest")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(scan, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no SHA-1 base32; the digest is built from its hex digits, five bits at a time.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT html, min(page_id) AS first_id FROM p GROUP BY html
), d AS (
  SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS hex, g.first_id
  FROM p JOIN g ON p.html = g.html
), b AS (
  SELECT *, list_transform(range(0, 32), lambda i: (
    CASE WHEN (i * 5) % 4 = 0 THEN (instr('0123456789abcdef', hex[(i * 5) // 4 + 1]) - 1) * 2 + (instr('0123456789abcdef', hex[(i * 5) // 4 + 2]) - 1) // 8
         WHEN (i * 5) % 4 = 1 THEN ((instr('0123456789abcdef', hex[(i * 5) // 4 + 1]) - 1) % 8) * 4 + (instr('0123456789abcdef', hex[(i * 5) // 4 + 2]) - 1) // 4
         WHEN (i * 5) % 4 = 2 THEN ((instr('0123456789abcdef', hex[(i * 5) // 4 + 1]) - 1) % 4) * 8 + (instr('0123456789abcdef', hex[(i * 5) // 4 + 2]) - 1) // 2
         ELSE ((instr('0123456789abcdef', hex[(i * 5) // 4 + 1]) - 1) % 2) * 16 + (instr('0123456789abcdef', hex[(i * 5) // 4 + 2]) - 1) END)) AS fives
  FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""

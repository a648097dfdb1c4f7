"""Web archives without repeated payloads, by revisit records.

Headers (page id, payload digest and size) are shuffled by digest; the smallest page id
of each digest owns the payload, and all other pages of the digest become revisit
records that name it.  Only payloads of at least ``MIN_BYTES`` take part.  Pages and
their owners meet in an equi-join on the digest, so a payload that a third of all pages
share is split by the engine like any skewed join.  Every task writes gzip-compressed
WARC/1.1 files of bounded size with fresh headers, under names of its own attempt; what
counts is the manifest, an ordinary table, so a task that runs again does no harm.
Archives are read back record by record.

Null html is an empty payload.  Rows that repeat the smallest page id of a digest are
all responses.  A null page id counts as larger than all others; its records carry no
page id.  An empty table gives no file and no row.
Only page_id, url and html are read; other
columns may have any names.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_partitions, open_fs, scratch_dir, ship

MIN_BYTES = 100
#: A file is closed once it holds so many compressed bytes.
FILE_BYTES = 64 << 20
#: Every record has this date: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html with ``payload_bytes`` and ``payload_digest`` (SHA-256, hex)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``headers`` with ``record_type`` and, for revisits, owner_id and owner_url."""
    rows = headers(pages)
    own = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    light = rows.filter(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id", "url")
    owners = light.groupBy("payload_digest").agg(own.alias("_own"), F.count("*").alias("_n")).filter("_n > 1").select("payload_digest", "_own")
    rows = rows.join(owners, "payload_digest", "left")
    revisit = F.coalesce((F.col("payload_bytes") >= min_bytes) & F.col("_own").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_own.page_id")), F.lit(False))
    return rows.select(
        "page_id", "url", F.when(revisit, "").otherwise(F.col("html")).alias("html"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_own.page_id")).alias("owner_id"), F.when(revisit, F.col("_own.url")).alias("owner_url"),
    )


def _record_id(page_id: int | None, row: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{row}'.encode()).digest()[:16], version=4)}>"


def _line(value: str | None) -> str:
    """A header value in one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value or "")


def record(page: dict) -> bytes:
    """One WARC record, not compressed."""
    page_id, digest, revisit = page["page_id"], page["payload_digest"], page["record_type"] == "revisit"
    payload = page["html"].encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % page["payload_bytes"]
    lines = [
        ("WARC-Type", page["record_type"]),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(page["url"])),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + len(payload))),
        ("X-Payload-Length", str(page["payload_bytes"])),
    ]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(page["owner_id"], digest)), ("WARC-Refers-To-Target-URI", _line(page["owner_url"])), ("WARC-Refers-To-Date", DATE)]
        lines += [("X-Refers-To-Page-ID", str(page["owner_id"]))] if page["owner_id"] is not None else []
    head = "".join(f"{k}: {v}\r\n" for k, v in lines if v)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def records(stream) -> iter:
    """(headers, payload) of every record of an open, decompressed archive."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        yield head, block.partition(b"\r\n\r\n")[2]


class _Gunzip(io.RawIOBase):
    """The bytes of a file of many gzip members, one member after the other."""

    def __init__(self, raw):
        self.raw, self.z, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.rest or self.raw.read(1 << 18)
            self.rest = b""
            if not data:
                return 0
            out = self.z.decompress(data, len(buffer))
            self.rest = self.z.unconsumed_tail if not self.z.eof else b""
            if out:
                buffer[: len(out)] = out
                return len(out)
            if self.z.eof and not self.z.unused_data:
                data = self.raw.read(1 << 18)
                if not data:
                    return 0
                self.z, self.rest = zlib.decompressobj(31), data


_MANIFEST = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write the archives; their folder and the manifest (name, records, bytes)."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_dir(spark, "warc")

    def save(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0

        def close():
            nonlocal out
            out.close()
            out = None
            return pa.RecordBatch.from_pylist([{"name": name, "records": n, "bytes": size}], schema=_MANIFEST)

        for batch in batches:
            for page in batch.to_pylist():
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = z.compress(record(page)) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
        if out is not None:
            yield close()

    rows = resolve(pages, min_bytes)
    return folder, materialize(rows.mapInArrow(save, "name string, records long, bytes long"), "warc-manifest")


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """Per record, from the files: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is measured and hashed anew and must be what its header says.
    """

    def load(batches):
        fs, base = open_fs(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, payload in records(io.BufferedReader(_Gunzip(f), 1 << 18)):
                        kind, size, digest = head["warc-type"], int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: payload of page {head.get('x-page-id')} is damaged")
                        number = lambda k: int(head[k]) if k in head else None
                        rows.append({"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id")})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    n = n_partitions(manifest.sparkSession)
    return manifest.select("name").repartition(n, "name").mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS owner FROM d WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to FROM d LEFT JOIN o USING (payload_digest)"""

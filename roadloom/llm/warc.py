"""WARC: write pages as archives of one gzip member per record, and read them back sequentially.

Writing runs as one task per input partition; every task streams its records into archives of a bounded
size in the shared folder and returns a manifest row per finished archive. A lost or repeated attempt
leaves a file that no manifest row names. Reading takes archives one after another within a task:
inflate member by member from small reads, frame each record by its Content-Length, check the block and
payload digests, and yield one row per record; no archive is held in memory.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

READ_BYTES = 1 << 16
ARCHIVE_BYTES = 256 << 20
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
    "payload_digest string, payload binary"
)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _line(value) -> str:
    """A header value: no line breaks."""
    return "" if value is None else " ".join(str(value).split())


def record_bytes(record_id: str, uri, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record. A revisit keeps the HTTP headers, whose Content-Length tells the payload's size, but
    not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {_line(uri)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(root: str, level: int, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(root)
        files.create_dir(base, recursive=True)
        out, made, name, n, size = None, [], "", 0, 0
        for batch in batches:
            for record_id, uri, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                payload = payload.as_py() or b""
                member = _member(
                    record_bytes(record_id.as_py(), uri.as_py(), payload, _sha1(payload), refers_to.as_py()), level
                )
                if out is not None and size + len(member) > limit:
                    out.close()
                    made.append((f"{root}/{name}", n, size))
                    out = None
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            made.append((f"{root}/{name}", n, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))],
            ["path", "n_records", "n_bytes"],
        )

    return write


def write_archives(records: DataFrame, root: str, level: int = 3, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records (record_id, target_uri, payload binary, refers_to; refers_to null for a response) and
    return the stored manifest, a row per archive. A null payload is empty; an empty table has no archive."""
    rows = records.select("record_id", "target_uri", "payload", "refers_to")
    made = rows.mapInArrow(_writer(f"{root}/archives", level, limit), MANIFEST)
    return common.store(made, "manifest", root)


class Members:
    """The gzip members of a stream, each as chunks of inflated bytes."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def _more(self) -> bytes:
        data, self.rest = self.rest or self.stream.read(READ_BYTES), b""
        return data

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while data := self._more():
            self.rest = data
            yield self._chunks()

    def _chunks(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.unconsumed_tail or self._more()
            if not data:
                raise ValueError("the archive ends within a gzip member")
            yield z.decompress(data, 4 * READ_BYTES)
        self.rest = z.unused_data


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_record(chunks: Iterator[bytes]) -> dict:
    """Frame one record by its Content-Length and check its digests as its bytes pass."""
    data = bytearray()
    while (end := data.find(b"\r\n\r\n")) < 0:
        data += next(chunks)
    head = _fields(bytes(data[:end]))
    if not data.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    length = int(head["content-length"])
    del data[: end + 4]
    for chunk in chunks:
        data += chunk
    if len(data) != length + 4 or data[length:] != b"\r\n\r\n":
        raise ValueError(f"{head['warc-record-id']}: the record's length isn't its Content-Length")
    block = bytes(data[:length])
    if head["warc-block-digest"] != f"sha1:{_sha1(block)}":
        raise ValueError(f"{head['warc-record-id']}: the block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(_fields(http)["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != n_bytes or _sha1(payload) != digest):
        raise ValueError(f"{head['warc-record-id']}: the payload digest differs")
    refers_to = head.get("warc-refers-to")
    return {
        "record_id": head["warc-record-id"][1:-1],
        "record_type": head["warc-type"],
        "target_uri": head["warc-target-uri"],
        "refers_to": refers_to[1:-1] if refers_to else None,
        "payload_bytes": n_bytes,
        "payload_digest": digest,
        "payload": payload if head["warc-type"] == "response" else None,
    }


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(k, pa.string()) for k in ("record_id", "record_type", "target_uri", "refers_to")]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = _filesystem(path)
                rows, size = [], 0
                with files.open_input_stream(name, compression=None) as stream:
                    for chunks in Members(stream):
                        row = read_record(chunks)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the manifest's archives; a record whose framing or digest is wrong ends the job
    with an error that names it."""
    n = max(1, manifest.count())
    paths = manifest.select("path").repartition(min(n, 4096))
    return paths.mapInArrow(_reader(with_payload), RECORDS)


def link_revisits(pages: DataFrame, id_col: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Add refers_to: null for responses; for the others of a group of equal payloads of at least
    min_bytes, the group's largest id. Only digests and ids are grouped, not payloads; a hot digest
    is one row after partial aggregation, and the join back is one that AQE can split."""
    digest = F.unhex(F.sha2(F.col(payload), 256))
    keyed = pages.withColumn("_digest", digest)
    repeated = (
        keyed.where(F.length(payload) >= min_bytes)
        .groupBy("_digest")
        .agg(F.max(id_col).alias("_head"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_digest", "_head")
    )
    joined = keyed.join(repeated, "_digest", "left")
    is_revisit = F.col("_head").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_head"))
    return joined.withColumn("refers_to", F.when(is_revisit, F.col("_head"))).drop("_digest", "_head")


def archive_pages(pages: DataFrame, min_bytes: int = 0, root: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) to archives; return the manifest.

    A null html is an empty payload, a null url an empty target. Rows that share the largest page_id of
    their group (repeated rows) are all responses. A null page_id is never the largest; such a row
    revisits a page with an id if there is one and is a response otherwise. Extra columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    linked = link_revisits(rows, "page_id", "payload", min_bytes)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    records = linked.select(
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        "payload",
        F.when(F.col("refers_to").isNotNull(), urn("refers_to")).alias("refers_to"),
    )
    return write_archives(records, root or common.shared_dir(spark))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, and describe each record that was read.

    Null pages have an empty payload; null ids come back as null; an empty table gives an empty one."""
    manifest = archive_pages(common.table(spark, sf_dir, "pages"))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return read_archives(manifest, with_payload=False).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


#: The digest in base 32 is built from hexadecimal digits, bit by bit.
OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body,
         array_to_string(list_transform(string_split(sha1(encode(coalesce(html, ''))), ''),
           lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111',
                            4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits
  FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
             + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT)
             + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
             + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT)
             + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT)
             + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), '') AS payload_digest
  FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM g
"""

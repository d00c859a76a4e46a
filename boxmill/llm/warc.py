"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Pages of equal payload are told apart from the first on: one is written as a response, the others as revisits
that name it and carry no payload.  The reader goes through an archive once, a chunk at a time: it inflates
a member, takes the header up to the empty line, then as many bytes as ``Content-Length`` says, and compares
block and payload with the digests in the header.  Neither side holds more than one record.

Tasks write under names of their own, and only the files that a task reported when it ended are read, so
what a lost or repeated task leaves behind does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.filesystem import open_filesystem
from boxmill.llm.ship import ship
from boxmill.operators.skew import lookup_join
from boxmill.session import scratch_root, settle

MIN_BYTES = 0  # smallest payload that can be a revisit
ARCHIVE_BYTES = 256 << 20  # an archive is closed once it is larger
CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"  # capture date of pages that come without one
# fixed values of the format
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Target-URI": quote(uri, safe="%:/?#[]@!$&'()*+,;=~"),
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base32_sha1(payload),
        "WARC-Block-Digest": "sha1:" + base32_sha1(block),
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    lines = [_VERSION, *(f"{k}: {v}".encode() for k, v in fields.items())]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(batches, folder: str, date: str, limit: int):
    disk, inside = open_filesystem(folder)
    disk.create_dir(inside, recursive=True)
    sink, path, size, records = None, "", 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            if sink is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                path, sink, size, records = f"{folder}/{name}", disk.open_output_stream(f"{inside}/{name}"), 0, 0
            payload = row["payload"].encode("utf-8")
            kind = "revisit" if row["refers_to"] is not None else "response"
            packed = _member(_record(kind, row["record_id"], row["uri"], payload, row["refers_to"], date))
            sink.write(packed)
            size, records = size + len(packed), records + 1
            if size > limit:
                sink.close()
                sink = None
                yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
    if sink is not None:
        sink.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    min_bytes: int = MIN_BYTES,
    date: str = DATE,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row to ``folder``; the written table path, records, bytes of the archives.

    Of rows with the same payload of ``min_bytes`` bytes or more those with the largest key are responses and
    the others revisits of it; a row without a key is a response only if no other row of its payload has
    one.  A NULL payload counts as empty, a NULL address is written as the empty one.  Rows of the same key
    and payload are written each.  Further columns are not written.
    """
    ship()
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"),
        body.alias("payload"),
        F.sha1(body.cast("binary")).alias("digest"),
    )
    narrow = pages.select(F.col(key).cast("long").alias("key"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size"))
    same = narrow.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("key").alias("newest"), F.count("*").alias("rows"))
    held = settle(same.where("rows > 1"))
    # the same plan at every size: a table that happens to fit in memory is not broadcast
    marked = lookup_join(rows, held.hint("merge"), ["digest"], "left", weight="rows", written=True)

    def urn(column: str):
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")))

    revisit = F.col("newest").isNotNull() & ~F.col("key").eqNullSafe(F.col("newest"))
    ready = marked.select(
        urn("key").alias("record_id"), "uri", "payload", F.when(revisit, urn("newest")).alias("refers_to")
    )
    return settle(ready.mapInArrow(lambda b: _write(b, folder, date, archive_bytes), "path string, records long, bytes long"))


class _Inflated:
    """Bytes of an archive, member by member."""

    def __init__(self, source, path: str):
        self.source, self.path = source, path
        self.raw = b""
        self.ready = bytearray()
        self.member = None

    def open(self) -> bool:
        """Go to the next member; false at the end of the file."""
        if not self.raw:
            self.raw = self.source.read(CHUNK)
        self.ready, self.member = bytearray(), zlib.decompressobj(31)
        return bool(self.raw)

    def fill(self) -> bool:
        """Inflate some more of this member; false at its end."""
        while not self.member.eof:
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    raise ValueError(f"{self.path} ends inside a record")
            made = self.member.decompress(self.raw, CHUNK)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if made:
                self.ready += made
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self.fill():
                raise ValueError(f"a header in {self.path} has no end")
        out = bytes(self.ready[: at + len(mark)])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.fill():
                raise ValueError(f"a record in {self.path} is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8").partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(source, path: str) -> Iterator[dict]:
    """The records of one archive, an open stream, in order; a wrong frame or digest is an error."""
    stream = _Inflated(source, path)
    while stream.open():
        version, *lines = stream.until(b"\r\n\r\n").split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start in {path}")
        head = _fields(lines)
        block = stream.take(int(head["content-length"]))
        if stream.take(4) != b"\r\n\r\n" or stream.ready or stream.fill():
            raise ValueError(f"record {head.get('warc-record-id')} in {path} does not end with its member")
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = head["warc-type"]
        told = _fields(http.split(b"\r\n")[1:])
        checks = [("warc-block-digest", block)] + [("warc-payload-digest", payload)] * (kind == "response")
        for name, data in checks:
            if name in head and head[name] != "sha1:" + base32_sha1(data):
                raise ValueError(f"{name} of record {head.get('warc-record-id')} in {path} does not match")
        yield {
            "record_id": head["warc-record-id"].strip("<>"),
            "record_type": kind,
            "uri": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_bytes": len(payload) if kind == "response" else int(told["content-length"]),
            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
            "payload": payload,
        }


def _read(batches, with_payload: bool):
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string())
                        for n, t in (f.split() for f in _RECORD.split(", "))])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            disk, inside = open_filesystem(path)
            rows, size = [], 0
            with disk.open_input_stream(inside) as source:
                for record in records(source, path):
                    size += len(record["payload"]) if with_payload else 0
                    if not with_payload:
                        record["payload"] = None
                    rows.append(record)
                    if len(rows) == 2000 or size > CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in column ``path``: record_id, record_type, uri, refers_to, payload_bytes,
    payload_digest, payload (NULL unless asked for; empty for revisits).

    One task reads a file from its start to its end.  A broken frame or a digest that does not match fails.
    """
    ship()
    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(parts, "path").mapInArrow(lambda b: _read(b, with_payload), _RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    folder = f"{scratch_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    read = read_archives(write_archives(pages, folder), with_payload=False)

    def page(column: str):
        return F.expr(f"try_cast(substring({column}, length('urn:page:') + 1) AS bigint)")

    return read.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def archive_pages_sql(pages: str, min_bytes: int = MIN_BYTES) -> str:
    """The same rows in DuckDB SQL."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = "(('0x' || substr(sha1(body), {a}, 5))::BIGINT)"
    text = " || ".join(
        f"substr('{letters}', ((({bits.format(a=5 * k + 1)}) >> {shift}) & 31)::INT + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0)
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM {pages}),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {text} AS payload_digest FROM p),
n AS (SELECT payload_digest, max(page_id) AS newest FROM d WHERE payload_bytes >= {min_bytes} GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
    CASE WHEN newest IS NULL OR newest IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN newest IS NULL OR newest IS NOT DISTINCT FROM page_id THEN NULL ELSE newest END AS refers_to
FROM d LEFT JOIN n USING (payload_digest)"""

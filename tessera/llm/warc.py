"""WARC archives as a chunked record table.

Writing: each task streams its rows into one archive of gzip members, one member per record, under the shared folder.
Reading: each archive is parsed as a stream of bounded reads, and a record becomes rows (record_id, chunk_no, ...) of at
most chunk_bytes each. Every chunk carries the digest and the length of the payload up to its end, so the last chunk has
those of the whole payload, and no record is ever held in memory as a whole.

Payload copies: of the records with equal payloads of at least `least_bytes` bytes, the one with the largest id is stored
in full, the others as revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stash

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, page_id string, record_type string, refers_to string, target_uri string, declared_bytes long, declared_sha1 string, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far string, is_last boolean"


def file_system(path: str):
    """The file system of a URI or local path, as executors reach it, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_types(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 1000) -> DataFrame:
    """(page_id, sha1, refers_to, origin): each distinct (id, payload) that is to be a revisit record, and each that these refer to, with the place of its first row (origin).

    Payloads are equal when length, SHA-1 and SHA-256 are. The grouped maximum is combined before the shuffle; the join
    back carries digests only, and adaptive execution may split it where one payload is hot.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.unhex(F.sha1(body)).alias("sha1"), F.unhex(F.sha2(body, 256)).alias("sha256"), F.octet_length(body).alias("n_bytes"), F.monotonically_increasing_id().alias("row")).filter(F.col("n_bytes") >= least_bytes)
    groups = rows.groupBy("sha1", "sha256", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).filter("k > 1 AND refers_to IS NOT NULL").drop("k")
    found = rows.join(groups, ["sha1", "sha256", "n_bytes"])
    return found.groupBy("page_id", "sha1", "refers_to").agg(F.min("row").alias("row")).select("page_id", "sha1", "refers_to", F.when(F.col("page_id") == F.col("refers_to"), F.col("row")).alias("origin"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Write one WARC record per row under path and return the archives that count: (path, records, bytes).

    A task writes to a name of its own attempt, so that a retried or speculative task leaves at most a stray file which
    no returned row names. Null payload: empty. Null url: urn:none. Repeated rows: a record each; of rows that repeat
    both the largest id and the payload, each is a response, and revisits refer to the first. Null ids never win; equal
    payloads under null ids alone are all responses. Ids may hold any characters (they are percent-encoded in the
    headers), urls and payloads any length; a payload is in memory as a whole only as the row that Spark hands over.
    Empty input: no archive. Other columns, whatever their names, are not read.
    """
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"), F.unhex(F.sha1(body.cast("binary"))).alias("sha1"), F.monotonically_increasing_id().alias("row"))
    twins = record_types(pages, id_col, payload_col, least_bytes).withColumnRenamed("page_id", "twin_id").withColumnRenamed("sha1", "twin_sha1")
    rows = rows.join(twins, F.col("page_id").eqNullSafe(F.col("twin_id")) & (F.col("sha1") == F.col("twin_sha1")), "left")
    revisit = F.col("twin_sha1").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = rows.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"), revisit.alias("revisit"), (F.col("row") == F.col("origin")).alias("origin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        name, sink, n, size = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        try:
            for b in batches:
                for page, url, payload, refers, revisit, origin in zip(*(b.column(i) for i in range(6)), strict=True):
                    sink = sink or fs.open_output_stream(f"{base}/{name}", compression=None)
                    for part in record_parts(page.as_py(), url.as_py(), memoryview(payload.as_buffer() or b""), refers.as_py(), revisit.as_py(), chunk_bytes, bool(origin.as_py())):
                        size += len(part)
                        sink.write(part)
                    n += 1
        finally:
            if sink:
                sink.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return stash(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def origin_id(page: str, sha1: bytes) -> str:
    """The id of a record that others refer to: a name-based UUID of its page's id and its payload, so that they know it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{sha1.hex()} {page}')}>"


def record_parts(page: str | None, url: str | None, payload: memoryview, refers_to: str | None, revisit: bool, chunk_bytes: int, origin: bool = False) -> Iterator[bytes]:
    """The compressed parts of one record; the payload is digested and compressed chunk by chunk."""
    sha1 = hashlib.sha1()
    for at in range(0, len(payload), chunk_bytes):
        sha1.update(payload[at : at + chunk_bytes])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": origin_id(page, sha1.digest()) if origin else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(sha1.digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(http) + (0 if revisit else len(payload))),
    }
    if page is not None:
        named["X-Page-ID"] = quote(page)
    if revisit:
        named |= {"WARC-Profile": PROFILE, "WARC-Refers-To": origin_id(refers_to, sha1.digest()), "X-Refers-To-Page-ID": quote(refers_to)}
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n"
    yield squeeze.compress(head.encode() + http)
    for at in range(0, 0 if revisit else len(payload), chunk_bytes):
        yield squeeze.compress(payload[at : at + chunk_bytes])
    yield squeeze.compress(b"\r\n\r\n") + squeeze.flush()


class _Stream:
    """Decompressed bytes of an archive of gzip members, read a bounded piece at a time."""

    def __init__(self, source, piece: int):
        self.source, self.piece, self.raw, self.held, self.inside = source, piece, b"", bytearray(), False
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.inflate.unconsumed_tail or self.source.read(self.piece)
            if not self.raw:
                if self.inside:
                    raise ValueError("the archive ends inside a gzip member")
                return False
        self.inside = True
        self.held += self.inflate.decompress(self.raw, self.piece)
        if self.inflate.eof:
            self.raw, self.inflate, self.inside = self.inflate.unused_data, zlib.decompressobj(31), False
        else:
            self.raw = self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a header block")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def starts(self, mark: bytes) -> bool:
        """Whether mark comes next; the end of the archive is no mark."""
        while len(self.held) < len(mark):
            if not self.more():
                break
        return self.held.startswith(mark)

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def read_records(source, chunk_bytes: int = 1 << 20) -> Iterator[tuple]:
    """Chunk rows of one archive, in its order; a record without payload has one empty chunk."""
    stream = _Stream(source, min(chunk_bytes, 1 << 18))
    while stream.starts(b"WARC/") or stream.held.strip():
        if not stream.starts(b"WARC/"):
            raise ValueError(f"not a WARC record: {bytes(stream.held[:40])!r}")
        head = stream.until(b"\r\n\r\n")
        if head is None:
            break
        lines = head.decode("utf-8").split("\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(named["content-length"])
        http = stream.until(b"\r\n\r\n")
        left -= len(http) + 4
        sent = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        kind, page, refers = named["warc-type"], named.get("x-page-id"), named.get("x-refers-to-page-id")
        digest = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
        fixed = (named["warc-record-id"], page and unquote(page), kind, refers and unquote(refers), named["warc-target-uri"], int(sent["content-length"]), digest)
        sha1, done, no = hashlib.sha1(), 0, 0
        while True:
            chunk = stream.take(min(chunk_bytes, left - done))
            sha1.update(chunk)
            done += len(chunk)
            last = done == left
            if last and kind == "response" and sha1.hexdigest() != digest:
                raise ValueError(f"{named['warc-record-id']}: the payload does not match its digest")
            yield (*fixed, no, chunk, done, sha1.copy().hexdigest(), last)
            if last:
                break
            no += 1
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")


def read_archives(manifest: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunked record table of the archives that manifest(path) lists; one task reads whole archives, chunk by chunk.

    Each row holds at most chunk_bytes of payload. A damaged archive raises. No archive: no rows.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]]) for n, x in zip(names, CHUNKS.split(", "), strict=True)])
        for b in batches:
            for where in b.column(0).to_pylist():
                fs, at = file_system(where)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for row in read_records(source, chunk_bytes):
                        rows.append(row)
                        held += len(row[8]) + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path").mapInArrow(run, CHUNKS)


def summary(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk, without a shuffle: what a revisit record lacks comes from its headers."""
    own = F.col("record_type") == "response"
    return chunks.filter("is_last").select(
        "page_id",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("sha1_so_far")).otherwise(F.col("declared_sha1")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back as the chunked record table."""
    return read_archives(write_archives(pages, shared_path(pages.sparkSession, "warc")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
                  max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM g
"""

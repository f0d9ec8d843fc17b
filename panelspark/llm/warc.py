"""Write and read web archives as a table of record chunks.

A payload never has to exist as one archive record in memory: it is compressed and written
chunk by chunk, and read back as rows ``(record, chunk number, bytes)`` that carry the digest of
all bytes so far. Every record is a gzip member of its own, so archives can be read from any
record on; the manifest of segments says where.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import partitions, ship, written

# Bytes of a payload handled at once, compressed bytes of a segment (the unit of reading), and of an archive.
CHUNK, SEGMENT, ARCHIVE = 1 << 20, 32 << 20, 1 << 30
# Fewest bytes of a payload that may be stored once for several records.
SHARED_FROM = 0
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:record:"

MANIFEST = "path string, start bigint, size bigint, records bigint"
CHUNKS = "name string, uri string, kind string, refers string, chunk bigint, last boolean, size bigint, digest string"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder in the shared storage."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header(kind: str, name: str, uri: str, refers: str | None, digest: str, size: int, stored: bool) -> tuple[bytes, bytes]:
    """Record header and the head of its block, an HTTP response of ``size`` payload bytes."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{NAME}{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{NAME}{refers}>", f"WARC-Profile: {REVISIT}"]
    lines.append(f"Content-Length: {len(head) + (size if stored else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), head


def _write(folder: str):
    """Task function: rows ``(name, uri, payload, digest, refers)`` to archives; gives the manifest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        context = TaskContext.get()
        # attempts write to files of their own; only those of the attempt that counts are in the manifest
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, path, at, number = None, "", 0, 0
        start = records = 0
        done: list[tuple] = []
        try:
            for batch in batches:
                names, uris, payloads, digests, refers = batch.columns
                for i in range(batch.num_rows):
                    if out is None:
                        file = f"{stem}-{number:05d}.warc.gz"
                        path, at, start, number = f"{folder}/{file}", 0, 0, number + 1
                        out = store.open_output_stream(f"{top}/{file}", compression=None)
                    buffer = payloads[i].as_buffer()
                    payload = memoryview(buffer) if buffer is not None else memoryview(b"")
                    target = refers[i].as_py()
                    kind = "response" if target is None else "revisit"
                    digest = base32(bytes.fromhex(digests[i].as_py()))
                    first, head = header(kind, names[i].as_py(), uris[i].as_py() or "", target, digest, len(payload), target is None)
                    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.write(squeeze.compress(first + head))
                    if target is None:
                        for place in range(0, len(payload), CHUNK):
                            out.write(squeeze.compress(payload[place : place + CHUNK]))
                    out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                    records += 1
                    at = out.tell()
                    if at - start >= SEGMENT:
                        done.append((path, start, at - start, records))
                        start, records = at, 0
                    if at >= ARCHIVE:
                        if records:
                            done.append((path, start, at - start, records))
                            records = 0
                        out.close()
                        out = None
            if out is not None and records:
                done.append((path, start, at - start, records))
        finally:
            if out is not None:
                out.close()
        columns = list(zip(*done)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "start", "size", "records"])

    return work


def write_archives(
    pages: DataFrame, folder: str, id: str = "page_id", uri: str = "url", payload: str = "html", shared_from: int = SHARED_FROM
) -> DataFrame:
    """Write one record per row to archives under ``folder``; returns the manifest of segments.

    Of rows with equal payloads of at least ``shared_from`` bytes, those with the largest id store
    it (response) and the others refer to it (revisit). A null payload is empty. A null id counts
    as the smallest; a row alone with it is a response. Rows that repeat the largest id all store
    the payload. An empty table gives no archive.
    """
    spark = pages.sparkSession
    ship(spark)
    store, top = opened(folder)
    store.create_dir(top, recursive=True)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{uri}`").cast("string").alias("uri"), body.alias("payload"))
    digests = written(rows.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")), "digests")
    groups = digests.where(F.col("bytes") >= shared_from).groupBy("digest", "bytes")
    shared = groups.agg(F.max("id").alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1 and to is not null")
    shared = written(shared.select("digest", "bytes", "to"), "shared")
    refers = digests.join(shared, ["digest", "bytes"]).where("id is null or id < to")
    refers = written(refers.select("id", "digest", F.col("to").cast("string").alias("refers")).distinct(), "refers")
    # the digest is part of the key: a repeated id may have different payloads
    own = rows.withColumn("digest", F.sha1("payload")).alias("a")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest"))
    joined = own.join(refers.alias("b"), same, "left")
    ready = joined.select(F.coalesce(F.col("a.id").cast("string"), F.lit("")).alias("name"), "uri", "payload", "a.digest", "refers")
    return written(ready.mapInArrow(_write(folder), MANIFEST), "manifest")


class Members:
    """The decompressed bytes of one gzip member after the other, read in bounded portions."""

    def __init__(self, source, size: int):
        self.source, self.left, self.raw = source, size, b""
        self.member: zlib._Decompress | None = None
        self.ready = b""

    def more(self) -> bool:
        """Decompress another portion of the current member."""
        while not self.member.eof:
            if not self.raw:
                self.raw = self.source.read(min(CHUNK, self.left))
                self.left -= len(self.raw)
                if not self.raw:
                    raise ValueError("the archive ends inside a record")
            portion = self.member.decompress(self.raw, CHUNK)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if portion:
                self.ready += portion
                return True
        return False

    def next_member(self) -> bool:
        if not self.left and not self.raw:
            return False
        self.member, self.ready = zlib.decompressobj(31), b""
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record header does not end")
        found, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return found

    def portions(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise ValueError("a record is shorter than its header says")
            part, self.ready = self.ready[: min(size, CHUNK)], self.ready[min(size, CHUNK) :]
            size -= len(part)
            yield part


def fields(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _read(keep: bool):
    def rows(path: str, start: int, size: int) -> Iterator[tuple]:
        store, where = opened(path)
        with store.open_input_file(where) as source:
            source.seek(start)
            members = Members(source, size)
            while members.next_member():
                about = fields(members.until(b"\r\n\r\n"))
                http = members.until(b"\r\n\r\n")
                told = int(fields(http)["content-length"])
                stored = int(about["content-length"]) - len(http) - 4
                name, kind = about["warc-record-id"][len(NAME) + 1 : -1], about["warc-type"]
                refers = about["warc-refers-to"][len(NAME) + 1 : -1] if "warc-refers-to" in about else None
                digest, total, chunk = hashlib.sha1(), 0, 0
                held = b""
                for part in members.portions(stored):
                    if total:
                        yield name, about["warc-target-uri"], kind, refers, chunk, False, total, base32(digest.digest()), held
                        chunk += 1
                    digest.update(part)
                    total += len(part)
                    held = part if keep else b""
                if kind == "response" and f"sha1:{base32(digest.digest())}" != about["warc-payload-digest"]:
                    raise ValueError(f"record {name} of {path} does not have the digest its header says")
                size_, sum_ = (total, base32(digest.digest())) if kind == "response" else (told, about["warc-payload-digest"][5:])
                yield name, about["warc-target-uri"], kind, refers, chunk, True, size_, sum_, held
                if b"".join(members.portions(4)) != b"\r\n\r\n" or members.more():
                    raise ValueError(f"record {name} of {path} does not end where its header says")

    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary())
    names = ["name", "uri", "kind", "refers", "chunk", "last", "size", "digest", "bytes"]
    if not keep:
        kinds, names = kinds[:-1], names[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.to_pylist():
                pending, held = [], 0
                for row in rows(segment["path"], segment["start"], segment["size"]):
                    pending.append(row)
                    held += len(row[-1])
                    if held >= 8 * CHUNK or len(pending) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pending), kinds)], names)
                        pending, held = [], 0
                if pending:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pending), kinds)], names)

    return work


def read_archives(manifest: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """Chunk rows of all records: ``name, uri, kind, refers, chunk, last, size, digest[, bytes]``.

    ``size`` and ``digest`` cover the payload up to this chunk, and in the ``last`` row of a record
    the whole of it; a revisit has one row, with the size and digest of the full payload. A
    response whose bytes do not have the digest of its header, or a record that is cut off,
    raises ``ValueError``. A segment is one unit of work.
    """
    spark = manifest.sparkSession
    ship(spark)
    dealt = manifest.select("path", "start", "size").repartition(partitions(spark), "path", "start")
    return dealt.mapInArrow(_read(keep_bytes), CHUNKS + ", bytes binary" * keep_bytes)


def round_trip(pages: DataFrame, id: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """``id, payload_bytes, payload_digest, record_type, refers_to`` as read back from the archives."""
    kind = pages.select(F.col(f"`{id}`")).schema[0].dataType.simpleString()
    manifest = write_archives(pages, scratch_folder(pages.sparkSession, "archives"), id, uri, payload)
    ends = read_archives(manifest, keep_bytes=False).where("last")
    return ends.select(
        F.when(F.col("name") != "", F.col("name")).cast(kind).alias(id),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
    )

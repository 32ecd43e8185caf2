"""WARC archives: a writer that stores repeated payloads once, and a sequential reader.

An archive segment is one row (name, content): gzip members, one for each record. Segments come
from write_segments, or small files by spark.read.format("binaryFile") (columns path, content). Files
of any size are read by read_files, which streams them by path and never holds more than a record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
#: Bytes that the decompressor gets, and gives, at a time.
STEP = 1 << 16


class Record(NamedTuple):
    """One record as read: header fields by lower-case name, the HTTP head, the payload (None unless
    asked for), its length and SHA-256 as read, and whether frame and digests hold."""

    fields: dict[str, str]
    http: bytes
    payload: bytes | None
    payload_bytes: int
    payload_sha256: str
    intact: bool


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(kind: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member. A revisit carries the HTTP head of its payload, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
    ]
    if url is not None:
        head.insert(2, ("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    whole = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(whole) + press.flush()


class _Frame:
    """Takes a member's bytes as they are inflated: header, block by Content-Length, end mark. The block
    is hashed as it passes; its payload is kept only if asked for."""

    def __init__(self, with_payload: bool) -> None:
        self.head, self.http, self.tail = bytearray(), bytearray(), bytearray()
        self.fields: dict[str, str] | None = None
        self.left, self.broken, self.in_payload = 0, False, False
        self.block, self.payload = hashlib.sha256(), hashlib.sha256()
        self.size, self.kept = 0, [] if with_payload else None

    def feed(self, data: bytes) -> None:
        if self.fields is None and not self.broken:
            data = self._header(data)
        mine, rest = data[: self.left], data[self.left :]
        if mine:
            self.left -= len(mine)
            self.block.update(mine)
            self._body(mine)
        if rest and len(self.tail) <= 4:
            self.tail += rest[:5]

    def _header(self, data: bytes) -> bytes:
        known = max(len(self.head) - 3, 0)
        self.head += data
        end = self.head.find(b"\r\n\r\n", known)
        if end < 0:
            self.broken = not self.head.startswith(b"WARC/"[: len(self.head)])  # a header may have any length
            return b""
        lines = bytes(self.head[:end]).decode("utf-8", "replace").split("\r\n")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = self.fields.get("content-length", "")
        self.broken = not self.head.startswith(b"WARC/") or not length.isdigit()
        self.left = 0 if self.broken else int(length)
        return bytes(self.head[end + 4 :])

    def _body(self, data: bytes) -> None:
        if not self.in_payload:
            known = max(len(self.http) - 3, 0)
            self.http += data
            end = self.http.find(b"\r\n\r\n", known)
            if end < 0:
                return
            self.in_payload, data = True, bytes(self.http[end + 4 :])
            del self.http[end:]
        self.payload.update(data)
        self.size += len(data)
        if self.kept is not None:
            self.kept.append(data)

    def record(self, whole: bool) -> Record | None:
        """The record, or None where no byte came. One whose block has no HTTP head has no payload."""
        if whole and not self.head:
            return None
        fields = self.fields or {}
        digest = self.payload.hexdigest()
        intact = whole and self.fields is not None and not self.broken and not self.left and bytes(self.tail) == b"\r\n\r\n" and fields.get("warc-block-digest") == "sha256:" + self.block.hexdigest()
        if fields.get("warc-type") == "response":
            intact = intact and fields.get("warc-payload-digest") == "sha256:" + digest
        return Record(fields, bytes(self.http), None if self.kept is None else b"".join(self.kept), self.size, digest, intact)


def read_records(source: bytes | BinaryIO, with_payload: bool = True) -> Iterator[Record]:
    """The records of a segment in order. Members are inflated in steps of bounded size in and out, the
    block is framed by Content-Length, and both digests are computed from what is read and compared. A
    member that is cut short, or does not end where its length says, gives a record that is not
    intact; bytes that are no member end the segment."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    given = stream.read(STEP)
    while given:
        inflate, frame, whole = zlib.decompressobj(31), _Frame(with_payload), True
        try:
            while not inflate.eof and given:
                frame.feed(inflate.decompress(given, STEP))
                given = inflate.unused_data if inflate.eof else inflate.unconsumed_tail or stream.read(STEP)
        except zlib.error:
            whole, given = False, b""
        else:
            given = given or stream.read(STEP)
        if (x := frame.record(whole and inflate.eof)) is not None:
            yield x


def repeats(pages: DataFrame, id_col: str, payload: Column, least_bytes: int) -> DataFrame:
    """pages with _payload (binary) and _first: the smallest id with an equal payload if it has at
    least least_bytes and this row is not it. Minima are combined before the shuffle, and the join
    on the digest can be split where a payload is common."""
    rows = pages.withColumn("_payload", F.coalesce(payload, F.lit("")).cast("binary")).withColumn("_digest", F.sha2("_payload", 256))
    long = F.octet_length("_payload") >= least_bytes
    first = rows.where(long).groupBy("_digest").agg(F.min(id_col).alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = first.withColumnRenamed("_digest", "_of")
    met = rows.join(first, long & (F.col("_digest") == F.col("_of")), "left")
    return met.withColumn("_first", F.when(F.col("_least") != F.col(id_col), F.col("_least"))).drop("_of", "_least", "_digest")


def write_segments(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, segment_bytes: int = 1 << 20, prefix: str = "urn:page:") -> DataFrame:
    """(name, n_records, content): segments of about segment_bytes, made partition by partition.

    A null payload is empty. Among equal payloads of at least least_bytes the smallest id is the
    response, the others revisit it; the same id again is written again as a response. A null id
    is written as a response under prefix + "null" and is never referred to. A payload of any length is one
    record, and one above segment_bytes is a segment by itself. Extra columns are not read, whatever
    their names; an empty table gives no segment.
    """
    rows = repeats(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(payload_col).alias("_html")), "_id", F.col("_html"), least_bytes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, name = 0, ""

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([len(held)], pa.int32()), "content": pa.array([b"".join(held)], pa.binary())})
            held.clear()
            return out

        for batch in batches:
            for doc, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("_id", "_url", "_payload", "_first"))):
                me = f"{prefix}{'null' if doc is None else doc}"
                one = record("response", me, url, payload) if first is None else record("revisit", me, url, payload, f"{prefix}{first}")
                name = name if held else f"{me.rpartition(':')[2]}.warc.gz"
                held.append(one)
                size += len(one)
                if size >= segment_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.select("_id", "_url", "_payload", "_first").mapInArrow(each, "name string, n_records int, content binary")


COLUMNS = {"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "intact": pa.bool_(), "payload": pa.binary()}
#: Payload bytes and records after which a reader hands on what it has.
FLUSH_BYTES, FLUSH_RECORDS = 8 << 20, 4096


def _row(x: Record) -> tuple:
    """A response tells what was read; a revisit has no payload, so what its headers say of it."""
    bare = lambda v: v[1:-1] if v and v[0] == "<" and v[-1] == ">" else v
    kind, size, digest = x.fields.get("warc-type"), x.payload_bytes, x.payload_sha256
    if kind == "revisit":
        told = next((line.split(b":")[1].strip() for line in x.http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")), b"")
        size, digest = int(told) if told.isdigit() else 0, x.fields.get("warc-payload-digest", "").rpartition(":")[2]
    return bare(x.fields.get("warc-record-id")), kind, x.fields.get("warc-target-uri"), bare(x.fields.get("warc-refers-to")), size, digest, x.intact, None if kind == "revisit" else x.payload


def _batches(records: Iterator[Record], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [c for c in COLUMNS if with_payload or c != "payload"]
    held: list[tuple] = []
    size = 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, COLUMNS[n]) for c, n in zip(zip(*held), names)], names)
    for x in records:
        held.append(_row(x)[: len(names)])
        size += x.payload_bytes if with_payload else 0
        if size >= FLUSH_BYTES or len(held) >= FLUSH_RECORDS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _schema(with_payload: bool) -> str:
    return "record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, intact boolean" + ", payload binary" * with_payload


def read_segments(segments: DataFrame, content_col: str = "content", with_payload: bool = True) -> DataFrame:
    """One row per record: record_id, record_type, url, refers_to, payload_bytes (of the full
    payload, for revisits too), payload_digest (bare hex), intact, and payload (null for revisits).
    Length and digest of a response are those of the payload as read. Records whose frame or digest
    fails come with intact false; a null content has no records; other columns are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if content.is_valid:
                    yield from _batches(read_records(pa.BufferReader(content.as_buffer()), with_payload), with_payload)

    return segments.select(content_col).mapInArrow(each, _schema(with_payload))


def read_files(paths: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """The records of archive files as read_segments gives them. Each path (a URI or an absolute path
    that executors see) is opened where its row lies and streamed; deal the paths out before. A null
    path has no records."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).drop_null().to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression=None) as stream:
                    yield from _batches(read_records(stream, with_payload), with_payload)

    return paths.select(path_col).mapInArrow(each, _schema(with_payload))

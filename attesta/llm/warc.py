"""WARC records in seekable Zstandard bundles, written and read by tasks.

Records are grouped into independent frames; a footer in a skippable frame lists the size of
every frame (the public seekable format), and an index maps each record to its bundle, the
offset of its frame and its offset inside the frame.

A task writes bundles of names no other attempt has, and hands their index rows to Spark. Only
index rows of successful tasks are kept by Spark's own commit, so what a lost or repeated
attempt left behind is never read. Bundles lie in the shared folder; tasks reach it through
pyarrow's file systems (local or mounted paths, hdfs, s3, gs).

Defined results: a null payload is written as an empty one; records with equal payloads are
one response, that of the smallest id, and revisits of it; if that id occurs twice with the
payload, each such record is a response; a record without id is a revisit unless all of its
kind lack one. A null address writes no address line; control characters in it are written as
percent codes. No pages give no bundle and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import map_arrow
from attesta.session import materialize

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FOOTER = "<IBI"
FOOTER_BYTES = 9
ENTRY = "<II"
ENTRY_BYTES = 8
# Fixed values of the record format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20

INDEX = ("bundle string, page_id {id}, record_type string, frame int, frame_offset long, "
         "frame_bytes long, record_offset long, record_bytes long")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: object) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def _id_of(name: str) -> str | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "-" else value


def _one_line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(page_id: object, url: str | None, payload: bytes, kind: str, refers_to: object) -> bytes:
    """One WARC/1.1 record. A revisit keeps the response's headers and leaves out its body."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_name(page_id)}\r\n"
            f"WARC-Date: {NO_DATE}\r\n"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}\r\n")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}\r\n")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_name(refers_to)}\r\n")
    else:
        block += payload
    head.append("Content-Type: application/http; msgtype=response\r\n"
                f"Content-Length: {len(block)}\r\n\r\n")
    return "".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    block = data[stop + 4:stop + 4 + size]
    if len(block) != size or data[stop + 4 + size:stop + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"the record at offset {at} is cut off")
    return headers, block, stop + 8 + size


class BundleWriter:
    """Frames one after another, then the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.sizes: list[tuple[int, int]] = []
        self.offset = 0
        self.waiting: list[bytes] = []
        self.filled = 0
        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset inside the frame. `flush` tells where the frame begins."""
        place = (len(self.sizes), self.filled)
        self.waiting.append(data)
        self.filled += len(data)
        return place

    def full(self) -> bool:
        return self.filled >= self.frame_bytes

    def flush(self) -> tuple[int, int] | None:
        """Write the open frame; (offset, size) of it, or None if it has no record."""
        if not self.waiting:
            return None
        packed = self.compress(b"".join(self.waiting))
        self.stream.write(packed)
        self.sizes.append((len(packed), self.filled))
        began, self.offset = self.offset, self.offset + len(packed)
        self.waiting, self.filled = [], 0
        return began, len(packed)

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack(ENTRY, *s) for s in self.sizes)
        table += struct.pack(FOOTER, len(self.sizes), 0, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


def seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """(offset, packed bytes, bytes) of every frame, from the footer alone."""
    stream.seek(size - FOOTER_BYTES)
    count, flags, magic = struct.unpack(FOOTER, stream.read(FOOTER_BYTES))
    if magic != FOOTER_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    entry = ENTRY_BYTES + (4 if flags & 0x80 else 0)
    stream.seek(size - FOOTER_BYTES - count * entry)
    raw, frames, at = stream.read(count * entry), [], 0
    for i in range(count):
        packed, whole = struct.unpack_from(ENTRY, raw, i * entry)
        frames.append((at, packed, whole))
        at += packed
    return frames


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                  html: str = "html") -> DataFrame:
    """(page_id, url, html, record_type, refers_to). Bodies are not grouped, digests are."""
    known = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
                         F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    known = known.withColumn("digest", F.sha2("html", 256))
    first = (known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    joined = known.join(first, "digest", "left")
    own = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html",
                         F.when(own, "response").otherwise("revisit").alias("record_type"),
                         F.when(~own, F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, root: str, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all records below `root`; the index, one row per record, already on disk."""
    records = with_revisits(pages)
    kind = records.schema["page_id"].dataType.simpleString()
    schema = INDEX.format(id=kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(root)
        writer, name, rows = None, "", []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    place.create_dir(base, recursive=True)
                    writer = BundleWriter(
                        place.open_output_stream(f"{base}/{name}", compression=None), frame_bytes)
                data = record(row["page_id"], row["url"], row["html"].encode("utf-8", "replace"),
                              row["record_type"], row["refers_to"])
                frame, at = writer.add(data)
                rows.append([name, row["page_id"], row["record_type"], frame, None, None, at,
                             len(data)])
                if writer.full():
                    done += _placed(rows, writer.flush())
                    rows = []
                    if writer.offset >= bundle_bytes:
                        writer.close()
                        writer = None
            if done:
                yield _index_batch(done, kind)
        if writer is not None:
            done = _placed(rows, writer.flush()) if rows else []
            writer.close()
            if done:
                yield _index_batch(done, kind)

    return materialize(map_arrow(records, list(records.columns), work, schema), "warc-index")


def _placed(rows: list[list], frame: tuple[int, int]) -> list[list]:
    for row in rows:
        row[4], row[5] = frame
    return rows


def _index_batch(rows: list[list], kind: str) -> pa.RecordBatch:
    types = [pa.string(), {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string()),
             pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["bundle", "page_id", "record_type", "frame", "frame_offset", "frame_bytes",
             "record_offset", "record_bytes"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


RECORD = ("page_id {id}, url string, record_type string, refers_to {id}, payload binary, "
          "payload_bytes long, payload_digest string")


def read_bundles(spark: SparkSession, root: str, bundles: DataFrame, kind: str = "bigint",
                 with_payload: bool = True) -> DataFrame:
    """Records of the named bundles (column `bundle`). Seek tables are read first, and then
    every frame is a row of its own, so one large bundle is read by many tasks."""
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                path = f"{base}/{name}"
                with place.open_input_file(path) as f:
                    table = seek_table(f, f.size())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(table)), pa.array([t[0] for t in table], pa.int64()),
                     pa.array([t[1] for t in table], pa.int64())], names=["bundle", "at", "packed"])

    listed = (bundles.select("bundle").distinct()
              .mapInArrow(frames, "bundle string, at long, packed long"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(root)
        unpack = zstandard.ZstdDecompressor()
        types = [{"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())]
        types = [types[0], pa.string(), pa.string(), types[0], pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            opened, f = None, None
            for name, at, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if name != opened:
                    if f:
                        f.close()
                    opened, f = name, place.open_input_file(f"{base}/{name}")
                f.seek(at)
                data, rows, here = unpack.decompress(f.read(packed)), [], 0
                while here < len(data):
                    headers, block, here = parse_record(data, here)
                    rows.append(_read(headers, block, kind, with_payload))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*rows), types)],
                    names=["page_id", "url", "record_type", "refers_to", "payload",
                           "payload_bytes", "payload_digest"])
            if f:
                f.close()

    # A frame is a small row and much work: keep as many tasks as the session has partitions.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (listed.repartition(tasks, "bundle", "at")
            .mapInArrow(records, RECORD.format(id=kind)))


def _read(headers: dict[str, str], block: bytes, kind: str, with_payload: bool) -> tuple:
    typed = (lambda v: None if v is None else int(v)) if kind in ("bigint", "int") else str
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    response = headers["WARC-Type"] == "response"
    if response and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
    refers = None if response else typed(_id_of(headers["WARC-Refers-To"]))
    return (typed(_id_of(headers["WARC-Record-ID"])), headers.get("WARC-Target-URI"),
            headers["WARC-Type"], refers, payload if with_payload and response else None, size,
            digest)


def read_record(root: str, bundle: str, frame_offset: int, frame_bytes: int,
                record_offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index row: only its frame is read."""
    place, base = fs.FileSystem.from_uri(root)
    with place.open_input_file(f"{base}/{bundle}") as f:
        f.seek(frame_offset)
        data = zstandard.ZstdDecompressor().decompress(f.read(frame_bytes))
    headers, block, _ = parse_record(data, record_offset)
    return headers, block

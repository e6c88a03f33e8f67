"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a
seek table (a skippable frame) that holds every frame's sizes, so readers
that know nothing of it still read the bundle as plain ``.warc.zst``.  An
index maps record ids to bundle, frame and offset within the frame, and one
record is read by one seek.  Tasks write bundles under names of their own;
only those of successful tasks are in the index, so a lost executor leaves
at most files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import HOT_KEYS, prepare, written
from kpiforge.session import scratch_path

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "file string, frame int, offset long, length long, frame_start long"


# --------------------------------------------------------------------------- records


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def encode_record(page: str | None, url: str | None, payload: bytes, revisit: bool, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if page is not None:
        head.append(f"Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record that begins at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    end = body + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return fields, data[body:end], end + 4


# --------------------------------------------------------------------------- bundles


class BundleWriter:
    """Writes records into frames and ends the bundle with its seek table."""

    def __init__(self, out: BinaryIO, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.table: list[tuple[int, int]] = []
        self.buffer, self.buffered, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int, int]:
        """Returns the record's frame, offset and length there, and the frame's start in the bundle."""
        if self.buffered and self.buffered + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.table), self.buffered, len(record), self.written)
        self.buffer.append(record)
        self.buffered += len(record)
        return place

    def flush(self) -> None:
        if self.buffer:
            frame = self.packer.compress(b"".join(self.buffer))
            self.out.write(frame)
            self.table.append((len(frame), self.buffered))
            self.written += len(frame)
            self.buffer, self.buffered = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEK_TABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """``(start, compressed size, size)`` of every frame, from the end of the bundle."""
    size = file.size()
    file.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_TABLE_MAGIC or flags:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * frames - 8)
    head = file.read(8 + 8 * frames)
    if struct.unpack_from("<II", head) != (SKIPPABLE_MAGIC, 8 * frames + 9):
        raise ValueError("the seek table is broken")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", head[8:]):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, start: int, packed: int, plain: int) -> bytes:
    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder's URI (file, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def fetch(uri: str, file: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: a seek table, one frame."""
    system, folder = open_folder(uri)
    with system.open_input_file(f"{folder}/{file}") as f:
        data = read_frame(f, *read_seek_table(f)[frame])
    fields, block, _ = decode_record(data[offset : offset + length])
    return fields, block


# ----------------------------------------------------------------------------- Spark


def _write(uri: str, frame_bytes: int, bundle_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_folder(uri)
        system.create_dir(folder, recursive=True)
        out = writer = name = None
        for b in batches:
            places = []
            rows = zip(*(b.column(i).to_pylist() for i in range(1, 5)), b.column(5).cast(pa.binary()).to_pylist())
            for page, url, revisit, refers_to, payload in rows:
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = BundleWriter(out, frame_bytes)
                places.append((name, *writer.add(encode_record(page, url, payload or b"", revisit, refers_to, date))))
                if writer.written >= bundle_bytes:
                    writer.close()
                    out.close()
                    writer = None
            cols = list(zip(*places)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["id", "file", "frame", "offset", "length", "frame_start"],
            )
        if writer is not None:
            writer.close()
            out.close()

    return run


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_folder(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_file(f"{folder}/{name}") as f:
                    for frame in read_seek_table(f):
                        data, at, rows = read_frame(f, *frame), 0, []
                        while at < len(data):
                            fields, block, at = decode_record(data, at)
                            http, _, payload = block.partition(b"\r\n\r\n")
                            size = int(http.rsplit(b"Content-Length: ", 1)[1])
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                                raise ValueError(f"broken payload in {name}")
                            rows.append((fields.get("Page-ID"), size, digest, fields["WARC-Type"], fields.get("Refers-To-Page-ID")))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                            names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                        )

    return run


def write_archives(
    pages: DataFrame,
    uri: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write a record per page into bundles under ``uri``; returns the index.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes the one
    with the largest id is a response and the others are revisits of it;
    smaller payloads are all responses.  Index: the id column, ``file``,
    ``frame``, ``offset`` and ``length`` (within the frame) and
    ``frame_start`` (in the bundle).

    Edge cases: a null page is an empty payload; a null url is empty; a null
    id sorts below all others (a group of such pages alone is all
    responses); rows that repeat the response's id and payload are responses
    too; other columns are not read; an empty table writes nothing.  A payload
    of any length fits (a frame of its own).  Payloads that hold at least
    1/HOT_KEYS of the rows are matched by broadcast, so copies of one page
    are spread over all tasks.
    """
    prepare(pages.sparkSession)
    data = F.coalesce(F.col(f"`{html_col}`").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), data.alias("data"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("data")))
    groups = rows.filter(F.octet_length("data") >= revisit_bytes).groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1"), "warc-copies")
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = (F.col("n") * HOT_KEYS >= total) & (F.col("n") > 1000)
    hot = groups.filter(is_hot).select(F.col("sha").alias("hot_sha"), F.col("keep").alias("hot_keep"))
    cold = groups.filter(~is_hot).select(F.col("sha").alias("cold_sha"), F.col("keep").alias("cold_keep"))
    first = rows.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left")
    # rows that are matched already get a key that matches nothing and spreads them
    apart = F.concat(F.lit(b"-"), F.col("sha"), F.xxhash64("id", "url").cast("string").cast("binary"))
    first = first.withColumn("key", F.when(F.col("hot_sha").isNull(), F.col("sha")).otherwise(apart))
    both = first.join(cold, F.col("key") == F.col("cold_sha"), "left")
    keep = F.coalesce("hot_keep", "cold_keep")
    revisit = F.coalesce(~F.col("id").eqNullSafe(keep) & keep.isNotNull(), F.lit(False))
    todo = both.select(
        "id", F.col("id").cast("string").alias("page"), "url", revisit.alias("revisit"), F.when(revisit, keep.cast("string")).alias("refers_to"), "data"
    )
    id_type = pages.schema[id_col].dataType.simpleString()
    index = written(todo.mapInArrow(_write(uri, frame_bytes, bundle_bytes, date), f"id {id_type}, {_INDEX}"), "warc-index")
    return index.withColumnRenamed("id", id_col)


def read_archives(index: DataFrame, uri: str, id_col: str = "page_id") -> DataFrame:
    """Read every bundle of an index, frame by frame, and check payload digests.

    Returns the id column, ``payload_bytes``, ``payload_digest`` (bare
    base32 SHA-1), ``record_type`` and ``refers_to``; for revisits both
    payload columns describe the payload they stand for.
    """
    id_type = index.schema[id_col].dataType.simpleString()
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by range: a hash of the file is how ``distinct`` deals them, and would be merged into few tasks
    files = index.select("file").distinct().repartitionByRange(parts, "file")
    found = files.mapInArrow(_read(uri), "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.select(
        F.col("id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to")
    )


def archive_folder(spark) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    prepare(spark)
    return scratch_path(spark, "warc")

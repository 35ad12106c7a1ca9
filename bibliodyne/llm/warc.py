"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``; each frame is a Zstandard frame of its own, so
it can be read alone. A bundle ends with a seek table in a skippable frame (sizes of all frames, a
footer with their number and the magic number), which ordinary decoders skip. An index table maps
each record to bundle, frame and the offset inside the decompressed frame: one record costs one seek
and one frame.

Of records with equal payloads the one with the smallest page_id is written as a response, the others
as revisits that refer to it. Every record carries a date, and every bundle starts with a warcinfo record. Tasks
write bundles through the file system of the shared folder (a scheme that pyarrow knows: file, hdfs, s3, gs,
abfs), under a name of their own attempt; only bundles in the committed index count, so a repeated,
failed or speculative task does no harm and nothing is renamed. A task holds one frame and one batch. A
revisit's payload length, which the format does not state, is an extension field.

A null html is an empty payload, a null url an empty target. Rows that repeat the smallest page_id of
a payload are all responses; a null page_id is the smallest only if no other is there. An
empty table gives an empty index and no bundle. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliodyne.llm.hot import join_class
from bibliodyne.session import materialize, shared_path

# The seekable format's magic numbers and record layout.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
INDEX = "page_id long, bundle string, frame int, frame_offset long, frame_bytes long, offset long, length long, record_type string"


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a table whose schema is written as "name type, ..."."""
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


@dataclass
class Archive:
    """Where bundles lie, and the index table over their records."""

    spark: SparkSession
    path: str

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_bytes(page_id: int | None, url: str | None, html: str | None, sha1_hex: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe='/:?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}",
        f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    block = HTTP if revisit else HTTP + payload
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def info_bytes(name: str, date: str) -> bytes:
    """The record that starts a bundle."""
    block = b"software: bibliodyne\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:bundle:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset after it."""
    data = bytes(data) if not isinstance(data, bytes) else data
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    start = stop + 4
    end = start + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at offset {at} has a wrong length")
    return head, data[start:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle, from (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f: pyarrow.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of a bundle's frames."""
    size = f.size()
    f.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(size - 9 - entry * count)
    body, out, at = f.read(entry * count), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", body, entry * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(f: pyarrow.NativeFile, offset: int, packed: int) -> bytes:
    f.seek(offset)
    return zstandard.ZstdDecompressor().decompress(f.read(packed))


class _Bundle:
    """One bundle being written, and the index rows of its records."""

    def __init__(self, path: str, name: str, date: str) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        self.name = name
        # By itself the stream would compress once more, as the name says.
        self.out = fs.open_output_stream(f"{root}/{name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=6, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        info = info_bytes(name, date)
        self.written, self.plain, self.pending, self.waiting = 0, len(info), [info], []

    def add(self, data: bytes, page_id: int | None, kind: str) -> list[tuple]:
        self.waiting.append((page_id, self.plain, len(data), kind))
        self.pending.append(data)
        self.plain += len(data)
        return self.flush() if self.plain >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if not self.pending:
            return []
        packed = self.packer.compress(b"".join(self.pending))
        self.out.write(packed)
        rows = [(i, self.name, len(self.sizes), self.written, len(packed), offset, length, kind) for i, offset, length, kind in self.waiting]
        self.sizes.append((len(packed), self.plain))
        self.written += len(packed)
        self.plain, self.pending, self.waiting = 0, [], []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        return rows


def write_archive(pages: DataFrame, path: str | None = None, bundle_bytes: int = BUNDLE_BYTES, date: str | None = None) -> Archive:
    """Write a record per row of ``pages`` (page_id, url, html) and the index of all records. ``date`` is that of
    the records, as 2024-01-31T12:00:00Z; by default the time of writing."""
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    path = path or shared_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("sha1"))
    firsts = materialize(named.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")), "warc-firsts")
    typed = join_class(named, firsts, "sha1", "page_id").withColumn("revisit", ~F.col("page_id").eqNullSafe(F.col("first_id")))
    read = ["page_id", "url", "html", "sha1", "first_id", "revisit"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ids stay Arrow integers throughout: pandas would make them doubles where one is null.
        task = TaskContext.get()
        bundle, count = None, 0
        for batch in batches:
            rows: list[tuple] = []
            for at in range(len(batch)):
                page_id, url, html, sha1, first_id, revisit = (batch.column(c)[at].as_py() for c in read)
                if bundle is None:
                    bundle = _Bundle(path, f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}.warc.zst", date)
                    count += 1
                rows += bundle.add(record_bytes(page_id, url, html, sha1, first_id, revisit, date), page_id, "revisit" if revisit else "response")
                if bundle.written >= bundle_bytes:
                    rows += bundle.close()
                    bundle = None
            yield _batch(rows, INDEX)
        if bundle is not None:
            yield _batch(bundle.close(), INDEX)

    typed.select(*read).mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return Archive(spark, path)


def _row(head: dict[str, str], block: bytes) -> tuple:
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    page_id, digest = number(head["WARC-Record-ID"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "revisit":
        return page_id, head["WARC-Target-URI"], int(head["WARC-Payload-Length"]), digest, "revisit", number(head["WARC-Refers-To"]), None
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(head["WARC-Payload-Length"]):
        raise ValueError(f"the payload of record {page_id} does not match its digest")
    return page_id, head["WARC-Target-URI"], len(payload), digest, "response", None, payload.decode("utf-8", "surrogatepass")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archive(archive: Archive, payloads: bool = True) -> DataFrame:
    """All records, read bundle by bundle through the seek tables; digests are verified."""
    path = archive.path

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    for offset, packed, plain in read_seek_table(f):
                        data, at, rows = read_frame(f, offset, packed), 0, []
                        if len(data) != plain:
                            raise ValueError(f"a frame of {name} has another size than its seek table says")
                        while at < len(data):
                            head, block, at = parse_record(data, at)
                            if head["WARC-Type"] == "warcinfo":
                                continue
                            row = _row(head, block)
                            rows.append(row if payloads else (*row[:-1], None))
                        yield _batch(rows, RECORD)

    bundles = archive.index.select("bundle").distinct()
    n = max(1, archive.spark.sparkContext.defaultParallelism)
    return bundles.repartition(4 * n, "bundle").mapInArrow(read, RECORD)


def fetch(archive: Archive, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (column page_id): index lookup, then one seek per frame that is needed."""
    path = archive.path
    asked = ids.select(F.col("page_id").alias("asked")).distinct()  # a null id asks for the records without one
    wanted = archive.index.join(asked, F.col("page_id").eqNullSafe(F.col("asked")), "left_semi")
    frames = wanted.groupBy("bundle", "frame_offset", "frame_bytes").agg(F.collect_list("offset").alias("offsets"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for frame in batch.to_pylist():
                with fs.open_input_file(f"{root}/{frame['bundle']}") as f:
                    data = read_frame(f, frame["frame_offset"], frame["frame_bytes"])
                yield _batch([_row(*parse_record(data, at)[:2]) for at in sorted(frame["offsets"])], RECORD)

    return frames.mapInArrow(read, RECORD)


def warc_table(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read back."""
    return read_archive(write_archive(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

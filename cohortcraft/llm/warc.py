"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle
ends with a seek table (a skippable frame that lists the compressed and plain
size of every frame), so any frame can be read alone.  The index maps a
record to its bundle, frame and offset inside the plain frame.

Equal payloads of at least MIN_REVISIT bytes are stored once: the record with
the largest page_id is the response and the others are revisit records
without payload.  Only digests are grouped, never payloads, and a revisit's
record has no payload.  The one shuffle of payloads, if any, is by page_id and
digest together, so a hot group of copies is spread like everything else.

Bundles are files in a folder that all executors share.  A task writes under
a temporary name and renames; names and contents depend on the partition
alone, so a task that is run again replaces its own files by the same ones.

Defined results: null html is the empty payload; null or clashing further
columns are ignored; rows with equal page_id and payload are all responses
if that page_id is the largest; a null page_id counts as the smallest; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, slices, small_batches

MIN_REVISIT = 1000
#: Plain bytes of a frame, at least (the last of a bundle may hold less).
FRAME_BYTES = 256 * 1024
#: Plain bytes after which a task begins a new bundle.
BUNDLE_BYTES = 64 * 1024 * 1024
LEVEL = 3
# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WARC_VERSION = b"WARC/1.1"

RECORDS = ("page_id long, bundle string, frame int, offset long, length long")
READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def record_kinds(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload_digest, payload_bytes, payload, record_type, refers_to).

    The payload of a revisit is null.
    """
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    full = full.select("*", F.sha1("payload").alias("payload_digest"),
                       F.octet_length("payload").cast("long").alias("payload_bytes"))
    large = F.col("payload_bytes") >= MIN_REVISIT
    # One row per payload that occurs with more than one page_id, then one per revisit.
    keys = full.filter(large).select("page_id", "payload_digest")
    shared = (keys.groupBy("payload_digest")
              .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"),
                   F.max(F.col("page_id").isNull()).alias("has_null"))
              .filter("refers_to is not null and (refers_to <> least or has_null)").drop("least", "has_null"))
    revisits = (keys.join(shared, "payload_digest").filter("page_id is null or page_id <> refers_to")
                .groupBy("page_id", "payload_digest").agg(F.max("refers_to").alias("refers_to")))
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), "refers_to")
    joined = full.join(r, (F.col("page_id").eqNullSafe(F.col("r_id"))) & (F.col("payload_digest") == F.col("r_digest"))
                       & large, "left")
    revisit = F.col("refers_to").isNotNull()
    return joined.select(
        "page_id", "url", "payload_digest", "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _one_line(value: str | None) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value or "")


def record_bytes(row: dict) -> bytes:
    """One WARC record; a revisit has an empty block."""
    payload = row["payload"] or b""
    head = [WARC_VERSION.decode(), f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}",
            f"WARC-Target-URI: {_one_line(row['url'])}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
            f"X-Payload-Length: {row['payload_bytes']}"]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(row['refers_to'])}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class BundleWriter:
    """Writes frames to an open file and the seek table at the end."""

    def __init__(self, sink):
        self.sink, self.frames, self.part, self.held = sink, [], [], 0
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the plain frame) of the record."""
        place = len(self.frames), self.held
        self.part.append(record)
        self.held += len(record)
        if self.held >= FRAME_BYTES:
            self.end_frame()
        return place

    def end_frame(self) -> None:
        if self.part:
            small = self.press.compress(b"".join(self.part))
            self.sink.write(small)
            self.frames.append((len(small), self.held))
            self.part, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame, from the footer alone."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for small, plain in struct.iter_unpack("<II", bundle[len(bundle) - 9 - 8 * n: len(bundle) - 9]):
        out.append((at, small, plain))
        at += small
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, small, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at: at + small], max_output_size=plain)


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """A single record, decompressing only its frame."""
    return read_frame(bundle, frame)[offset: offset + length]


def parse_records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        first, *lines = plain[at:end].decode().split("\r\n")
        if first != WARC_VERSION.decode():
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = int(head["Content-Length"])
        yield head, plain[end + 4: end + 4 + size]
        at = end + 8 + size


def _page_id(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def fs_bundles(spark, folder: str) -> None:
    """Make the folder of the bundles, so that reading an empty archive works."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bundles")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def write_bundles(pages: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the archive of ``pages`` into ``folder``; returns the index (written at once).

    Index rows: page_id, bundle (file name), frame, offset and length in the
    plain frame.  A task writes its rows in a fixed order, so that a second
    attempt makes the same files, and begins a new bundle after
    ``bundle_bytes`` of records.
    """
    spark = small_batches(pages).sparkSession
    records = record_kinds(pages).sortWithinPartitions("page_id", "payload_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(f"{folder if ':' in folder else f'file://{folder}'}/bundles")
        writer, name, temporary, number, size = None, "", "", 0, 0
        for batch in slices(batches):
            rows = []
            for row in batch.to_pylist():
                if writer is None:
                    name = f"bundle-{task.partitionId():06d}-{number:04d}.warc.zst"
                    temporary = posixpath.join(root, f"_{name}.{task.taskAttemptId()}")
                    writer, size = BundleWriter(store.open_output_stream(temporary)), 0
                    number += 1
                record = record_bytes(row)
                frame, offset = writer.add(record)
                rows.append((row["page_id"], name, frame, offset, len(record)))
                size += len(record)
                if size >= bundle_bytes:
                    writer.close()
                    store.move(temporary, posixpath.join(root, name))
                    writer = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                ["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()
            store.move(temporary, posixpath.join(root, name))

    index = f"{folder}/index"
    fs_bundles(spark, folder)
    records.mapInArrow(run, RECORDS).write.mode("overwrite").parquet(index)
    return spark.read.schema(RECORDS).parquet(index)


def read_bundles(spark, folder: str) -> DataFrame:
    """Every record of the archive, digests verified; one row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bundle = batch.column(0)[0].as_buffer()
            data = memoryview(bundle)
            for at, small, plain in seek_table(data):
                rows = []
                frame = zstandard.ZstdDecompressor().decompress(data[at: at + small], max_output_size=plain)
                for head, payload in parse_records(frame):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    rows.append((_page_id(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, kind,
                                 _page_id(head["WARC-Refers-To"]) if kind == "revisit" else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "bundle-*.warc.zst").load(f"{folder}/bundles")
    return files.select("content").mapInArrow(run, READ)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archive of ``pages`` and read it back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    write_bundles(pages, folder)
    return read_bundles(pages.sparkSession, folder)

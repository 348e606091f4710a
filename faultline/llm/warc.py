"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole records of about FRAME_BYTES, and a skippable frame
with the seek table at its end (sizes of every frame, number of frames, magic number), as the seekable format has it. The
index maps a record's identifier to its bundle, its frame and its offset inside the frame once decompressed. A record is
read by one frame; a bundle is read frame by frame.

Bundles go to a folder that all executors share, through the file system its address names. A task writes under a name of
its own and only a committed index row makes a bundle part of the archive, so repeated and lost tasks leave no trace in it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import stored
from faultline.session import new_shared_path

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
#: Payloads from this size on are stored once.
SHARED_BYTES = 1000
INDEX = "record_id long, bundle string, frame int, offset long, length long"


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def record(record_id, url: str | None, payload: bytes, refers_to=None, of: str = "urn:page:") -> bytes:
    """One record: response with its payload, or revisit without; header values lose line breaks."""
    name = lambda i: f"<{of}{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(record_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Bundle:
    """Writes frames and, at the end, the seek table; memory is one frame and the sizes."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.out = filesystem.open_output_stream(path, compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.buffer, self.size, self.sizes, self.total = [], 0, [], 0

    def add(self, raw: bytes) -> tuple[int, int]:
        at = (len(self.sizes), self.size)
        self.buffer.append(raw)
        self.size += len(raw)
        if self.size >= FRAME_BYTES:
            self.flush()
        return at

    def flush(self) -> None:
        if self.size:
            frame = self.pack.compress(b"".join(self.buffer))
            self.out.write(frame)
            self.sizes.append((len(frame), self.size))
            self.total += len(frame)
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Seekable:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.file = filesystem.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(end - 9 - 8 * n)
        self.sizes = list(struct.iter_unpack("<II", self.file.read(8 * n)))
        self.at = [0]
        for packed, _ in self.sizes:
            self.at.append(self.at[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.at[k])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])


def write_bundles(rows: DataFrame, root: str) -> DataFrame:
    """Write `rows` (record_id, url, payload, refers_to) below `root`; returns the stored index, one row per record.

    Every task writes bundles of up to BUNDLE_BYTES. A null payload is empty, null identifiers stay null. The index lists
    the bundles of committed tasks only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(root)
        filesystem.create_dir(base, recursive=True)
        bundle, name = None, None
        for b in batches:
            found = []
            for i in range(b.num_rows):
                key, url, payload, refers = (b.column(c)[i].as_py() for c in ("record_id", "url", "payload", "refers_to"))
                if bundle is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(filesystem, f"{base}/{name}")
                raw = record(key, url, payload or b"", refers)
                frame, offset = bundle.add(raw)
                found.append((key, name, frame, offset, len(raw)))
                if bundle.total >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if found:
                cols = list(zip(*found, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["record_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    cols = rows.select("record_id", "url", "payload", "refers_to")
    return stored(cols.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame, root: str, of: str = "<urn:page:") -> DataFrame:
    """Every record that `index` lists, read by frame and offset: record_id, payload, payload_digest, record_type, refers_to.

    Frames are the unit of work, so a large bundle is read by many tasks; index rows of a frame come together.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(root)
        number = lambda s: int(s[len(of) : -1]) if s and len(s) > len(of) + 1 else None
        name, handle, at, data = None, None, None, b""
        for b in batches:
            out, size = [], 0
            for bundle, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                if bundle != name:
                    name, handle, at = bundle, Seekable(filesystem, f"{base}/{bundle}"), None
                if frame != at:
                    at, data = frame, handle.frame(frame)
                head, body = parse(data[offset : offset + length])
                out.append((number(head["WARC-Record-ID"]), body, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number(head.get("WARC-Refers-To"))))
                size += len(body)
                if size >= FRAME_BYTES:
                    yield _read_batch(out)
                    out, size = [], 0
            if out:
                yield _read_batch(out)

    frames = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return frames.select("bundle", "frame", "offset", "length").mapInArrow(read, "record_id long, payload binary, payload_digest string, record_type string, refers_to long")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64())
    names = ["record_id", "payload", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(record_id, url, payload, refers_to) of `pages` (page_id, url, html): of equal payloads from SHARED_BYTES on, those
    without the largest page_id refer to it. Rows that share the largest page_id, or have none, keep their payload.

    Payloads meet by SHA-256 in an aggregate, so copies combine before the shuffle and no payload moves for it.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("_d", F.when(F.octet_length("payload") >= SHARED_BYTES, F.sha2("payload", 256)))
    last = p.where("_d is not null").groupBy("_d").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    refers = F.when(F.col("page_id") < F.col("_last"), F.col("_last"))
    return p.join(last, "_d", "left").select(F.col("page_id").alias("record_id"), "url", "payload", refers.alias("refers_to"))


def archive_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its bundles.

    A revisit's size is that of the record it refers to; without pages there are no bundles and no rows.
    """
    root = new_shared_path(pages.sparkSession, "bundles")
    index = write_bundles(with_revisits(pages), root)
    back = read_bundles(index, root).select("record_id", F.octet_length("payload").cast("long").alias("bytes"), "payload_digest", "record_type", "refers_to")
    back = stored(back, "warc-records")
    full = back.where("record_type = 'response'").groupBy("record_id", "payload_digest").agg(F.max("bytes").alias("_full"))
    full = full.select(F.col("record_id").alias("refers_to"), "payload_digest", "_full")
    return back.join(full, ["refers_to", "payload_digest"], "left").select(
        F.col("record_id").alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("_full")).otherwise(F.col("bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )

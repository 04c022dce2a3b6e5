"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with up to FRAME_BYTES of whole
WARC records, then a seek table in a skippable frame (the public seekable format), so one
record is read by decompressing one frame. The index maps each record to its bundle, the
offset and size of its frame, and its offset inside the frame.

Records with equal payloads of at least `least` bytes are written once, as the response of
the smallest id; the others are revisits that refer to it. Only digests and ids are
grouped; payloads are shuffled once, to meet that decision.

Tasks write a bundle under a name of its own (random, so attempts never meet) in the shared
folder, through Arrow's file systems; the index, committed by Spark, names the bundles
that count, so a task that runs again leaves nothing wrong behind.
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

from headmint.llm.common import shared_dir, stored

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 27  # of compressed data, after which a new bundle begins
SEEKABLE_MAGIC, SKIPPABLE_MAGIC = 0x8F92EAB1, 0x184D2A5E  # fixed values of the seekable format
INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame_offset", pa.int64()), ("frame_size", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])


def header_value(text: str | None) -> str:
    """A header's value on one line: control characters are percent-coded."""
    return "".join(c if c >= " " and c != "\x7f" and c != "%" else f"%{ord(c):02X}" for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {header_value(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record that data begins with."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    payload = data[end + 4 : end + 4 + size]
    if len(payload) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, payload


class Bundle:
    """Writes records to one bundle; positions are known when a frame closes."""

    def __init__(self, path: str, level: int):
        self.path, self.zstd = path, zstandard.ZstdCompressor(level=level)
        system, inner = fs.FileSystem.from_uri(path)
        self.out = system.open_output_stream(inner, compression=None)  # else the name .zst compresses it again
        self.frames: list[tuple[int, int]] = []
        self.at = 0
        self.held: list[bytes] = []
        self.names: list[int | None] = []
        self.size = 0  # of what is held
        self.done: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.held.append(data)
        self.names.append(page_id)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if not self.held:
            return
        plain = b"".join(self.held)
        frame = self.zstd.compress(plain)
        self.out.write(frame)
        offset = 0
        for name, data in zip(self.names, self.held, strict=True):
            self.done.append((name, self.path, self.at, len(frame), offset, len(data)))
            offset += len(data)
        self.frames.append((len(frame), len(plain)))
        self.at += len(frame)
        self.held, self.names, self.size = [], [], 0

    def close(self) -> None:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()

    def index(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), INDEX, strict=True)], schema=INDEX)


def seek_table(path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer alone."""
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        size = f.size()
        f.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        f.seek(size - 9 - 8 * n)
        sizes = struct.iter_unpack("<II", f.read(8 * n))
        out, at = [], 0
        for packed, plain in sizes:
            out.append((at, packed, plain))
            at += packed
        return out


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for b in batches:
            ids, urls, pages, digests, refs = (c.to_pylist() for c in b.columns)
            for page_id, url, html, digest, ref in zip(ids, urls, pages, digests, refs, strict=True):
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", level)
                bundle.add(page_id, record(page_id, url, html or b"", digest, ref))
                if bundle.at >= BUNDLE_BYTES:
                    bundle.close()
                    yield bundle.index()
                    bundle = None
            if bundle is not None and bundle.done:
                yield bundle.index()
        if bundle is not None:
            bundle.close()
            if bundle.done:
                yield bundle.index()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, level: int = 3) -> DataFrame:
    """Write a record for each row to bundles in folder/bundles; the index as a stored DataFrame.

    A null html has an empty payload. Rows with a null id are written; they are never
    referred to unless no row with an id has the payload, in which case each is a response.
    Of repeated rows (equal id and payload) each has a record; all but the smallest id's
    are revisits, and rows of that id are all responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.col(html_col), "UTF-8").alias("html"))
    p = p.withColumn("html", F.coalesce("html", F.lit(b"")))
    digest = F.sha2("html", 256)
    # what is equal to a payload of a smaller id: digests and ids only
    known = stored(p.filter(F.octet_length("html") >= least).select("page_id", digest.alias("digest")), f"{folder}/digests")
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    again = known.join(firsts, "digest").filter("first <> page_id or page_id is null and first is not null").select("page_id", "digest", "first").distinct()
    again = stored(again, f"{folder}/revisits")
    met = p.withColumn("digest", digest).join(again.withColumnRenamed("page_id", "of").withColumnRenamed("digest", "d"), F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("d")), "left")
    rows = met.select("page_id", "url", "html", "digest", "first").mapInArrow(_write(f"{folder}/bundles", level), "page_id bigint, bundle string, frame_offset bigint, frame_size bigint, offset bigint, size bigint")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/bundles")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return stored(rows, f"{folder}/index")


def read_record(bundle: str, frame_offset: int, frame_size: int, offset: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record, by the index: reads and decompresses its frame alone."""
    system, inner = fs.FileSystem.from_uri(bundle)
    with system.open_input_file(inner) as f:
        f.seek(frame_offset)
        plain = zstandard.ZstdDecompressor().decompress(f.read(frame_size))
    return parse(plain[offset : offset + size])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    opened: tuple[str, pa.NativeFile | None] = ("", None)
    frame: tuple[str, int, bytes] = ("", -1, b"")
    for b in batches:
        out = []
        for bundle, frame_offset, frame_size, offset, size in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            if frame[:2] != (bundle, frame_offset):
                if opened[0] != bundle:
                    if opened[1] is not None:
                        opened[1].close()
                    system, inner = fs.FileSystem.from_uri(bundle)
                    opened = (bundle, system.open_input_file(inner))
                opened[1].seek(frame_offset)
                frame = (bundle, frame_offset, unzip.decompress(opened[1].read(frame_size)))
            headers, payload = parse(frame[2][offset : offset + size])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            revisit = headers["WARC-Type"] == "revisit"
            if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
            name = lambda key: int(x) if (x := headers.get(key, "<urn:page:>")[10:-1]) else None
            out.append((name("WARC-Record-ID"), int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], name("WARC-Refers-To"), None if revisit else payload.decode()))
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.record_batch({"page_id": pa.array(cols[0], pa.int64()), "payload_bytes": pa.array(cols[1], pa.int64()), "payload_digest": pa.array(cols[2], pa.string()), "record_type": pa.array(cols[3], pa.string()), "refers_to": pa.array(cols[4], pa.int64()), "payload": pa.array(cols[5], pa.string())})


def read_archives(index: DataFrame) -> DataFrame:
    """Records by the index: page_id, payload_bytes, payload_digest, record_type, refers_to, payload
    (null for a revisit). Payloads are checked against their digests."""
    return index.select("page_id", "bundle", "frame_offset", "frame_size", "offset", "size").mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string")


def warc_round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write archives of pages to a shared folder and read every record back."""
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession), **names))

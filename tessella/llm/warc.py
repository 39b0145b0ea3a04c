"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records,
and a seek table in a skippable frame at the end (the public "seekable format": for every
frame its compressed and decompressed size, then the number of frames and a magic number).
Any Zstandard tool reads a bundle from front to back; a reader with the seek table fetches
one frame. The index maps record ids to (bundle, frame, offset in the frame, length).

`write` deals rows into bundles and returns the index. Of records with equal payloads
of at least `least_bytes` bytes, the one with the largest key is a response and the others are
revisits that refer to it. `read` reads whole bundles back into rows, `lookup` fetches chosen
records through the seek tables.

Files are written under fresh names and the index lists only files of tasks that Spark
committed, so repeated or lost tasks leave unused files but never wrong ones. File systems
are reached through pyarrow by the folder's URI.

Defined cases: a null payload is empty; repeated rows (same key, same payload) are separate
records of one id and of one type (all responses where their key is the largest); a null key is
written as urn:record:null and comes back as null, smaller than any other; where equal payloads
have null keys only, all are responses; a null URL is empty; an empty table writes no bundle;
other columns are ignored. Memory: one frame and one record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tidied

# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1_000_000, 64_000_000
INDEX = "key bigint, bundle string, frame int, offset bigint, length bigint"


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(key: int | None) -> str:
    return f"<urn:record:{'null' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a position, and where the next one begins."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(headers["content-length"])
    return headers, data[stop + 4 : stop + 4 + size], stop + 4 + size + 4


def _row(headers: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    told = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != said or digest(payload) != told):
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")

    def key(name: str) -> int | None:
        said = headers[name].strip("<>").rpartition(":")[2]
        return None if said == "null" else int(said)

    return {
        "key": key("warc-record-id"), "url": headers["warc-target-uri"], "record_type": kind, "payload_bytes": said, "payload_digest": told,
        "refers_to": key("warc-refers-to") if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


class BundleWriter:
    """Writes one seekable bundle."""

    def __init__(self, uri: str, level: int = 3):
        import zstandard

        self.uri, self.fs_path = uri, _files(uri)
        self.fs, path = self.fs_path
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.table, self.written = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        at = (len(self.table), self.size)
        self.held.append(data)
        self.size += len(data)
        self.written += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()
        return at

    def flush(self) -> None:
        if self.held:
            frame = self.compressor.compress(b"".join(self.held))
            self.out.write(frame)
            self.table.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(position, compressed size, size) of each frame of an open bundle."""
    f.seek(f.size() - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle as written here")
    f.seek(f.size() - 9 - 8 * n)
    body, out, at = f.read(8 * n), [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", body, 8 * i)
        out.append((at, packed, size))
        at += packed
    return out


def write(records: DataFrame, folder: str, key_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Archive rows under a folder of a shared store; gives the index (see INDEX)."""
    scratch = scratch or Scratch(records.sparkSession, "warc")
    payload = F.coalesce(F.encode(F.col(payload_column).cast("string"), "UTF-8"), F.lit(b""))
    rows = records.select(F.col(key_column).cast("long").alias("key"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    marked = rows.withColumn("same", F.when(F.length("payload") >= least_bytes, F.sha1("payload")))
    # Payloads that occur once need no partner, so only the repeated digests are joined. They
    # are a written table: a hot digest stands in it once, and the payload side can be split.
    repeated = marked.where("same is not null").select("key", "same").groupBy("same").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = scratch.put(repeated.select("same", "first"), "repeated")
    joined = marked.join(repeated, "same", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: BundleWriter | None = None
        told: list[list] = [[], [], [], [], []]

        def index() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(told, kinds, strict=True)], names=["key", "bundle", "frame", "offset", "length"])
            for x in told:
                x.clear()
            return out

        for b in batches:
            for key, url, payload, first in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if writer is None:
                    writer = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                data = record(key, url, payload, None if first is None or first == key else first)
                frame, offset = writer.add(data)
                for x, value in zip(told, (key, writer.uri, frame, offset, len(data)), strict=True):
                    x.append(value)
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
                    yield index()
        if writer is not None:
            writer.close()
            yield index()

    return scratch.put(joined.select("key", "url", "payload", "first").mapInArrow(tidied(run), INDEX), "index")


_ROWS = "key bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


#: Frames that a task reads back, about a MB each.
FRAMES = 16


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the index's bundles, frame by frame through the seek tables. A response's
    payload is checked against its digest."""
    spark = index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        last, table = None, []
        for b in batches:
            for uri, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = _files(uri)
                with fs.open_input_file(path) as f:
                    if last != uri:
                        last, table = uri, seek_table(f)
                    at, packed, size = table[frame]
                    f.seek(at)
                    data, rows, place = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size), [], 0
                while place < len(data):
                    headers, block, place = parse(data, place)
                    rows.append(_row(headers, block))
                    if not payloads:
                        rows[-1]["payload"] = None
                yield _arrow(rows)

    frames = index.groupBy("bundle").agg(F.max("frame").alias("last")).select("bundle", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame"))
    n = index.select("bundle", "frame").distinct().count()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // FRAMES))
    # Dealt without a key, so that the number of tasks holds.
    return frames.repartition(tasks).sortWithinPartitions("bundle", "frame").mapInArrow(tidied(run), _ROWS)


def lookup(index: DataFrame, keys: DataFrame, key_column: str = "key") -> DataFrame:
    """The records with the given keys: only their frames are read."""
    wanted = index.join(keys.select(F.col(key_column).cast("long").alias("key")).distinct(), "key").select("bundle", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        last, data = None, b""
        for b in batches:
            rows = []
            for uri, frame, offset in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if last != (uri, frame):
                    fs, path = _files(uri)
                    with fs.open_input_file(path) as f:
                        at, packed, size = seek_table(f)[frame]
                        f.seek(at)
                        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
                    last = (uri, frame)
                headers, block, _ = parse(data, offset)
                rows.append(_row(headers, block))
            yield _arrow(rows)

    return wanted.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(tidied(run), _ROWS)


def folder_for(spark: SparkSession, scratch: Scratch) -> str:
    """A folder for bundles in the shared folder, as a URI."""
    root = f"{scratch.root}/bundles"
    return root if "://" in root or root.startswith("file:") else f"file://{root}"

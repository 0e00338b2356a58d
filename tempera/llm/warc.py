"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; each bundle ends with a seek table (a skippable frame:
compressed and plain size of every frame, then a footer), and an index maps a record's id to its
bundle, frame and offset inside the frame. Tasks write their bundles straight into a folder that all
executors share, under a name of their attempt; the index names only files of attempts that
succeeded, so a lost executor costs a rewrite and leaves at most an unreferenced file.

Records follow WARC/1.1: a response's block is an HTTP message around the payload, a revisit has the
profile of identical payload digests and no block. The pages have no capture time, so ``captured``
stands in every record. Where payloads are equal is found on digests; the few that recur are broadcast
if their counted size permits, so payloads don't shuffle.

Defined cases: a null html is an empty payload; a null or empty url becomes urn:page: and the id; equal
payloads below ``min_payload`` bytes are stored each time; of equal larger ones the row with the largest
page_id is the response (repeated rows with that same id too, a null id never refers or is referred to)
and the others revisit it; rows equal in id, url and payload are one record id written twice; an empty
table writes no bundle and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import joined, mapped, n_partitions, scratch_path, written

FRAME_BYTES = 1 << 20  # of plain records in a frame, before the one that passes it
BUNDLE_BYTES = 256 << 20  # of compressed frames in a bundle
CAPTURED = "1970-01-01T00:00:00Z"
#: Fixed values of WARC/1.1 and of the seekable format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SKIPPABLE, _FOOTER = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame long, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def plan_records(pages: DataFrame, min_payload: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to, refers_to_url``: which rows revisit which
    response. Only digests that occur twice are joined back, after a map-side combine."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("n", F.length("payload"))
    large = rows.where((F.col("n") >= min_payload) & F.col("page_id").isNotNull())
    shared = large.groupBy("payload_digest", "n").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = joined(rows, written(shared, "warc-shared"), ["payload_digest", "n"], "left", 200)
    revisit = F.col("first.page_id") != F.col("page_id")
    return rows.select("page_id", "url", "payload", "payload_digest", F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_url"))


def _uri(page_id, url) -> str:
    return urllib.parse.quote(url, safe=string.punctuation) if url else f"urn:page:{page_id}"


def _record_id(page_id, url, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to, refers_to_url, captured: str = CAPTURED) -> bytes:
    """One WARC/1.1 record. A revisit keeps the digest and length of the payload, not its bytes."""
    head = [
        "WARC/1.1",
        f"WARC-Record-ID: {_record_id(page_id, url, digest)}",
        f"WARC-Date: {captured}",
        f"WARC-Target-URI: {_uri(page_id, url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        head += ["WARC-Type: response", "Content-Type: application/http; msgtype=response"]
    else:
        block = b""
        head += [
            "WARC-Type: revisit",
            f"WARC-Profile: {_PROFILE}",
            f"WARC-Refers-To: {_record_id(refers_to, refers_to_url, digest)}",
            f"WARC-Refers-To-Target-URI: {_uri(refers_to, refers_to_url)}",
            f"WARC-Refers-To-Date: {captured}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, offset: int = 0) -> tuple[dict, int]:
    """The record at ``offset`` and where the next one starts."""
    end = data.index(b"\r\n\r\n", offset)
    lines = data[offset:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {offset}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, n = end + 4, int(head["Content-Length"])
    page = lambda k: int(x) if (x := head.get(k, "")) else None
    revisit = head["WARC-Type"] == "revisit"
    payload = b"" if revisit else data[data.index(b"\r\n\r\n", start) + 4 : start + n]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return {
        "page_id": page("X-Page-ID"),
        "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": head["WARC-Type"],
        "refers_to": page("X-Refers-To-Page-ID"),
        "payload": payload,
    }, start + n + 4


class _Bundle:
    """A bundle while it is being written; one frame of plain records is in memory at a time."""

    def __init__(self, folder: str, stem: str):
        self.name = f"{stem}-{uuid.uuid4().hex[:8]}.warc.zst"
        store, path = pafs.FileSystem.from_uri(folder)
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)  # else by the name
        self.zstd, self.frames, self.written = zstandard.ZstdCompressor(level=3, write_checksum=True), [], 0
        self.plain, self.size, self.ids = [], 0, []

    def add(self, page_id, record: bytes) -> list[tuple]:
        self.ids.append((page_id, self.name, len(self.frames), self.size, len(record)))
        self.plain.append(record)
        self.size += len(record)
        return self.flush() if self.size >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if not self.plain:
            return []
        frame = self.zstd.compress(b"".join(self.plain))
        self.out.write(frame)
        self.frames.append((len(frame), self.size))
        self.written += len(frame)
        ids, self.plain, self.size, self.ids = self.ids, [], 0, []
        return ids

    def close(self) -> list[tuple]:
        ids = self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _FOOTER)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        return ids


def write_bundles(records: DataFrame, folder: str, captured: str = CAPTURED) -> DataFrame:
    """Write the planned records below ``folder`` (a uri that executors share); returns the index."""
    spark = records.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)

    fields = ["page_id", "url", "payload", "payload_digest", "refers_to", "refers_to_url"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, bundle = TaskContext.get(), None
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        names = [x.split()[0] for x in INDEX.split(", ")]
        batch_of = lambda ids: pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 1 else pa.int64()) for i, x in enumerate(zip(*ids, strict=True))], names)
        for batch in batches:
            for row in zip(*[batch.column(c) for c in fields], strict=True):
                row = [x.as_py() for x in row]
                bundle = bundle or _Bundle(folder, stem)
                if ids := bundle.add(row[0], _record(*row, captured)):
                    yield batch_of(ids)
                if bundle.written >= BUNDLE_BYTES:
                    if ids := bundle.close():
                        yield batch_of(ids)
                    bundle = None
        if bundle and (ids := bundle.close()):
            yield batch_of(ids)

    return written(mapped(records.select(*fields), write, INDEX), "warc-index")


def seek_table(store: pafs.FileSystem, path: str) -> list[tuple[int, int, int]]:
    """From the end of a bundle: where each frame starts, its compressed and its plain size."""
    with store.open_input_file(path) as f:
        end = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
        if magic != _FOOTER:
            raise ValueError(f"no seek table in {path}")
        entries, at, out = f.read_at(8 * n, end - 9 - 8 * n), 0, []
    for packed, plain in struct.iter_unpack("<II", entries):
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(folder: str, bundle: str, frame: int, offset: int) -> dict:
    """Random access to one record by its place in the index: one frame is read and decompressed."""
    store, path = pafs.FileSystem.from_uri(folder)
    start, packed, plain = seek_table(store, f"{path}/{bundle}")[frame]
    with store.open_input_file(f"{path}/{bundle}") as f:
        return parse_record(zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=plain), offset)[0]


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records that the index names. Frames are dealt out evenly, whatever their bundle."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                table = seek_table(store, f"{path}/{name}")
                yield pa.RecordBatch.from_pylist([{"bundle": name, "start": s, "packed": p, "plain": n} for s, p, n in table])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema, unzip = pa.schema(list(types.items())), zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.to_pylist():
                with store.open_input_file(f"{path}/{x['bundle']}") as f:
                    data = unzip.decompress(f.read_at(x["packed"], x["start"]), max_output_size=x["plain"])
                found, at = [], 0
                while at < len(data):
                    record, at = parse_record(data, at)
                    found.append(record if payloads else record | {"payload": None})
                yield pa.RecordBatch.from_pylist(found, schema)

    n = n_partitions(index.sparkSession)
    places = mapped(index.select("bundle").distinct(), frames, "bundle string, start long, packed long, plain long")
    return mapped(places.repartition(n), records, RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, min_payload: int = 1000, captured: str = CAPTURED) -> tuple[str, DataFrame]:
    """Write all pages; returns the folder of the bundles and the index table."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return folder, write_bundles(plan_records(pages, min_payload), folder, captured)

"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of several WARC/1.1 records, and a footer: a
skippable frame with the seek table of the Zstandard seekable format (compressed and decompressed
size of each frame). Any Zstandard reader takes a bundle as one stream; with the seek table and the
record's frame and offset, `read_record` decompresses a single frame.

Among pages of equal payload of at least DEDUP_BYTES, the one with the smallest page_id is stored as
a response, and the others as revisits that refer to it and hold headers only.

Each task writes bundles under names of their own and an index row for each record: bundle, frame,
offset in the decompressed frame, length. The index is a Parquet table beside the bundles (a folder below
INDEX_FOLDER for each call of `write`), so that an archive is found again, and added to, by its folder
alone. Only bundles in the index count, so that a task that ran twice does no harm.

Defined results: a payload of any length is one record; a null html is an empty payload; a null url is an empty target; pages with a null
page_id are records too (smallest only among themselves); of repeated rows that share the smallest
page_id, each is a response; an empty table writes nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import new_folder, open_store, table

DEDUP_BYTES = 100
#: A frame is closed at the first record end after so many bytes, a bundle after so many frames.
FRAME_BYTES = 256 << 10
BUNDLE_FRAMES = 512
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX_FOLDER = "index"
INDEX = "page_id long, bundle string, frame int, offset int, length int"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    """The page_id in a record id."""
    number = record[len("<urn:page:") : -1] if record else ""
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit keeps the digest and size of the payload that it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(response_id)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (names in lower case), HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    inner = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return {"version": lines[0], "headers": headers, "http": inner, "payload": payload}


class BundleWriter:
    def __init__(self, store: fs.FileSystem, path: str, frame_bytes: int = FRAME_BYTES):
        self.path, self.out, self.frame_bytes = path, store.open_output_stream(path, compression=None), frame_bytes
        self.pending: list[bytes] = []
        self.held = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and length of the record."""
        place = len(self.frames), self.held, len(data)
        self.pending.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.pending:
            frame = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(self.pending))
            self.out.write(frame)
            self.frames.append((len(frame), self.held))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        self.file.seek(size - 9 - n * width)
        table_ = self.file.read(n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table_, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> dict:
    """One record, by its index row."""
    store, _ = open_store(folder)
    return parse(BundleReader(store, bundle).frame(frame)[offset : offset + length])


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, response_id (null for pages that are responses themselves) and revisit."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    counts = hashed.where(F.octet_length("payload") >= DEDUP_BYTES).select("page_id", "digest").groupBy("digest")
    counts = counts.agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").withColumnRenamed("digest", "_digest")
    # most digests occur once: the other side is small, and Spark splits the rows of a digest of very many pages
    met = hashed.join(counts, hashed["digest"] == counts["_digest"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("response_id"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_frames: int = BUNDLE_FRAMES) -> DataFrame:
    """Writes bundles and the index of their records under `folder`, beside what it holds; the index of these pages as it was stored."""

    def bundles(batches):
        store, root = open_store(folder)
        writer, rows = None, []

        def indexed():
            writer.close()
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            names = ["page_id", "bundle", "frame", "offset", "length"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if writer is None:
                    writer = BundleWriter(store, f"{root}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                rows.append((row[0], writer.path, *writer.add(record(*row))))
                if len(writer.frames) >= bundle_frames:
                    yield indexed()
                    writer, rows = None, []
        if writer is not None:
            yield indexed()

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    batch = f"{folder}/{INDEX_FOLDER}/{uuid.uuid4().hex}"
    plan(pages).mapInArrow(bundles, INDEX).write.parquet(batch)
    return pages.sparkSession.read.schema(INDEX).parquet(batch)


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The whole stored index of the archive in `folder`: page_id, bundle, frame, offset, length."""
    return spark.read.schema(INDEX).option("recursiveFileLookup", True).parquet(f"{folder}/{INDEX_FOLDER}")


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the index's records, from the bundles."""
    tasks = max(8, 2 * index.sparkSession.sparkContext.defaultParallelism)

    def records(batches):
        store, _ = open_store(folder)
        bundle, reader, number, data = None, None, None, b""
        for batch in batches:
            rows = []
            for path, frame, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if path != bundle:
                    bundle, reader, number = path, BundleReader(store, path), None
                if frame != number:
                    number, data = frame, reader.frame(frame)
                r = parse(data[offset : offset + length])
                h, revisit = r["headers"], r["headers"]["warc-type"] == "revisit"
                digest = h["warc-payload-digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(r["payload"]).hexdigest() != digest:
                    raise ValueError(f"the payload of {h['warc-record-id']} does not match its digest")
                size = int(r["http"]["content-length"]) if revisit else len(r["payload"])
                rows.append((page_of(h["warc-record-id"]), size, digest, h["warc-type"], page_of(h.get("warc-refers-to"))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    placed = index.select("bundle", "frame", "offset", "length").repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return placed.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    return read(write(table(spark, sf_dir, "pages"), folder), folder)


#: The same rows from the pages alone.
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h LEFT JOIN f ON payload_digest = d
"""

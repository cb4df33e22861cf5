"""WARC archives as seekable Zstandard bundles, written and read by Spark tasks.

1. Digests and lengths of payloads are columns; the response of each group of equal payloads is a maximum per digest,
   combined before the shuffle. Short rows (id, digest) learn their response by a join; payloads move once, by id, so
   that a payload a third of all pages share is spread evenly.
2. Every task writes one bundle: records are grouped into independent Zstandard frames of about ``FRAME_BYTES``, and a
   skippable frame at the end holds the seek table (format version 0.1: sizes per frame, frame count, magic number).
   It returns an index row per record: bundle, frame, offset inside the frame, length. Only files of successful
   attempts are in the index, so a repeated task leaves nothing behind that is read.
3. Reading goes by frame: a task takes the seek table from the end of the file, reads its frames alone and parses the
   records. ``fetch`` reads single records by id.

Bundles go to the shared folder (any file system that pyarrow opens by URI). A frame must stay below 4 GB.

Defined results: null html is an empty payload; a null url has no target header; control characters and spaces in
urls are percent-encoded; a null page id ranks below all others and is read back as null; repeated rows of one page
id are records of their own, and those that hold the response's id are all responses; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.llm.common import read, stage
from levelwise.sources.staging import staging_path

FRAME_BYTES = 1 << 20
# Bytes of records that a task reads back.
READ_BYTES = 16 << 20
MIN_BYTES = 1000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
NO_ID = -(2**63)
# Fixed values of the seekable Zstandard format and of the WARC standard.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, hence the payload's length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{_name(page_id)}>"),
        ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{b32encode(sha1).decode()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else len(payload)))),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{_name(refers_to)}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return b"".join((head.encode(), http, b"" if revisit else payload, b"\r\n\r\n"))


def _name(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _number(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers and block of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start, length = end + 4, int(headers["Content-Length"])
    return headers, data[start : start + length], start + length + 4


def described(headers: dict, block: bytes) -> tuple:
    """A row of ``RECORD``; the digest of a response is computed from its payload and must agree with its header."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = headers["WARC-Type"] == "revisit"
    length = int(http.rpartition(b"Content-Length: ")[2])
    if not revisit and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    refers = _number(headers["WARC-Refers-To"]) if revisit else None
    return (_number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], length, digest.hex(), refers)


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def read_seek_table(source) -> list[tuple[int, int]]:
    """Start and compressed size of every frame of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * width)
    table, start, frames = source.read(n * width), 0, []
    for i in range(n):
        packed = struct.unpack_from("<I", table, i * width)[0]
        frames.append((start, packed))
        start += packed
    return frames


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class BundleWriter:
    """Collects records into frames; keeps one frame in memory."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        import zstandard

        store, root = open_store(folder)
        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.name, self.out = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}", compression=None)
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frame_bytes, self.held, self.size, self.sizes = frame_bytes, [], 0, []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and length of the record."""
        if self.held and self.size + len(data) > self.frame_bytes:
            self.flush()
        place = (len(self.sizes), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``_pid, digest, response``: the page that holds each payload, the page itself where there is nothing to share."""
    payload = F.coalesce("html", F.lit(""))
    short = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("_pid"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    # Only groups of two pages or more: the table to join stays small.
    shared = (
        short.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
        .agg(F.max("_pid").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    decided = short.join(shared, ["digest", "bytes"], "left")
    return decided.select("_pid", "digest", F.coalesce("response", "_pid").alias("response")).distinct()


def write_bundles(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES,
                  level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write every row of ``pages`` as a record and return the staged index."""
    folder = folder or staging_path(pages.sparkSession, "warc")
    store, root = open_store(folder)
    store.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bundle = bundle or BundleWriter(folder, frame_bytes, level)
            places = []
            for pid, url, html, digest, response in zip(*(batch.column(c) for c in ("_pid", "url", "html", "digest", "response"))):
                own, other = pid.as_py(), response.as_py()
                text = html.as_py()
                data = record(_page(own), url.as_py(), text or b"", bytes.fromhex(digest.as_py()), _page(other), own != other, date)
                places.append((_page(own), bundle.name, *bundle.add(data)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*places), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                  names=["page_id", "bundle", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("_pid"), F.sha1(payload).alias("digest"), "url", F.encode(payload, "UTF-8").alias("html"))
    joined = keyed.join(decide(pages, min_bytes), ["_pid", "digest"]).select("_pid", "url", "html", "digest", "response")
    return stage(joined.mapInArrow(write, INDEX), "warc-index")


def _page(pid: int) -> int | None:
    return None if pid == NO_ID else pid


def frames_of(rows: Iterable[tuple[str, int]]) -> Iterator[tuple[str, int, bytes]]:
    """Decompressed frames, one open bundle at a time."""
    import zstandard

    decompress, name, source, frames = zstandard.ZstdDecompressor().decompress, None, None, []
    for bundle, frame in rows:
        if bundle != name:
            store, path = open_store(bundle)
            name, source = bundle, store.open_input_file(path)
            frames = read_seek_table(source)
        start, size = frames[frame]
        source.seek(start)
        yield bundle, frame, decompress(source.read(size))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)],
                           names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])


def read_tasks(index: DataFrame) -> int:
    """Tasks in proportion to the records' bytes. Index rows are tiny, so Spark's own sizing would put all in one task."""
    total = index.agg(F.sum("length")).first()[0] or 0
    return max(1, math.ceil(total / READ_BYTES))


def scan(index: DataFrame) -> DataFrame:
    """Every record of the indexed bundles, read frame by frame."""

    def parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = zip(batch.column("bundle").to_pylist(), batch.column("frame").to_pylist())
            for _, _, data in frames_of(wanted):
                rows, at = [], 0
                while at < len(data):
                    headers, block, at = parse(data, at)
                    rows.append(described(headers, block))
                yield _records(rows)

    frames = index.select("bundle", "frame").distinct().repartition(read_tasks(index), "bundle", "frame")
    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(parse_all, RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """The records of the given index rows alone: one frame is decompressed for each run of rows in it."""

    def parse_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, data = None, b""
        for batch in batches:
            rows = []
            for bundle, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset"))):
                if place != (bundle, frame):
                    place = (bundle, frame)
                    data = next(frames_of([place]))[2]
                headers, block, _ = parse(data, offset)
                rows.append(described(headers, block))
            yield _records(rows)

    places = index.select("bundle", "frame", "offset").repartition(read_tasks(index), "bundle", "frame")
    return places.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(parse_some, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return scan(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
best AS (SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN b.response <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b.response <> p.page_id THEN b.response END AS refers_to
FROM p LEFT JOIN best b ON p.payload_digest = b.payload_digest AND p.payload_bytes >= 1000
"""

"""WARC records in seekable Zstandard bundles.

A bundle holds WARC 1.1 records in independent Zstandard frames and ends with the
public seekable format's seek table (a skippable frame), so that a reader can find
any frame from the end of the file. The index maps record identifiers to frame
number and offset inside the decompressed frame. Equal payloads are written once:
the page with the smallest id is the ``response``, the others are ``revisit``
records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Store, pieces, session, text_or_empty

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, bundle string, frame int, at int, length int"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _fs(uri: str):
    """A worker's way to the shared store. Hadoop's names of object stores are put in Arrow's words."""
    scheme, sign, rest = uri.partition("://")
    if not sign:
        raise ValueError(f"not a full address of the shared store: {uri}")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sign + rest)


class BundleWriter:
    """Appends records to frames of about ``frame_bytes``; ``close`` writes the seek table."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        self.out, self.most, self.z = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.now = bytearray()

    def add(self, record: bytes) -> tuple[int, int]:
        if self.now and len(self.now) + len(record) > self.most:
            self._flush()
        place = len(self.frames), len(self.now)
        self.now += record
        return place

    def _flush(self) -> None:
        if self.now:
            packed = self.z.compress(bytes(self.now))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.now)))
            self.now = bytearray()

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, source, size: int):
        self.source, self.z = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 128 else 8
        source.seek(size - 9 - n * entry)
        table, self.frames, at = source.read(n * entry), [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.source.seek(at)
        return self.z.decompress(self.source.read(packed), max_output_size=plain)

    def record(self, k: int, at: int, length: int) -> bytes:
        return self.frame(k)[at : at + length]


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def make_record(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """One WARC record. ``first``: the page that holds this payload, if that is another."""
    revisit = first is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page-Id", str(first))]
    body = b"" if revisit else payload
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes):
    """(offset, headers, body) of each record in a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def with_first(pages: DataFrame, store: Store, least_bytes: int = 0) -> DataFrame:
    """Adds ``first``: the smallest page_id with the same payload if the row isn't that one, else null.

    Payloads shorter than ``least_bytes`` are never revisits. Only the payloads that
    occur more than once are joined back, so rows of a frequent payload stay spread
    out (the join can be split) and unique payloads need no partner.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    firsts = rows.where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    firsts = store.put(firsts, "payloads")
    return rows.join(firsts, "key", "left").withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))).drop("key")


def write_archive(pages: DataFrame, store: Store, least_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 256 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes bundles to the shared store; returns the index (record_id, bundle, frame, at, length).

    Each task streams its rows to bundles of at most about ``bundle_bytes`` of input
    under a name of its attempt and renames them when whole, so that a repeated task
    leaves no half bundle in the index.
    """
    folder = store.path("bundles")

    def write(batches):
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        now, name, held, index = None, "", 0, []

        def close():
            now.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pylist(index, schema=pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int32()), ("length", pa.int32())]))

        for b in pieces(batches):
            for r in b.to_pylist():
                if now is None:
                    name, held, index = f"{uuid.uuid4().hex}.warc.zst", 0, []
                    now = BundleWriter(fs.open_output_stream(f"{root}/{name}.part"), frame_bytes)
                payload = r["html"].encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                made = make_record(r["page_id"], r["url"], payload, digest, r["first"], date)
                frame, at = now.add(made)
                index.append({"record_id": record_id(r["page_id"]), "bundle": f"{folder}/{name}", "frame": frame, "at": at, "length": len(made)})
                held += len(made)
                if held >= bundle_bytes or len(index) >= 100_000:
                    yield close()
                    now = None
        if now is not None:
            yield close()

    return store.put(with_first(pages, store, least_bytes).mapInArrow(write, INDEX), "index")


def read_archive(index: DataFrame, payloads: bool = True, task_bytes: int = 16 << 20, run: int = 32) -> DataFrame:
    """Reads every record of the indexed bundles again, by runs of frames, and checks it.

    A response's payload must have the stated digest and length, and every record
    must begin where the index says. Runs of ``run`` frames of a bundle are dealt to as
    many tasks as the archive has ``task_bytes``.
    """
    size = index.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    frames = index.groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"), F.max("at").alias("most"))

    def read(batches):
        path, reader = None, None
        for b in batches:
            for f in b.to_pylist():
                if f["bundle"] != path:
                    path = f["bundle"]
                    fs, p = _fs(path)
                    reader = BundleReader(fs.open_input_file(p), fs.get_file_info(p).size)
                rows = []
                for at, head, body in parse_records(reader.frame(f["frame"])):
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    kind, to = head["WARC-Type"], head.get("X-Refers-To-Page-Id")
                    if kind == "response" and (len(body) != n or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']} in {path}")
                    page = head.get("X-Page-Id")
                    rows.append((None if page is None else int(page), head.get("WARC-Target-URI"), n, digest, kind, None if to is None else int(to), body if payloads else None, at))
                if len(rows) != f["n"] or rows[0][-1] != f["least"] or rows[-1][-1] != f["most"]:
                    raise ValueError(f"index and bundle differ: {path}, frame {f['frame']}")
                cols = list(zip(*rows, strict=True))[:-1]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    dealt = frames.repartition(max(1, -(-size // task_bytes)), "bundle", F.floor(F.col("frame") / run))
    return dealt.sortWithinPartitions("bundle", "frame").mapInArrow(read, READ)


def fetch(index: DataFrame, page_id) -> bytes:
    """One record by its page id: one index row, one frame."""
    row = index.where(F.col("record_id") == record_id(page_id)).first()
    if row is None:
        raise KeyError(page_id)
    fs, p = _fs(row.bundle)
    return BundleReader(fs.open_input_file(p), fs.get_file_info(p).size).record(row.frame, row["at"], row.length)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: size and digest of its payload, response or revisit, and what it refers to.

    Null html is an empty payload; null ids and urls are left out of the record; rows
    repeated under the smallest id of their payload are each a response; extra columns
    are ignored. Very large pages are records of their own, whole. An empty table gives no rows.
    """
    store = Store(session(spark))
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), store, least_bytes=0)
    return read_archive(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to
FROM p
"""

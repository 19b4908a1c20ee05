"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts every text where the last 32 bytes say so, so that passages that
documents share give equal chunks wherever they stand. Tasks send each distinct chunk of
theirs to the bucket of its digest, where it is encoded once and its ids go back to every
task that asked. A chunk's ids are then right but for its ends, which may be cut inside a
word: a bucket splits off a chunk's head and tail at white space, wider and wider until
their own ids are exactly what the chunk's ids begin and end with, and the documents'
tasks encode each tail with the head that follows it.

Neither texts nor ids of whole documents are shuffled: distinct chunks travel once a task,
compressed, and their ids come back.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pieces, release, session
from .packing import Ids, tokenizer_path

ROW = "g int, bucket int, src bigint, kind int, a binary, b binary, c binary"
ENCODED = "doc_id bigint, ids array<int>, decoded string"
SEED = 0x9E3779B9
SPACES = (9, 10, 11, 12, 13, 32)


@cache
def worker_ids(path: str) -> Ids:
    """One per Python worker. Chunks are few and come once, so that it needs to remember few words."""
    return Ids(path, 250_000)


@cache
def gear() -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(SEED).integers(0, 2**32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte, a hash of the 32 bytes that end there (sum of shifted gear values), by doubling."""
    h = gear()[data]
    for n in (1, 2, 4, 8, 16):
        h[n:] += h[:-n] << np.uint32(n)  # the right side is computed before it is added
    return h


def starts_of_characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions moved forward to the next beginning of a character."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    for _ in range(3):
        at = at + ((padded[at] & 0xC0) == 0x80)
    return at


def cuts(data: np.ndarray, ends: np.ndarray, mean: int, least: int, most: int) -> list[list[int]]:
    """Cut positions inside each of the texts that lie one after another in ``data``; ``ends`` are their bounds."""
    marks = np.flatnonzero(rolling(data) < np.uint32(2**32 // mean)) + 1 if len(data) else np.zeros(0, np.int64)
    marks = starts_of_characters(data, marks)
    bounds, every, out = np.searchsorted(marks, ends).tolist(), marks.tolist(), []
    edges = ends.tolist()
    for i, (at, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        own, j, last = [], bounds[i], bounds[i + 1]
        while hi - at > least:
            j = bisect_left(every, at + least, j, last)
            to = every[j] if j < last else hi
            if to - at > most:
                to = int(starts_of_characters(data[: at + most + 4], np.array([at + most]))[0])
            if to >= hi:
                break
            own.append(to)
            at = to
        out.append(own)
    return out


def column(texts: list[bytes]) -> pa.Array:
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(b"".join(texts))).cast(pa.string()) if at[-1] < 2**31 else pa.array([t.decode() for t in texts], pa.large_string())


def split(text: bytes, ids: bytes, encode) -> tuple[int, int]:
    """(bytes of the head, bytes of the tail) at white space, so that their own ids begin and end ``ids``; (whole, 0) if none do."""
    spaces = [i for i, c in enumerate(text) if c in SPACES]
    head = next((p for p in spaces if ids.startswith(encode(text[:p]))), None)
    if head is None:
        return len(text), 0
    n = len(encode(text[:head]))
    tail = next((p for p in reversed(spaces) if p >= head and ids.endswith(e := encode(text[p:])) and n + len(e) <= len(ids)), None)
    return (len(text), 0) if tail is None else (head, len(text) - tail)


class Encoder:
    """What a bucket knows about chunks: digest -> (ids, ids of the head, ids of the tail, head, tail). A chunk that is all head has no tail and is encoded with its neighbours."""

    def __init__(self, path: str, most_bytes: int):
        self.ids, self.most, self.size, self.known = worker_ids(path), most_bytes, 0, {}
        self.kind = id_type(self.ids.tok.get_vocab_size())

    def one(self, text: bytes) -> bytes:
        return self.ids(column([text]))[0]

    def learn(self, new: dict[bytes, bytes]) -> None:
        texts = list(new.values())
        ends = []
        for t in texts:
            p = [x for x in map(t.find, (b" ", b"\n", b"\t", b"\v", b"\f", b"\r")) if x >= 0]
            ends.append((min(p), max(map(t.rfind, (b" ", b"\n", b"\t", b"\v", b"\f", b"\r")))) if p else (len(t), len(t)))
        ids = self.ids(column(texts))
        heads = self.ids(column([t[:a] for t, (a, _) in zip(texts, ends, strict=True)]))
        tails = self.ids(column([t[b:] for t, (_, b) in zip(texts, ends, strict=True)]))
        for d, t, own, h, e, (a, b) in zip(new, texts, ids, heads, tails, ends, strict=True):
            tail = len(t) - b
            if tail and not (own.startswith(h) and own.endswith(e) and len(h) + len(e) <= len(own)):  # widen both ends until they agree
                a, tail = split(t, own, self.one)
                h, e = self.one(t[:a]), self.one(t[len(t) - tail :]) if tail else b""
            packed = np.frombuffer(own, "<u4").astype(self.kind).tobytes()
            self.known[d] = (packed, len(h) // 4, len(e) // 4, t[:a], t[len(t) - tail :] if tail else b"")
            self.size += len(packed) + a + tail + 200


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 2**16 else "<u4"


def flat(rows) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])


def asked(docs: DataFrame, mean: int, least: int, most: int, buckets: int, tasks: int, block: int) -> DataFrame:
    """Of each block of ``block`` bytes of texts: its documents as lists of chunks (kind 0), and a row of distinct chunks for each bucket (kind 1)."""

    def run(batches):
        part, squeeze, sub = TaskContext.get().partitionId(), zstandard.ZstdCompressor(6), 0
        place: dict[bytes, int] = {}
        sent: list[tuple[list, list]] = [([], []) for _ in range(buckets)]
        keys, counts, index, size = [], [], [], 0

        def flush():
            src = (part << 20) + sub
            refs = (np.array([k if k is not None else 0 for k in keys], np.int64).tobytes(), np.array([k is not None for k in keys], bool).tobytes())
            yield flat([(part // tasks, sub % buckets, src, 0, b"".join(refs), np.array(counts, np.int32).tobytes(), np.array(index, np.int32).tobytes())])
            for i, (digests, texts) in enumerate(sent):
                if digests:
                    yield flat([(part // tasks, i, src, 1, b"".join(digests), np.array([len(t) for t in texts], np.int32).tobytes(), squeeze.compress(b"".join(texts)))])

        for b in pieces(batches):
            col = b.column(1).fill_null("")
            at = np.asarray(pa.Array.from_buffers(pa.int32(), len(col) + 1, [None, col.buffers()[1]], offset=col.offset))
            raw = memoryview(col.buffers()[2] or b"")[at[0] : at[-1]]
            ends = (at - at[0]).astype(np.int64)
            edges = ends.tolist()
            for key, lo, hi, own in zip(b.column(0).to_pylist(), edges[:-1], edges[1:], cuts(np.frombuffer(raw, np.uint8), ends, mean, least, most), strict=True):
                edge = [lo, *own, hi] if hi > lo else [lo]
                for x, y in zip(edge[:-1], edge[1:], strict=True):
                    d = xxhash.xxh3_128_digest(raw[x:y])
                    if (k := place.get(d)) is None:
                        bucket = d[0] % buckets
                        digests, texts = sent[bucket]
                        k = place[d] = bucket << 24 | len(digests)
                        digests.append(d)
                        texts.append(bytes(raw[x:y]))
                    index.append(k)
                keys.append(key)
                counts.append(len(edge) - 1)
                size += hi - lo
                if size >= block:
                    yield from flush()
                    place, sent, keys, counts, index, size, sub = {}, [([], []) for _ in range(buckets)], [], [], [], 0, sub + 1
        if keys:
            yield from flush()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROW)


def answered(rows: DataFrame, path: str, most_bytes: int) -> DataFrame:
    """The ids of the chunks asked for, in their order. A bucket encodes a chunk once."""

    def run(batches):
        know, squeeze, open_ = Encoder(path, most_bytes), zstandard.ZstdCompressor(9), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1)
                if r.column(3)[0].as_py() == 0:
                    yield r
                    continue
                g, bucket, src, _, a, b, c = (x[0].as_py() for x in r.columns)
                digests, at = [a[j : j + 16] for j in range(0, len(a), 16)], np.concatenate([[0], np.cumsum(np.frombuffer(b, np.int32))]).tolist()
                raw = open_.decompress(c)
                if know.size > know.most:
                    know.known, know.size = {}, 0
                know.learn({d: raw[at[j] : at[j + 1]] for j, d in enumerate(digests) if d not in know.known})
                got = [know.known[d] for d in digests]
                sizes = np.array([(len(x[0]) // int(know.kind[2]), x[1], x[2], len(x[3]), len(x[4])) for x in got], np.int32)
                yield flat([(g, bucket, src, 1, sizes.tobytes(), squeeze.compress(b"".join(x[0] for x in got)), b"".join(x[3] + x[4] for x in got))])
        release()

    return rows.repartition("g", "bucket").mapInArrow(run, ROW)


@lru_cache(maxsize=4)
def decoder(path: str):
    """ids -> text, as the tokenizer decodes, special tokens kept. Without a decoder of its own it puts blanks between tokens."""
    tok = worker_ids(path).tok
    if tok.decoder is not None:
        return lambda ids: tok.decode(ids, skip_special_tokens=False)
    names = [tok.id_to_token(i) for i in range(tok.get_vocab_size())]
    return lambda ids: " ".join([names[i] for i in ids])


class Block:
    """The documents of one block, put together from their chunks."""

    def __init__(self, refs: dict, replies: list[dict], kind: str):
        n = len(refs["a"]) // 9
        keys, valid = np.frombuffer(refs["a"][: 8 * n], np.int64), np.frombuffer(refs["a"][8 * n :], bool)
        self.keys = pa.array(keys, mask=~valid)
        self.counts, index = np.frombuffer(refs["b"], np.int32), np.frombuffer(refs["c"], np.int32)
        open_, base, first, sizes, ids, self.heads, self.tails = zstandard.ZstdDecompressor(), np.zeros(256, np.int64), 0, [], [], [], []
        for r in replies:
            s = np.frombuffer(r["a"], np.int32).reshape(-1, 5)
            base[r["bucket"]], first = first, first + len(s)
            sizes.append(s)
            ids.append(np.frombuffer(open_.decompress(r["b"]), kind))
            at = 0
            for h, t in s[:, 3:].tolist():
                self.heads.append(r["c"][at : at + h])
                self.tails.append(r["c"][at + h : at + h + t])
                at += h + t
        self.sizes = np.concatenate(sizes) if sizes else np.zeros((0, 5), np.int32)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, kind)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0], dtype=np.int64)]).tolist()
        self.chunks = (base[index >> 24] + (index & 0xFFFFFF)).tolist()

    def documents(self, encode, most: int):
        """Arrays of ids, ``most`` ids to a list or one document."""
        sizes, windows, plans, held, at = self.sizes.tolist(), [], [], 0, 0
        for n in self.counts.tolist():
            own, parts, open_ = self.chunks[at : at + n], [], None
            at += n
            for j, k in enumerate(own):
                size, head, tail, _, kept = sizes[k]
                if n == 1:
                    parts.append((self.starts[k], self.starts[k] + size))
                elif not kept:  # no white space: all of it belongs to one word with its neighbours
                    open_ = (open_ or b"") + self.heads[k]
                else:
                    if j:
                        parts.append(len(windows))
                        windows.append((open_ or b"") + self.heads[k])
                    parts.append((self.starts[k] + (head if j else 0), self.starts[k] + size - (tail if j < n - 1 else 0)))
                    open_ = self.tails[k] if j < n - 1 else None
            if n > 1 and open_ is not None:
                parts.append(len(windows))
                windows.append(open_)
            plans.append(parts)
            held += sum(sizes[k][0] for k in own)
            if held >= most:
                yield self.joined(plans, windows, encode)
                windows, plans, held = [], [], 0
        if plans:
            yield self.joined(plans, windows, encode)

    def joined(self, plans, windows, encode) -> list[np.ndarray]:
        between = [np.frombuffer(x, "<u4") for x in encode(column(windows))] if windows else []
        none = np.zeros(0, np.int32)
        return [np.concatenate([none, *[between[p] if isinstance(p, int) else self.ids[p[0] : p[1]] for p in parts]]).astype(np.int32) for parts in plans]


def encode(docs: DataFrame, path: str, mean: int = 1024, least: int = 128, most: int = 8192, buckets: int = 64, tasks: int = 256, block: int = 32 << 20, most_bytes: int = 256 << 20, out_ids: int = 1 << 20) -> DataFrame:
    """doc_id, ids and decoded text of every whole text, as the tokenizer at ``path`` gives them without special tokens added.

    Chunks have ``mean`` bytes on average, between ``least`` and ``most``. ``tasks`` reading tasks
    share a set of ``buckets``, so that a chunk that stands everywhere is sent to one bucket
    a bounded number of times; it is encoded once for these tasks (and again if a bucket has
    met over ``most_bytes`` of other chunks in between). Chunks are told apart by 128-bit digests. Null and
    empty texts have no ids; null ids and repeated rows stay rows; very long texts and words are
    encoded whole; an empty table gives no rows; other columns are not read.
    """
    rows = answered(asked(docs, mean, least, most, buckets, tasks, block), path, most_bytes)

    def run(batches):
        ids, decode, now, refs, replies = worker_ids(path), decoder(path), None, None, []
        kind = id_type(ids.tok.get_vocab_size())

        def put():
            own, first = Block(refs, replies, kind), 0
            for docs_ids in own.documents(ids, out_ids):
                at = np.zeros(len(docs_ids) + 1, np.int32)
                np.cumsum([len(x) for x in docs_ids], out=at[1:])
                yield pa.RecordBatch.from_arrays([own.keys.slice(first, len(docs_ids)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(docs_ids))), pa.array([decode(x.tolist()) for x in docs_ids], pa.string())], names=["doc_id", "ids", "decoded"])
                first += len(docs_ids)

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["src"] != now:
                    if refs:
                        yield from put()
                    now, refs, replies = r["src"], None, []
                if r["kind"] == 0:
                    refs = r
                else:
                    replies.append(r)
        if refs:
            yield from put()
        release()

    return rows.repartition("src").sortWithinPartitions("src", "kind", "bucket").mapInArrow(run, ENCODED)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    found = encode(session(spark).read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

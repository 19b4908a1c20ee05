"""Exact repeated substrings by a distributed, common-prefix-aware merge of sorted suffix runs.

Two equal strings of ``size`` bytes contain the same anchors: positions whose k-byte
hash is the smallest of some window that holds them. Suffixes at anchors therefore
stand for all suffixes. Documents are packed into blocks. Each block exchanges the
hashes of its anchors and learns which of them occur in other documents too; the
suffixes at those are sorted, front-coded and exchanged as runs, dealt by their first
k bytes; those that the block can settle by itself stay. A loser tree merges the runs of a part: every head carries the length of the
prefix it shares with the last winner, so known prefixes are never compared again. The
merged order and its common prefixes give the classes of equal right contexts, a sort
of the bytes before the anchors those of equal left contexts, and both together say
which strings start in a document of smaller id.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Store, pieces, session

LAST = 2**63 - 1  # orders documents without an id after all others
RUN = "r int, block bigint, n int, run binary"


def packed_words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number."""
    n = len(b) - 7
    out = np.empty(n, np.uint64)
    raw = b.tobytes()
    for i in range(min(8, n)):
        k = (n - i + 7) // 8
        out[i::8] = np.frombuffer(raw, "<u8", k, i)
    return out


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = f(out[:-span], out[span:])
        span *= 2
    return f(out[: len(out) - (w - span)], out[w - span :]) if span < w else out


def hashes(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings (k a multiple of eight)."""
    m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    p = packed_words(b) * m1
    p ^= p >> np.uint64(32)
    h = p[: len(b) - k + 1].copy()
    for at in range(8, k, 8):
        h *= m2
        h ^= h >> np.uint64(29)
        h += p[at : at + len(h)]
    h *= m1
    h ^= h >> np.uint64(31)
    return h


def anchors(text: np.ndarray, ends: np.ndarray, size: int, k: int, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows that lie in one document."""
    found, own = [], []
    w = size - k + 1
    for at in range(0, max(0, len(text) - size + 1), part):
        b = text[at : at + part + size - 1]
        if len(b) < size:
            break
        h = hashes(b, k)
        g = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = sliding(g, w, np.minimum)  # by window start
        start = np.arange(at, at + len(least))
        end = ends[np.searchsorted(ends, start, side="right")]
        least[start + size > end] = 0
        pad = np.zeros(w - 1, np.uint32)
        most = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
        i = np.flatnonzero((most == g) & (most > 0))
        found.append(i + at)
        own.append(h[i])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate(found), return_index=True)
    return pos, np.concatenate(own)[first]


def blocks(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """(block, meta, body): ids and sizes of some whole documents, and their compressed texts."""

    def run(batches):
        n, held, meta = 0, [], []
        base = TaskContext.get().partitionId() << 32
        z = zstandard.ZstdCompressor(level=6)

        def emit():
            body = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([np.array(meta, np.int64).tobytes()], pa.binary()), pa.array([z.compress(body)], pa.binary())], names=["block", "meta", "body"])

        for b in pieces(batches):
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                held.append(raw)
                meta.append((LAST if doc is None else doc, len(raw), doc is None))
                if sum(m[1] for m in meta[-64:]) >= block_bytes or len(meta) % 64 == 0 and sum(m[1] for m in meta) >= block_bytes:
                    yield emit()
                    n, held, meta = n + 1, [], []
        if meta:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "block bigint, meta binary, body binary")


class Block:
    def __init__(self, meta: bytes, body: bytes):
        self.meta = np.frombuffer(meta, np.int64).reshape(-1, 3)
        self.raw = zstandard.ZstdDecompressor().decompress(body)
        self.text = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(self.meta[:, 1])
        self.starts = self.ends - self.meta[:, 1]

    def doc(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, pos, side="right")


def rank_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def split_by(r: np.ndarray, parts: int):
    """(part, slice) for sorted part numbers."""
    cut = np.searchsorted(r, np.arange(parts + 1))
    return [(p, slice(cut[p], cut[p + 1])) for p in range(parts) if cut[p + 1] > cut[p]]


def front_coded(order, suffix, lengths, width):
    """Common prefixes of neighbours in sorted order and the bytes after them."""
    s = suffix[order]
    n = lengths[order]
    same = np.zeros(len(order), np.int64)
    if len(order) > 1:
        eq = s[1:] == s[:-1]
        run = np.where(eq.all(1), width, eq.argmin(1))
        same[1:] = np.minimum(run, np.minimum(n[1:], n[:-1]))
    keep = np.arange(width) >= same[:, None]
    keep &= np.arange(width) < n[:, None]
    return same, s[keep].tobytes()


def contexts(b: Block, pos: np.ndarray, left: int, size: int):
    """(bytes around each position, zero outside its document; counts of those after and before it; document)."""
    d = b.doc(pos)
    right_n = np.minimum(size, b.ends[d] - pos)
    left_n = np.minimum(left, pos - b.starts[d])
    out = np.empty((len(pos), left + size), np.uint8)
    step, span = 1 << 16, np.arange(left + size)
    for at in range(0, len(pos), step):
        i = slice(at, at + step)
        from_ = pos[i][:, None] + (span - left)
        inside = (span >= left - left_n[i][:, None]) & (span < left + right_n[i][:, None])
        out[i] = b.text[np.clip(from_, 0, len(b.text) - 1)] * inside
    return out, right_n, left_n, d


def settled(ctx: np.ndarray, right_n: np.ndarray, left_n: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Which suffixes equal one of a smaller document of this block in all bytes around them.

    Every window they stand for starts in that document too, so that they need no
    exchange: a passage of many documents leaves a block about once. Groups are found by
    a hash and confirmed byte by byte.
    """
    n = len(ctx)
    if n < 2:
        return np.zeros(n, bool)
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = ctx
    h = (right_n * 256 + left_n).astype(np.uint64)
    for word in wide.view("<u8").T:
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    o = np.lexsort((order, h))
    fresh = np.concatenate([[True], h[o][1:] != h[o][:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # the smallest document of the same hash
    j = o[first]
    same = (order[o] > order[j]) & (right_n[o] == right_n[j]) & (left_n[o] == left_n[j])
    i = np.flatnonzero(same)
    same[i] = (ctx[o[i]] == ctx[j[i]]).all(1)
    out = np.zeros(n, bool)
    out[o[same]] = True
    return out


def packed_marks(doc: np.ndarray, pos: np.ndarray, mask: np.ndarray) -> bytes:
    return zlib.compress(doc.astype("<i4").tobytes() + pos.astype("<i8").tobytes() + mask.astype("<u8").tobytes(), 1)


def make_runs(b: Block, pos: np.ndarray, h: np.ndarray, parts: int, size: int, k: int):
    """One sorted, front-coded run of suffixes (with the bytes before them) for every part.

    First of all come the marks of the suffixes that this block settles by itself (part None).
    """
    left, z = size - k, zstandard.ZstdCompressor(level=6)
    ctx, right_n, left_n, d = contexts(b, pos, left, size)
    order = b.meta[d, 0]
    done = settled(ctx, right_n, left_n, order, left + size)
    if done.any():
        bits = np.zeros(int(done.sum()), np.uint64)
        for i in range(left + 1):
            bits |= ((right_n[done] >= size - i) & (left_n[done] >= i)).astype(np.uint64) << np.uint64(i)
        yield None, 0, packed_marks(d[done], pos[done] - b.starts[d[done]], bits)
    rest_of = np.flatnonzero(~done)
    r = rank_of(h[rest_of], parts)
    by = np.argsort(r, kind="stable")
    for p, part in split_by(r[by], parts):
        i = rest_of[by[part]]
        suffix = ctx[i, left:]
        wide = np.zeros((len(i), -(-size // 8) * 8), np.uint8)
        wide[:, :size] = suffix
        o = np.lexsort((right_n[i], *wide.view(">u8").T[::-1]))
        same, rest = front_coded(o, suffix, right_n[i], size)
        j = i[o]
        cols = [same.astype(np.uint8), right_n[j].astype(np.uint8), left_n[j].astype(np.uint8), ctx[j, :left], order[j], d[j].astype(np.int32), (pos[j] - b.starts[d[j]]).astype(np.int32)]
        yield p, len(j), z.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in cols) + rest)


class Run:
    """A decoded run: arrays, and an iterator of (shared prefix, bytes)."""

    def __init__(self, block: int, n: int, data: bytes, left: int):
        raw, at = zstandard.ZstdDecompressor().decompress(data), 0
        self.block, self.n = block, n

        def take(kind, width=1):
            nonlocal at
            a = np.frombuffer(raw, kind, n * width, at)
            at += a.nbytes
            return a

        self.same, self.right_n, self.left_n = take(np.uint8), take(np.uint8), take(np.uint8)
        self.left = take(np.uint8, left).reshape(n, left)
        self.order, self.doc, self.pos = take(np.int64), take(np.int32), take(np.int32)
        self.rest = raw[at:]

    def heads(self):
        at, now = 0, b""
        for same, n in zip(self.same.tolist(), self.right_n.tolist(), strict=True):
            to = at + n - same
            now = now[:same] + self.rest[at:to]
            at = to
            yield same, now


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    while at < n and a[at] == b[at]:
        at += 1
    return at


def merge(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """(run number of each suffix in merged order, its prefix shared with the one before).

    A loser tree: inner nodes hold the run that lost there, and known[i] is the prefix
    that run i's head shares with the run that beat it. Of two heads the one that shares
    more with the last winner is smaller; only if both share as much are bytes compared,
    and from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    its = [r.heads() for r in runs] + [iter(())] * (k - len(runs))
    head: list[bytes | None] = [None] * k
    known = [0] * k
    for i, it in enumerate(its):
        got = next(it, None)
        head[i] = got[1] if got else None
    loser = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; the loser learns its prefix shared with the winner."""
        if head[b] is None:
            return True
        if head[a] is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        x, y = head[a], head[b]
        n = common(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return True
        known[a] = n
        return False

    winners = list(range(k))
    at = k
    level = winners
    while len(level) > 1:  # play the first round
        at //= 2
        up = []
        for j in range(0, len(level), 2):
            a, b = level[j], level[j + 1]
            if beats(a, b):
                loser[at + j // 2] = b
                up.append(a)
            else:
                loser[at + j // 2] = a
                up.append(b)
        level = up
    w = level[0]
    out, shared = [], []
    while head[w] is not None:
        out.append(w)
        shared.append(known[w])
        got = next(its[w], None)
        if got:
            known[w], head[w] = got
        else:
            head[w] = None
        node = (w + k) // 2
        while node:
            x = loser[node]
            hx = head[x]
            if hx is not None:
                if head[w] is None or known[x] > known[w]:
                    loser[node], w = w, x
                elif known[x] == known[w] and not beats(w, x):
                    loser[node], w = w, x
            node //= 2
    shared[:1] = [0]
    return np.array(out, np.int64), np.array(shared, np.int64)


def marks(runs: list[Run], size: int, k: int):
    """Per run: for each suffix a bit mask of the windows (anchor minus bit) that start in a smaller document too."""
    left = size - k
    which, shared = merge(runs)
    index = np.zeros(len(which), np.int64)
    for i in range(len(runs)):
        index[which == i] = np.arange(runs[i].n)
    base = np.cumsum([0] + [r.n for r in runs[:-1]])[which] + index
    cat = lambda f: np.concatenate([f(r) for r in runs])[base]
    order, right_n, left_n, before = cat(lambda r: r.order), cat(lambda r: r.right_n), cat(lambda r: r.left_n), cat(lambda r: r.left)
    n = len(which)
    # sort the bytes before the anchors, nearest first, and find their common prefixes
    back = before[:, ::-1]
    width = -(-left // 8) * 8
    wide = np.zeros((n, width), np.uint8)
    wide[:, :left] = back
    cols = wide.view(">u8")
    by = np.lexsort(cols.T[::-1])
    eq = back[by][1:] == back[by][:-1]
    lshared = np.concatenate([[0], np.where(eq.all(1), left, eq.argmin(1))]) if n > 1 else np.zeros(n, np.int64)
    mask = np.zeros(n, np.uint64)
    for d in range(left + 1):
        rc = np.cumsum(shared < size - d)
        lc = np.empty(n, np.int64)
        lc[by] = np.cumsum(lshared < d)
        ok = (right_n >= size - d) & (left_n >= d)
        ok &= (np.bincount(rc[ok], minlength=n + 2)[rc] > 1) & (np.bincount(lc[ok], minlength=n + 2)[lc] > 1)
        i = np.flatnonzero(ok)
        if len(i) < 2:
            continue
        c = rc[i] * (n + 2) + lc[i]
        o = np.argsort(c, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], c[o][1:] != c[o][:-1]]))
        least = np.repeat(np.minimum.reduceat(order[i][o], first), np.diff(np.append(first, len(o))))
        hit = i[o][least < order[i][o]]
        mask[hit] |= np.uint64(1 << d)
    for i, r in enumerate(runs):
        own = np.flatnonzero((which == i) & (mask > 0))
        if len(own):
            yield r.block, r.doc[index[own]], r.pos[index[own]], mask[own]


def _grouped(batches, key: int = 0):
    """Rows of sorted batches, gathered by the key column."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[key] != now and held:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def cleaned(docs: DataFrame, store: Store, size: int = 50, k: int = 24, part_anchors: int = 250_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) per document row; needs size - k < 64.

    ``spans`` are the removed bytes, from start to before end; ``kept`` are the others, as
    bytes, because a span may begin or end inside a character.
    """
    held = store.put(blocks(docs), "blocks")
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(1, int(total / (size - k + 2) * 2 / part_anchors))

    def tell(batches):
        for b in batches:
            for block, meta, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Block(meta, body)
                pos, h = anchors(x.text, x.ends, size, k)
                o = np.lexsort((x.doc(pos), h))
                h, d = h[o], x.doc(pos)[o]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                many = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first) if len(first) else np.zeros(0, bool)
                u = h[first]
                r = rank_of(u, parts)
                rows = [(p, block, ((u[s] >> np.uint64(16)) << np.uint64(1) | many[s]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()) for p, s in split_by(r, parts)]
                for i in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 512], strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["r", "block", "h"])

    def repeated(batches):
        for _, rows in _grouped(batches):
            got = [_seven(x[2]) for x in rows]
            v = np.concatenate(got)
            src = np.repeat(np.arange(len(got)), [len(g) for g in got])
            u, inverse, n = np.unique(v >> np.uint64(1), return_inverse=True, return_counts=True)
            many = n > 1
            many[inverse[(v & np.uint64(1)) > 0]] = True
            hit = many[inverse]
            for i in np.unique(src[hit]):
                own = np.ascontiguousarray((v[hit & (src == i)] >> np.uint64(1)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][1]], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["block", "h"])

    dealt = held.mapInArrow(tell, "r int, block bigint, h binary").repartition(parts, "r").sortWithinPartitions("r")
    shared = store.put(dealt.mapInArrow(repeated, "block bigint, h binary").groupBy("block").agg(F.collect_list("h").alias("h")), "repeated")

    def suffixes(batches):
        for b in batches:
            for block, meta, body, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Block(meta, body)
                pos, h = anchors(x.text, x.ends, size, k)
                ok = np.isin(h >> np.uint64(16), np.concatenate([_six(y) for y in known]))
                rows = []
                for p, n, run in make_runs(x, pos[ok], h[ok], parts, size, k):
                    rows.append((block % parts if p is None else p, block, n, run))
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256], strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["r", "block", "n", "run"])

    def solve(batches):
        for _, rows in _grouped(batches):
            own = [(x[1], x[3]) for x in rows if not x[2]]  # settled before
            sent = [Run(x[1], x[2], x[3], size - k) for x in rows if x[2]]
            for block, m in chain(own, ((block, packed_marks(d, p, m)) for block, d, p, m in marks(sent, size, k)) if sent else ()):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([m], pa.binary())], names=["block", "m"])

    runs = held.join(shared, "block").select("block", "meta", "body", "h").mapInArrow(suffixes, RUN)
    merged = runs.repartition(parts, "r").sortWithinPartitions("r", "block").mapInArrow(solve, "block bigint, m binary")
    found = store.put(merged.groupBy("block").agg(F.collect_list("m").alias("m")), "repeats")

    def cut(batches):
        for b in batches:
            for meta, body, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Block(meta, body)
                delta = np.zeros(len(x.text) + 1, np.int32)
                for y in m or ():
                    raw = zlib.decompress(y)
                    n = len(raw) // 20
                    d, p, bits = np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<i8", n, 4 * n), np.frombuffer(raw, "<u8", n, 12 * n)
                    at = x.starts[d] + p
                    for i in range(size - k + 1):
                        s = at[(bits >> np.uint64(i)) & np.uint64(1) > 0] - i
                        np.add.at(delta, s, 1)
                        np.add.at(delta, s + size, -1)
                gone = np.cumsum(delta[:-1]) > 0
                yield pa.RecordBatch.from_arrays(_cleaned(x, gone), names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return held.join(found, "block", "left").select("meta", "body", "m").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def _cleaned(x: Block, gone: np.ndarray) -> list[pa.Array]:
    """Columns of ``cleaned`` for the documents of a block, by a flag for each byte."""
    n, full = x.meta[:, 1], x.meta[:, 1] > 0
    first, last = gone.copy(), gone.copy()
    first[1:] &= ~gone[:-1]
    last[:-1] &= ~gone[1:]
    at = x.starts[full]  # a span ends with its document
    first[at] = gone[at]
    at = x.ends[full] - 1
    last[at] = gone[at]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    own = x.doc(a)
    spans = pa.StructArray.from_arrays([pa.array(a - x.starts[own], pa.int64()), pa.array(b - x.starts[own], pa.int64())], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(n) + 1)), pa.int32()), spans)
    upto = np.concatenate([[0], np.cumsum(gone)])
    n_removed = upto[x.ends] - upto[x.starts]
    ends = np.concatenate([[0], np.cumsum(n - n_removed)]).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(x.text[~gone])])
    return [pa.array(x.meta[:, 0], pa.int64(), mask=x.meta[:, 2] > 0), pa.array(n, pa.int64()), pa.array(n_removed, pa.int64()), spans, kept]


def removed(docs: DataFrame, store: Store, size: int = 50, k: int = 24, part_anchors: int = 250_000) -> DataFrame:
    """``cleaned`` with the number of spans and a digest of the kept bytes in their place."""
    out = cleaned(docs, store, size, k, part_anchors)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _wide(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :n] = x
    return out.view("<u8").ravel()


def _seven(raw: bytes) -> np.ndarray:
    return _wide(raw, 7)


def _six(raw: bytes) -> np.ndarray:
    return _wide(raw, 6)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a document of smaller id.

    Null texts are empty. Rows with a null id come after all others and take nothing from
    each other; rows that share an id take nothing from each other either. Very long texts
    are compared whole. An empty table gives no rows; other columns are not read.
    """
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs, Store(spark))

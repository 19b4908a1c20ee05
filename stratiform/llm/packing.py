"""Packing of tokenized documents into fixed windows by non-negative least squares.

Documents are cut into whole windows and one remainder. The remainders' lengths are
counted in a histogram, which has as many bins as the window has tokens however large
the corpus is. Shallow combinations (two or three lengths that fill a window) get
repeat counts by non-negative least squares against the histogram; the counts are
rounded, and what they leave is packed greedily on the histogram, cutting pieces where
nothing fits. Pieces have ordinals within their length, so that each finds its place
from the plan and the pieces counted before it. Up to a bound these counts are sent to all
tasks and no token ids are shuffled; beyond it, pieces meet the counts by their block and length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict, deque
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Store, pieces, session
from .common import bounded

PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, block int, ordinal bigint"
PLACED = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
# Chunks that are a word with at most one mark behind it; white space for Arrow, not for the tokenizer.
LATIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
ODD_SPACE = "[\x1c-\x1f]"


class Memory(dict):
    """Ids of chunks met before, as little-endian 32-bit bytes, in two generations of ``most`` chunks."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, chunk: str) -> bytes:
        v = self.old.get(chunk)
        if v is None:
            v = self.encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.old = self.copy()
                self.clear()
            self[chunk] = v
        return v


class Ids:
    """Ids of texts, a column at a time, with a bounded memory.

    The tokenizer drops white space and case, so a text's ids are its chunks' ids in a
    row, and a chunk of Latin letters with a stop or comma has its lower-case word's ids
    and then the mark's. Each distinct word of a column is looked up once.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words = Memory(self.encode, most)

    def encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a string column; null has none."""
        odd = pc.match_substring_regex(texts, ODD_SPACE).fill_null(False)
        chunks = pc.utf8_split_whitespace(pc.if_else(odd, "", texts.fill_null("")))
        at, every = chunks.offsets.to_numpy(), chunks.values.dictionary_encode()
        own = every.dictionary
        latin = pc.match_substring_regex(own, LATIN)
        mark = pc.if_else(latin, pc.utf8_slice_codeunits(own, -1), "")
        mark = pc.if_else(pc.is_in(mark, pa.array([".", ","])), mark, "")
        word = pc.if_else(latin, pc.utf8_lower(pc.utf8_rtrim(own, ".,")), own).dictionary_encode()
        ids = self.of(word.dictionary).take(word.indices)
        marks = mark.dictionary_encode()
        ids = pc.binary_join_element_wise(ids, self.of(marks.dictionary).take(marks.indices), pa.scalar(b"", pa.large_binary()))
        ids = ids.take(every.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1][at - at[0]] if len(ids) else np.zeros(len(at), np.int64)
        data = memoryview(ids.buffers()[2] or b"") if len(ids) else memoryview(b"")
        out = [bytes(data[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode(texts[i].as_py())
        return out

    def of(self, chunks: pa.Array) -> pa.Array:
        return pa.array(list(map(self.words.__getitem__, chunks.to_pylist())), pa.large_binary())


@cache
def worker_ids(path: str) -> Ids:
    """One per Python worker, which serves many tasks."""
    return Ids(path)


def tokenized(docs: DataFrame, path: str, window: int, end_id: int = 1) -> DataFrame:
    """Whole windows and the remainder of every document, numbered within (block, length)."""

    def run(batches):
        ids, block, seen = worker_ids(path), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for b in pieces(batches, 4 << 20, 1024):
            rows = []
            for doc, own in zip(b.column(0).to_pylist(), ids(b.column(1)), strict=True):
                buf = own + end
                n = len(buf) // 4
                for at in range(0, n, window):
                    part = buf[4 * at : 4 * (at + window)]
                    size = len(part) // 4
                    rows.append((doc, at, size, n, part, block, seen[size]))
                    seen[size] += 1
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of two or three of ``lengths`` that fill the window (a zero stands for no third)."""
    there = np.zeros(window + 1, bool)
    there[lengths[lengths < window]] = True
    own = np.flatnonzero(there)
    two = own[(own <= window - own) & there[window - own]]
    found = [np.stack([two, window - two, np.zeros_like(two)], 1)]
    for a in own[own * 3 <= window]:
        b = own[(own >= a) & (own <= (window - a) // 2)]
        b = b[there[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(found)


def least_squares(rows: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimize ||A x - counts||, by accelerated projected gradient."""
    size = len(counts)
    use = lambda x: sum(np.bincount(rows[:, i], x, size) for i in range(rows.shape[1])) * (np.arange(size) > 0)
    back = lambda r: sum(np.where(rows[:, i] > 0, r[rows[:, i]], 0) for i in range(rows.shape[1]))
    v = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue of A'A
        v = back(use(v))
        top = np.linalg.norm(v)
        v /= top
    x, y, t = np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(use(y) - counts) / (1.05 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


class Plan:
    """Places for (length, ordinal): runs of ordinals that go to consecutive sequences at one offset."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.places, self.sequences = window, [], 0
        self.left = {n: deque([(n, 0, c, 0)]) for n, c in counts.items() if c > 0}
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.solve()
        self.rest()

    def take(self, n: int, times: int, offset: int, size: int) -> None:
        """Place the first ``size`` ids of ``times`` pieces of n ids; what is cut off waits as pieces of n - size."""
        q, done = self.left[n], 0
        self.count[n] -= times
        while done < times:
            of, first, k, start = q.popleft()
            use = min(k, times - done)
            self.places.append((of, first, use, start, size, self.sequences + done, offset))
            if use < k:
                q.appendleft((of, first + use, k - use, start))
            if size < n:
                self.left.setdefault(n - size, deque()).append((of, first, use, start + size))
                self.count[n - size] = self.count.get(n - size, 0) + use
            done += use

    def put(self, combo: list[tuple[int, int]], times: int) -> None:
        offset = 0
        for n, size in combo:
            self.take(n, times, offset, size)
            offset += size
        self.sequences += times

    def solve(self) -> None:
        if full := self.count.get(self.window, 0):
            self.put([(self.window, self.window)], full)
        rows = combinations(self.window, np.array([n for n, c in self.count.items() if c > 0], np.int64))
        if not len(rows):
            return
        target = np.zeros(self.window + 1)
        for n, c in self.count.items():
            target[n] = c if n < self.window else 0
        x = least_squares(rows, target)
        for i in np.argsort(-x, kind="stable"):
            if (times := int(x[i] + 0.5)) < 1:
                break
            combo = [int(n) for n in rows[i] if n]
            times = min([times, *(self.count[n] // combo.count(n) for n in combo)])
            if times > 0:
                self.put([(n, n) for n in combo], times)

    def rest(self) -> None:
        """Longest first, filled with the longest that fit; if nothing fits, the next longer piece is cut."""
        while sum(n * c for n, c in self.count.items()) >= self.window:
            free = {n: c for n, c in self.count.items() if c > 0}
            order, space, combo, used = sorted(free), self.window, [], defaultdict(int)
            while space:
                i = bisect_right(order, space) - 1
                while i >= 0 and used[order[i]] >= free[order[i]]:
                    order.pop(i)
                    i -= 1
                if i >= 0:
                    n = order[i]
                    k = min(space // n, free[n] - used[n])
                    combo += [(n, n)] * k
                    used[n] += k
                    space -= n * k
                else:
                    n = next(n for n in order if used[n] < free[n])
                    combo.append((n, space))
                    used[n] += 1
                    space = 0
            self.put(combo, min(free[n] // k for n, k in used.items() if k))
        total = sum(n * c for n, c in self.count.items())
        for bit in reversed(range(total.bit_length())):  # powers of two need no padding
            if total >> bit & 1:
                space, offset = 1 << bit, 0
                while space:
                    n = max(n for n, c in self.count.items() if c > 0)
                    size = min(n, space)
                    self.take(n, 1, offset, size)
                    offset, space = offset + size, space - size
                self.sequences += 1

    def lookup(self) -> dict[tuple[int, int], tuple[list, list]]:
        """(length, start inside the piece) -> sorted first ordinals, and the rest of each run."""
        by = defaultdict(list)
        for of, first, times, start, size, seq, offset in self.places:
            by[of, start].append((first, times, size, seq, offset))
        return {k: ([r[0] for r in sorted(v)], sorted(v)) for k, v in by.items()}


def pack(docs: DataFrame, store: Store, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per placed piece, with its ids as little-endian 32-bit bytes. The plan that goes to the tasks depends on the window, not on the corpus.

    Null and empty texts hold the end id alone; null ids and repeated rows are packed like any
    other; very long texts are cut into windows; an empty table gives no rows; other columns are not read.
    """
    cut = store.put(tokenized(docs, path, window, end_id), "token-pieces")
    counts = cut.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = store.put(counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))), "length-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    plan = Plan(histogram, window).lookup()

    def place(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n, at, ordinal = r["length"], 0, r["ordinal"] + r["before"]
                while at < n:
                    firsts, runs = plan[n, at]
                    first, _, size, seq, offset = runs[bisect_right(firsts, ordinal) - 1]
                    out.append((r["doc_id"], r["start"] + at, size, r["ids"][4 * at : 4 * (at + size)], r["doc_tokens"], seq + ordinal - first, offset))
                    at += size
            if out:
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PLACED.split(", ")])

    placed = cut.join(bounded(counts.select("block", "length", "before")), ["block", "length"])
    return placed.select("doc_id", "start", "length", "doc_tokens", "ids", "ordinal", "before").mapInArrow(place, PLACED)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048, with a checksum of their ids; see ``pack``."""
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs, Store(spark), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

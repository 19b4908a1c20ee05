"""SimHash near-duplicates through one-wildcard segment variants.

Two 64-bit fingerprints that differ in at most four bits are cut into three segments;
one segment then differs in at most one bit. Every distinct fingerprint is indexed
under its segments with one bit masked out: the two share at least one such variant.
Fingerprints under one key are compared (xor and bit count), and each key hands on a
spanning forest of its links, not all pairs. Keys with many fingerprints are cut into
blocks, and every two blocks of a key meet in some task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Store, pieces, release, session, text_key
from .components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LANES = np.uint64(0x0101010101010101)


def shingles(text: str, size: int) -> list[bytes]:
    w = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if len(w) < size:
        return [b" ".join(w)] if w else []
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprints(texts, size: int = 4, seed: int = 42) -> np.ndarray:
    """A bit is set if it is set in more than half of the text's shingle hashes."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for t in texts:
        s = shingles(t, size) if t else []
        counts.append(len(s))
        hashes.append(np.fromiter((digest(x, seed) for x in s), np.uint64, len(s)))
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    h = np.concatenate(hashes)
    # byte lanes hold counts up to 255, so each text is summed in runs of 255 hashes
    starts = np.concatenate([[0], np.cumsum(n[full])])
    runs = [np.arange(a, b, 255) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    firsts = np.cumsum([0] + [len(r) for r in runs[:-1]])
    runs = np.concatenate(runs)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, runs)
        per_text = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        more = 2 * per_text > n[full][:, None]
        for lane in range(8):
            out[full] |= more[:, lane].astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprint_table(docs: DataFrame, size: int = 4) -> DataFrame:
    def run(batches):
        for b in pieces(batches, 2 << 20):  # a piece takes some twenty times its size
            fp = fingerprints(b.column(2).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, key bigint, fp bigint")


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, size) of the fewest segments of which one differs by at most one bit."""
    parts = bits // 2 + 1
    size = [64 // parts + (i < 64 % parts) for i in range(parts)]
    return [(sum(size[:i]), n) for i, n in enumerate(size)]


def variant_table(fps: DataFrame, bits: int, name: str = "fp") -> DataFrame:
    """(k, fp): for every bit of every segment, that segment with the bit masked out."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, tag = [], 0
            for at, n in segments(bits):
                part = (fp >> np.uint64(at)) & np.uint64((1 << n) - 1)
                for w in range(n):
                    # the tag and the segment make the key; a product with an odd number spreads keys and loses none
                    keys.append((((np.uint64(tag) << np.uint64(40)) | (part & ~np.uint64(1 << w))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                    tag += 1
            for k in keys:
                yield pa.RecordBatch.from_arrays([pa.array(k), b.column(0)], names=["k", name])

    return fps.select(name).mapInArrow(run, f"k bigint, {name} bigint")


def apart(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``fp``: each fingerprint that is reached is compared with those not yet reached."""
    left, edges = fp, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = apart(left, x) <= bits
            if near.any():
                got, left = left[near], left[~near]
                edges += [(x, y) for y in got]
                todo += got.tolist()
                todo = [np.uint64(t) for t in todo]
    return edges


def links(fps: DataFrame, store: Store, bits: int = 4, block: int = 2048, spread: int = 20_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that have the links' connected components."""
    # each row becomes 64, so the few files of a small table are dealt to more tasks first
    fps = fps.select("fp").repartition(max(1, -(-fps.count() // spread)), "fp")
    v = variant_table(fps, bits)
    hot = store.put(v.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "hot-keys")
    slots = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), slots).cast("int")
    # a fingerprint under a hot key goes to every pair of blocks that holds its own; others stay whole
    pairs = F.transform(F.sequence(F.lit(0), slots - 1), lambda o: (F.least(own, o) * slots + F.greatest(own, o)).cast("int"))
    put = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)
    dealt = v.join(hot, "k", "left").select("k", F.explode(put).alias("p"), "fp").repartition("k", "p").sortWithinPartitions("k", "p")

    def run(batches):
        rest_k, rest_p, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)

        def solve(k, p, f):
            edges = []
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])]))
            size = np.diff(np.append(first, len(k)))
            most = 32
            small = np.repeat(size <= most, size)
            group = np.repeat(np.arange(len(first)), size)
            for d in range(1, min(most, int(size.max(initial=1)))):
                a, b = f[:-d], f[d:]
                hit = (group[:-d] == group[d:]) & small[:-d] & (apart(a, b) <= bits)
                if hit.any():
                    edges.append(np.stack([a[hit], b[hit]], 1))
            for g in np.flatnonzero(size > most):
                e = forest(f[first[g] : first[g] + size[g]], bits)
                if e:
                    edges.append(np.array(e, np.uint64))
            if not edges:
                return None
            e = np.unique(np.concatenate(edges), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], names=["a", "b"])

        for b in batches:
            k = np.concatenate([rest_k, b.column(0).to_numpy(zero_copy_only=False)])
            p = np.concatenate([rest_p, b.column(1).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            if len(k) < 32_000:
                rest_k, rest_p, rest_f = k, p, f
                continue
            last = np.flatnonzero((k != k[-1]) | (p != p[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut and (out := solve(k[:cut], p[:cut], f[:cut])) is not None:
                yield out
            rest_k, rest_p, rest_f = k[cut:], p[cut:], f[cut:]
        if len(rest_k) and (out := solve(rest_k, rest_p, rest_f)) is not None:
            yield out
        release()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, store: Store, bits: int = 4, size: int = 4) -> DataFrame:
    """doc_id, key (of the text), fp, component_id and root (the component's own number) per document row.

    Equal fingerprints are one node, so copies are never paired. A component's id is its
    smallest doc_id; rows with a null doc_id have a fingerprint and link others, but name
    no component. Null and empty texts have fingerprint zero and link like any other. Repeated
    rows give a row each; very long texts are read whole. An empty table gives no rows; other columns are not read.
    """
    fps = store.put(fingerprint_table(docs, size), "fingerprints")
    nodes = store.put(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = store.put(links(nodes, store, bits), "links")
    root = components(edges, store)
    named = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = store.put(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = store.put(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, store: Store) -> DataFrame:
    """One document row of each group, with all its columns: the smallest doc_id, null last, then the smallest text key, and any one of rows that repeat both.

    Null and empty texts are one group; very long texts are read whole; an empty table stays empty.
    """
    found = near_duplicates(docs, store)
    sizes = store.put(found.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "rows-alike")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = sizes.groupBy("root").agg(F.min(F.struct(order.alias("o"), "n")).alias("b"))
    best = store.put(best.select(F.col("b.o.doc_id").alias("k_id"), F.col("b.o.key").alias("k_key"), "b.n"), "kept")
    same = docs["doc_id"].eqNullSafe(best.k_id) & (text_key("text") == best.k_key)
    one = docs.join(best.where("n = 1"), same, "left_semi")
    many = docs.join(best.where("n > 1"), same, "left_semi")
    whole = F.struct(*[many[f"`{c.replace('`', '``')}`"] for c in many.columns])  # whatever the columns are called
    many = many.select(whole.alias("row"), many["doc_id"].alias("a"), text_key("text").alias("b")).dropDuplicates(["a", "b"]).select("row.*")
    return one.unionByName(many)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see ``near_duplicates``."""
    found = near_duplicates(session(spark).read.parquet(f"{sf_dir}/documents.parquet"), Store(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

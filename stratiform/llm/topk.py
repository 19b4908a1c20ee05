"""Exact top-k inner products: a KD-tree per shard, visited best box first.

Vectors are cut into shards of bounded size where they lie, without a shuffle. Each
shard is split at medians of its widest dimension, down to leaves; inner nodes and leaves
have tight bounding boxes. A block of queries goes down the tree, first into the box that
allows the largest inner product, and leaves out boxes below its kth score, which is
carried from shard to shard. Queries begin with the kth score of one shard. Groups of
query blocks meet groups of shards, so that both are sent on a few times only and a
query's rows are handed on by a few groups, whatever the number of shards.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Store, session

SHARD = "dim int, n int, ids binary, comps binary, tree binary, lo binary, hi binary"
LONG = 2**63


def quantize(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which are whole numbers."""
    return np.floor(scale * values.astype(np.float64))


def usable(batch, ids: str, vectors: str):
    """(dim, ids, matrix) of the rows that take part, by dimension."""
    from collections import defaultdict

    col = batch.column(batch.schema.get_field_index(vectors))
    key = batch.column(batch.schema.get_field_index(ids))
    valid = np.asarray(col.is_valid()) & np.asarray(key.is_valid())
    keys = np.asarray(key.fill_null(0)).astype(np.int64)
    flat = np.asarray(col.values.cast(pa.float64()).fill_null(np.nan))
    offsets = np.asarray(col.offsets)
    size = np.diff(offsets)
    by: dict[int, list] = defaultdict(list)
    for d in np.unique(size[valid]) if valid.any() else ():
        if not d:
            continue
        rows = np.flatnonzero(valid & (size == d))
        m = flat[offsets[rows][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(1)
        by[int(d)] = [keys[rows[ok]], m[ok]]
    return [(d, k, m) for d, (k, m) in by.items() if len(k)]


def build(matrix: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows, the tree (first row, last row, first child or -1 of each node; the root is 0), and each node's box."""
    order, nodes, lo, hi = np.arange(len(matrix)), [[0, len(matrix), -1]], [], []
    i = 0
    while i < len(nodes):
        a, b, _ = nodes[i]
        own = matrix[order[a:b]]
        lo.append(own.min(0))
        hi.append(own.max(0))
        spread = hi[-1] - lo[-1]
        if b - a > leaf and spread.max() > 0:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, int(spread.argmax())], half)]
            nodes[i][2] = len(nodes)
            nodes += [[a, a + half, -1], [a + half, b, -1]]
        i += 1
    return order, np.array(nodes, np.int64), np.array(lo), np.array(hi)


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; beyond that range the nearest long."""
    most = np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ m.T).astype(np.int64)
    exact = [[min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), -LONG), LONG - 1) for b in m] for a in q]
    return np.array(exact, np.int64).reshape(len(q), len(m))


def merge(score, ids, rows, new_score, new_ids, k):
    """Keep the best k of each row: larger scores, then smaller ids."""
    s, i = np.concatenate([score[rows], new_score], 1), np.concatenate([ids[rows], new_ids], 1)
    o = np.lexsort((i, -s.astype(np.float64) if np.abs(s).max(initial=0) < 2**53 else ~s), axis=-1)[:, :k]
    score[rows], ids[rows] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)


NONE = -(2**62) * 2  # no candidate yet


def search(q, q_ids, best, best_ids, floor, m, ids, tree, lo, hi, k) -> None:
    """Improve (best, best_ids) of a block of queries with one shard, best boxes first.

    ``floor`` holds scores that each query's kth is known to reach.
    """
    plus, minus, order = np.maximum(q, 0), np.minimum(q, 0), count()

    def bound(node, rows):
        x = plus[rows] @ hi[node] + minus[rows] @ lo[node]
        return x + np.abs(x) * 1e-9 + 1e-6  # rounding of doubles never hides a box

    rows = np.arange(len(q))
    b = bound(0, rows)
    heap = [(-b.max(), next(order), 0, rows, b)]
    while heap:
        _, _, node, rows, b = heapq.heappop(heap)
        # a query without k candidates goes on; equal bounds can hold a smaller id
        rows = rows[b >= np.maximum(best[rows, -1], floor[rows]).astype(np.float64)]
        if not len(rows):
            continue
        start, end, child = tree[node]
        if child >= 0:
            for c in (child, child + 1):
                b = bound(c, rows)
                heapq.heappush(heap, (-b.max(), next(order), int(c), rows, b))
            continue
        part = slice(start, end)
        got = products(q[rows], m[part])
        own = np.broadcast_to(ids[part], got.shape)
        got = np.where(own == q_ids[rows][:, None], NONE, got)
        use = got.max(1) >= np.maximum(best[rows, -1], floor[rows])
        if use.any():
            merge(best, best_ids, rows[use], got[use], own[use], k)


def blocks(df: DataFrame, ids: str, vectors: str, rows: int, scale: float, leaf: int | None) -> DataFrame:
    """Pack the usable rows of each partition into blocks of at most ``rows``, as trees if ``leaf``."""

    def pack(batches):
        held: dict[int, list] = {}

        def emit(d, keys, m):
            if leaf:
                order, tree, lo, hi = build(m, leaf)
                keys, m = keys[order], m[order]
            else:
                tree, lo, hi = np.zeros((0, 3), np.int64), m[:0], m[:0]
            raw = [x.tobytes() for x in (keys, m, tree, lo, hi)]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(keys)], pa.int32()), *[pa.array([x], pa.binary()) for x in raw]], names=["dim", "n", "ids", "comps", "tree", "lo", "hi"])

        for b in batches:
            for d, keys, m in usable(b, ids, vectors):
                m = quantize(m, scale)
                if d in held:
                    keys, m = np.concatenate([held[d][0], keys]), np.concatenate([held[d][1], m])
                while len(keys) >= rows:
                    yield emit(d, keys[:rows], m[:rows])
                    keys, m = keys[rows:], m[rows:]
                held[d] = [keys, m]
        for d, (keys, m) in held.items():
            if len(keys):
                yield emit(d, keys, m)

    return df.select(F.col(ids).cast("long").alias(ids), F.col(vectors).cast("array<double>").alias(vectors)).mapInArrow(pack, SHARD)


MEET = "g int, h int, kind int, block bigint, dim int, n int, ids binary, comps binary, tree binary, lo binary, hi binary, floor binary"


def meet(asked: DataFrame, shards: DataFrame, k: int, ids: str, g: int, h: int) -> DataFrame:
    """(block, row, query_id, id, score): the best ``k`` of each query in each of ``g`` groups of shards.

    Blocks of queries are dealt to ``h`` groups. A task holds the blocks of its group, with
    their best rows, and the shards of its group pass by one after another.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(every(g).alias("g"), F.pmod(F.xxhash64("block"), F.lit(h)).cast("int").alias("h"), F.lit(0).alias("kind"), "block", "dim", "n", "ids", "comps", "tree", "lo", "hi", "floor")
    right = shards.select(F.pmod(F.xxhash64("shard"), F.lit(g)).cast("int").alias("g"), every(h).alias("h"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), "dim", "n", "ids", "comps", "tree", "lo", "hi", F.lit(None).cast("binary").alias("floor"))
    rows = left.unionByName(right).repartition(g * h, "g", "h").sortWithinPartitions("g", "h", "kind")

    def run(batches):
        now, held = None, []

        def out():
            for block, _, _, q_ids, best, best_ids, floor in held:
                r, c = np.nonzero((best > NONE) & (best >= floor[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), block)), pa.array(r.astype(np.int32)), pa.array(q_ids[r]), pa.array(best_ids[r, c]), pa.array(best[r, c])], names=["block", "row", "query_id", ids, "score"])

        for b in batches:
            for i in range(b.num_rows):  # one row at a time: each is a large one
                x = b.slice(i, 1).to_pylist()[0]
                if (x["g"], x["h"]) != now:
                    yield from out()
                    now, held = (x["g"], x["h"]), []
                own = np.frombuffer(x["ids"], np.int64)
                m = np.frombuffer(x["comps"], np.float64).reshape(x["n"], x["dim"])
                if x["kind"] == 0:
                    floor = np.full(len(own), NONE, np.int64) if x["floor"] is None else np.frombuffer(x["floor"], np.int64)
                    held.append((x["block"], x["dim"], m, own, np.full((len(own), k), NONE, np.int64), np.full((len(own), k), LONG - 1, np.int64), floor))
                    continue
                tree = np.frombuffer(x["tree"], np.int64).reshape(-1, 3)
                lo, hi = (np.frombuffer(x[e], np.float64).reshape(-1, x["dim"]) for e in ("lo", "hi"))
                for _, dim, q, q_ids, best, best_ids, floor in held:
                    if dim == x["dim"]:
                        search(q, q_ids, best, best_ids, floor, m, own, tree, lo, hi, k)
        yield from out()

    return rows.mapInArrow(run, f"block bigint, row int, query_id bigint, {ids} bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, store: Store, k: int = 20, scale: float = 64.0, ids: str = "vec_id", vector: str = "embedding", shard_rows: int = 2048, query_rows: int = 512, most_blocks: int = 128, leaf: int = 64) -> DataFrame:
    """Each query's ``k`` rows of largest inner product with a different id: query_id, rank, id, score.

    A task holds ``most_blocks`` blocks of queries or so.
    """
    shards = store.put(blocks(vectors, ids, vector, shard_rows, scale, leaf).withColumn("shard", F.monotonically_increasing_id()), "shards")
    asked = store.put(blocks(queries, ids, vector, query_rows, scale, None).withColumn("block", F.monotonically_increasing_id()).withColumn("floor", F.lit(None).cast("binary")), "queries")
    tasks = max(1, 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    n_blocks, n_shards = max(1, asked.count()), max(1, shards.count())
    h = max(min(n_blocks, round(tasks**0.5)), -(-n_blocks // most_blocks))
    g = max(1, min(n_shards, -(-tasks // h)))
    # a first shard of every dimension says what each query's kth score is at least
    some = shards.join(F.broadcast(shards.groupBy("dim").agg(F.min_by("shard", F.struct(-F.col("n"), "shard")).alias("shard")).select("shard")), "shard", "left_semi")
    first = meet(asked, some, k, ids, 1, h).groupBy("block", "row").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    floors = first.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", "kth"))).alias("kths"))  # at most one entry per query of a block
    floors = store.put(floors, "floors")

    names, schema = asked.columns, asked.schema

    def stated(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1)
                row = x.select(["n", "kths"]).to_pylist()[0]
                floor = np.full(row["n"], NONE, np.int64)
                for y in row["kths"] or ():
                    floor[y["row"]] = y["kth"]
                at = x.schema.get_field_index("floor")
                yield x.set_column(at, "floor", pa.array([floor.tobytes()], pa.binary())).select(names)

    known = store.put(asked.join(floors, "block", "left").mapInArrow(stated, schema), "queries")
    found = meet(known, shards, k, ids, g, h)
    w = Window.partitionBy("block", "row").orderBy(F.desc("score"), ids)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", ids, "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each row whose vec_id is divisible by 20.

    Rows with a null id or a null, empty or non-finite vector take no part. Rows that
    share the query's vec_id are the query's own; only vectors of the query's length
    are compared; a query row that is repeated gives its result as often. Equal scores go
    to smaller ids. An empty table gives no rows; other columns are not read.
    """
    e = session(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(e, e.where("vec_id % 20 = 0"), Store(spark), k=20)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Hard negatives by a full score sort of each anchor.

Vectors lie in shards of bounded size, sorted by id; blocks of anchors meet all shards,
once to find each anchor's positives and once to read its negatives. In each shard an anchor's
integer scores are sorted by score and id; a binary search finds where a positive's
upper limit begins, and the next different-label entries down to its lower limit are read. What a shard
gives is merged into the best few of each positive at once, so that an anchor hands on a few rows
for each group of shards, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Store, session
from .topk import LONG, NONE, merge, products, quantize

SHARD = "dim int, n int, ids binary, labels binary, comps binary"
FOUND = "block bigint, row int, of int, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


def floored(score: np.ndarray, numerator: int) -> np.ndarray:
    """floor(score * numerator / 10) without leaving 64 bits."""
    return score // 10 * numerator + score % 10 * numerator // 10


def limits(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole score s with low * score <= 10 * s <= high * score."""
    return -floored(-score, low), floored(score, high)


def blocks(df: DataFrame, ids: str, vectors: str, label: str, rows: int, scale: float) -> DataFrame:
    """Usable rows of each partition, at most ``rows`` to a block of one length, sorted by id."""

    def pack(batches):
        held: dict[int, list[np.ndarray]] = {}

        def emit(d, keys, labels, m):
            o = np.argsort(keys, kind="stable")
            raw = [keys[o].tobytes(), labels[o].tobytes(), m[o].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(keys)], pa.int32()), *[pa.array([x], pa.binary()) for x in raw]], names=["dim", "n", "ids", "labels", "comps"])

        for b in batches:
            col, size = b.column(2), np.diff(np.asarray(b.column(2).offsets))
            flat, at = np.asarray(col.values.fill_null(np.nan)), np.asarray(col.offsets)
            keys, labels = np.asarray(b.column(0)), np.asarray(b.column(1))
            for d in map(int, np.unique(size[size > 0])):
                rows_of = np.flatnonzero(size == d)
                m = flat[at[rows_of][:, None] + np.arange(d)]
                ok = np.isfinite(m).all(1)
                new = [keys[rows_of[ok]], labels[rows_of[ok]], quantize(m[ok], scale)]
                if d in held:
                    new = [np.concatenate(x) for x in zip(held[d], new, strict=True)]
                while len(new[0]) >= rows:
                    yield emit(d, *[x[:rows] for x in new])
                    new = [x[rows:] for x in new]
                held[d] = new
        for d, own in held.items():
            if len(own[0]):
                yield emit(d, *own)

    rows_in = df.where(F.col(ids).isNotNull() & F.col(label).isNotNull() & F.col(vectors).isNotNull())
    return rows_in.select(F.col(ids).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vectors).cast("array<double>").alias("vector")).mapInArrow(pack, SHARD)


class Anchors:
    """A block of anchors and the best rows found for each of its slots; a slot is an anchor, or one positive of an anchor."""

    def __init__(self, x: dict, most: int):
        self.block, self.dim = x["block"], x["dim"]
        self.ids, self.labels = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64)
        self.m = np.frombuffer(x["comps"], np.float64).reshape(x["n"], x["dim"])
        given = x["positives"]
        if given is None:
            row, pos, score = np.arange(len(self.ids)), np.full(len(self.ids), -1), np.zeros(len(self.ids), np.int64)
        else:
            row, pos, score = (np.array([g[k] for g in given], np.int64) for k in ("row", "id", "score"))
        self.row, self.pos, self.score, self.positives = row, pos, score, given is None
        self.of = np.arange(len(row)) - np.searchsorted(row, row)  # slots are in order of their rows
        self.best, self.best_ids = np.full((len(row), most), NONE, np.int64), np.full((len(row), most), LONG - 1, np.int64)

    def meet(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, low: int, high: int) -> None:
        """Sort each anchor's scores of one shard, by score and then id, and merge what its slots may take."""
        if not len(self.row):
            return
        most, used = self.best.shape[1], np.unique(self.row)
        got = products(self.m[used], m)
        order = np.argsort(~got, axis=1, kind="stable")  # the shard is sorted by id; ~ turns the order without overflow
        found, found_ids = np.full(self.best.shape, NONE, np.int64), np.full(self.best.shape, LONG - 1, np.int64)
        first = np.searchsorted(self.row, used)
        for i, (r, slot) in enumerate(zip(used.tolist(), first.tolist(), strict=True)):
            o, s = order[i], got[i][order[i]]
            same = labels[o] == self.labels[r]
            if self.positives:
                keep = np.flatnonzero(same & (ids[o] != self.ids[r]))[:most]
                found[slot, : len(keep)], found_ids[slot, : len(keep)] = s[keep], ids[o[keep]]
                continue
            o, s = o[~same], s[~same]
            while slot < len(self.row) and self.row[slot] == r:
                least, top = (int(x) for x in limits(self.score[slot], low, high))
                at = int(np.searchsorted(~s, ~top))
                own = s[at : at + most]
                k = int((own >= least).sum())
                found[slot, :k], found_ids[slot, :k] = own[:k], ids[o[at : at + k]]
                slot += 1
        use = np.flatnonzero((found[:, 0] > NONE) & (found[:, 0] >= self.best[:, -1]))
        if len(use):
            merge(self.best, self.best_ids, use, found[use], found_ids[use], most)

    def rows(self) -> pa.RecordBatch:
        s, c = np.nonzero(self.best > NONE)
        row = self.row[s]
        cols = [np.full(len(s), self.block), row.astype(np.int32), self.of[s].astype(np.int32), self.ids[row], self.pos[s], self.score[s], self.best_ids[s, c], self.best[s, c]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in FOUND.split(", ")])


def meet(asked: DataFrame, shards: DataFrame, g: int, h: int, most: int, low: int = 0, high: int = 0) -> DataFrame:
    """The best ``most`` rows of each slot in each of ``g`` groups of shards; blocks of anchors are dealt to ``h`` groups."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = dict(asked.dtypes)["positives"]
    left = asked.select(every(g).alias("g"), F.pmod(F.xxhash64("block"), F.lit(h)).cast("int").alias("h"), F.lit(0).alias("kind"), "block", "dim", "n", "ids", "labels", "comps", "positives")
    right = shards.select(F.pmod(F.xxhash64("shard"), F.lit(g)).cast("int").alias("g"), every(h).alias("h"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), "dim", "n", "ids", "labels", "comps", F.lit(None).cast(kind).alias("positives"))
    rows = left.unionByName(right).repartition(g * h, "g", "h").sortWithinPartitions("g", "h", "kind")

    def run(batches):
        now, held = None, []
        for b in batches:
            for i in range(b.num_rows):  # one row at a time: each is a large one
                x = b.slice(i, 1).to_pylist()[0]
                if (x["g"], x["h"]) != now:
                    for a in held:
                        yield a.rows()
                    now, held = (x["g"], x["h"]), []
                if x["kind"] == 0:
                    held.append(Anchors(x, most))
                    continue
                ids, labels = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64)
                m = np.frombuffer(x["comps"], np.float64).reshape(x["n"], x["dim"])
                for a in held:
                    if a.dim == x["dim"]:
                        a.meet(ids, labels, m, low, high)
        for a in held:
            yield a.rows()

    return rows.mapInArrow(run, FOUND)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, store: Store, positives: int = 5, k: int = 10, low: int = 3, high: int = 9, scale: float = 256.0, ids: str = "vec_id", vector: str = "embedding", label: str = "label", shard_rows: int = 2048, anchor_rows: int = 512, most_blocks: int = 64) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A positive is one of the anchor's ``positives`` best rows of its label; its negatives are the ``k``
    best rows of other labels whose score is between ``low`` and ``high`` tenths of the positive's. Rows with
    a null id, label or vector, an empty vector, or a null or non-finite component take no part.
    Rows that share the anchor's id are the anchor's own; only vectors of the anchor's length are compared.
    Repeated rows are rows of their own: a repeated anchor gives its result as often, a repeated positive its negatives
    as often. Ties go to smaller ids. An anchor without positives, and a positive with a score
    below zero (its limits exclude each other), give no rows; so does an empty table. Other columns are not read.
    """
    shards = store.put(blocks(vectors, ids, vector, label, shard_rows, scale).withColumn("shard", F.monotonically_increasing_id()), "shards")
    asked = store.put(blocks(anchors, ids, vector, label, anchor_rows, scale).withColumn("block", F.monotonically_increasing_id()), "anchors")
    tasks = max(1, 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    n_blocks, n_shards = max(1, asked.count()), max(1, shards.count())
    h = max(min(n_blocks, round(tasks**0.5)), -(-n_blocks // most_blocks))
    g = max(1, min(n_shards, -(-tasks // h)))
    slots = "array<struct<row:int,id:bigint,score:bigint>>"
    near = meet(asked.withColumn("positives", F.lit(None).cast(slots)), shards, g, h, positives)
    best = Window.partitionBy("block", "row").orderBy(F.desc("score"), "id")
    near = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives)
    given = near.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", "at", "id", "score"))).alias("positives"))  # a few entries for each anchor of a block
    given = given.select("block", F.transform("positives", lambda p: F.struct(p["row"].alias("row"), p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    known = store.put(asked.join(given, "block"), "positives")
    found = meet(known, shards, g, h, k, low, high)
    best = Window.partitionBy("block", "row", "of").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten negatives for each of the five positives of rows whose vec_id is divisible by 100; every seventh label is moved on by one first."""
    e = session(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(e, e.where("vec_id % 100 = 0"), Store(spark))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS c
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.c) = len(b.c) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INT) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

"""A stored vector index with an exact finish.

Unit vectors are dealt to the cell of their nearest centroid; centroids come from a bounded
sample of the first rows added and stay. A cell knows how near to and how far from its centroid its rows lie, so
that by the triangle inequality no row of it can be nearer to a query than a bound.
A query is first compared with the rows of its nearest cells; the kth distance found turns away
every cell whose bound is larger. What is left is compared row by row, so that the result
is that of a full scan. Rows are added and deleted by versions, as in ``lexical``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.versions import Versions

FEW = 200_000
SLACK = 1e-9  # rounding of distances never hides a row


def units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, unit vectors) of the rows of (key, vector) that have a direction."""
    col = batch.column(1)
    at, flat = np.asarray(col.offsets), np.asarray(col.values.fill_null(np.nan))
    size = np.diff(at)
    if not len(size) or not size.any():
        return np.zeros(0, np.int64), np.zeros((0, 0))
    d = int(size.max())
    rows = np.flatnonzero(size == d)
    m = flat[at[rows][:, None] + np.arange(d)]
    norm = np.sqrt((m * m).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return np.asarray(batch.column(0))[rows[ok]].astype(np.int64), m[ok] / norm[ok, None]


def apart(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all rows of both."""
    return np.sqrt(np.maximum((m * m).sum(1)[:, None] + (centres * centres).sum(1) - 2 * m @ centres.T, 0))


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Means of alike rows; an empty cell takes the row that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        d = apart(sample, centres)
        own = d.argmin(1)
        for c in range(len(centres)):
            mine = own == c
            if mine.any():
                centres[c] = sample[mine].mean(0)
            else:
                far = int(d[np.arange(len(sample)), own].argmax())
                centres[c], own[far] = sample[far], c
    return centres


class VectorIndex:
    """Nearest neighbours by cosine distance.

    Keys are whole numbers and unique. Vectors have one length; those without a direction (null,
    empty, of zero length, or with a null or non-finite component) take no part. ``fit_rows`` bounds the sample that centroids are fitted on, ``most_cells`` their number.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, vector: str, fit_rows: int = 20_000, most_cells: int = 2048):
        self.spark, self.key, self.vector, self.fit_rows, self.most_cells = spark, key, vector, fit_rows, most_cells
        self.versions = Versions(spark, folder)
        self.folder = self.versions.folder

    def state(self) -> dict:
        return self.versions.latest() or {"version": -1, "centres": None, "segments": [], "dead": [], "batches": {}}

    def plain(self, rows: DataFrame) -> DataFrame:
        ok = F.col(self.key).isNotNull() & F.col(self.vector).isNotNull()
        return rows.where(ok).select(F.col(self.key).cast("long").alias("key"), F.col(self.vector).cast("array<double>").alias("vector"))

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> bool:
        """One version without the rows of ``removed`` keys and with ``added`` rows in place of those of the same key; a batch that has been applied changes nothing."""
        state = self.state()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        dead, segments, centres = list(state["dead"]), list(state["segments"]), state["centres"]
        keys = [d.select(F.col(self.key).cast("long").alias("key")) for d in (added, removed) if d is not None]
        if segments and keys:
            name = self.versions.new("dead")
            reduce(DataFrame.unionByName, keys).where("key is not null").distinct().write.parquet(f"{self.folder}/{name}")
            n = self.spark.read.parquet(f"{self.folder}/{name}").count()
            if n:
                dead.append({"name": name, "rows": n, "before": len(segments)})
        if added is not None:
            rows = self.plain(added)
            if centres is None:
                centres = self.fit(rows)
            if centres is not None:
                segments.append(self.write(rows, centres))
        self.versions.commit(state | {"centres": centres, "segments": segments, "dead": dead, "batches": state["batches"] | ({batch[0]: batch[1]} if batch else {})})
        return True

    def fit(self, rows: DataFrame) -> list | None:
        n = rows.count()
        sample = rows.sample(min(1.0, 1.2 * self.fit_rows / n), seed=1).limit(self.fit_rows) if n else rows
        own = [units(b) for b in sample.toArrow().to_batches()] if n else []
        own = [m for _, m in own if len(m)]
        if not own:
            return None
        name = self.versions.new("centres")
        m = centroids(np.concatenate(own), max(1, min(self.most_cells, math.isqrt(n))))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(m)], "cell int, centre array<double>").write.parquet(f"{self.folder}/{name}")
        return [name, int(m.shape[0])]

    def centres(self, state: dict) -> np.ndarray:
        """At most ``most_cells`` rows."""
        rows = self.spark.read.parquet(f"{self.folder}/{state['centres'][0]}").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows])

    def write(self, rows: DataFrame, centres: list) -> dict:
        name = self.versions.new("segment")
        m = self.centres({"centres": centres})

        def place(batches):
            for b in batches:
                keys, unit = units(b)
                if len(keys):
                    d = apart(unit, m)
                    cell = d.argmin(1)
                    at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * unit.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(keys), pa.array(d[np.arange(len(keys)), cell]), pa.ListArray.from_arrays(at, pa.array(unit.ravel()))], names=["cell", "key", "off", "unit"])

        placed = rows.mapInArrow(place, "cell int, key bigint, off double, unit array<double>")
        # a large cell goes to several tasks
        placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("cell").write.option("compression", "zstd").parquet(f"{self.folder}/{name}/rows")
        own = self.spark.read.parquet(f"{self.folder}/{name}/rows")
        own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("least"), F.max("off").alias("most")).coalesce(1).write.parquet(f"{self.folder}/{name}/cells")
        return {"name": name, "rows": int(own.count())}

    def rows(self, state: dict) -> DataFrame:
        """(cell, key, unit) of live rows."""
        parts = []
        for i, s in enumerate(state["segments"]):
            own = self.spark.read.parquet(f"{self.folder}/{s['name']}/rows").select("cell", "key", "unit")
            later = [d for d in state["dead"] if d["before"] > i]
            if later:
                gone = self.spark.read.parquet(*[f"{self.folder}/{d['name']}" for d in later]).distinct()
                own = own.join(F.broadcast(gone) if sum(d["rows"] for d in later) <= FEW else gone, "key", "left_anti")
            parts.append(own.select("cell", "key", "unit"))
        return reduce(DataFrame.unionByName, parts)

    def compact(self) -> bool:
        """One segment without deleted rows, its centroids fitted anew."""
        state = self.state()
        if len(state["segments"]) < 2 and not state["dead"]:
            return False
        rows = self.rows(state).select("key", F.col("unit").alias("vector"))
        centres = self.fit(rows)
        self.versions.commit(state | {"centres": centres, "segments": [self.write(rows, centres)] if centres else [], "dead": []})
        return True

    def clean(self) -> list[str]:
        """Delete what the latest version does not name. Nobody may be reading or writing."""
        s = self.state()
        return self.versions.clean({x["name"] for x in [*s["segments"], *s["dead"]]} | set((s["centres"] or [])[:1]))

    def cells(self, state: dict) -> np.ndarray:
        """Rows (cell, n, least, most distance from the centroid) over all segments; deleted rows only make the bounds wider."""
        c = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/{s['name']}/cells") for s in state["segments"]])
        rows = c.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()  # one row a cell
        return np.array(sorted((r["cell"], r["n"], r["least"], r["most"]) for r in rows), np.float64).reshape(-1, 4)

    def wanted(self, queries: DataFrame, state: dict, cells: np.ndarray, first: int | None) -> DataFrame:
        """(query, cell, unit, kth): each query's ``first`` nearest cells, or those that its kth distance leaves without them."""
        m = self.centres(state)[cells[:, 0].astype(int)]
        names, least, most = cells[:, 0].astype(np.int32), cells[:, 2], cells[:, 3]

        def run(batches):
            for b in batches:
                keys, unit = units(b)
                if not len(keys):
                    continue
                d = apart(unit, m)
                bound = np.maximum(np.maximum(d - most, least - d), 0)
                if first is not None:
                    order = np.argsort(bound + d * 1e-6, axis=1, kind="stable")[:, :first]
                    q, c = np.repeat(np.arange(len(keys)), order.shape[1]), order.ravel()
                    kth = np.full(len(q), np.inf)
                else:
                    own = dict(zip(np.asarray(b.column(0)).tolist(), np.asarray(b.column(2)).tolist(), strict=True))
                    limit = np.array([own[k] for k in keys.tolist()])
                    # squared distance of unit vectors is twice their cosine distance
                    q, c = np.nonzero(bound <= np.sqrt(np.maximum(2 * (limit + SLACK), 0))[:, None] + SLACK)
                    kth = limit[q]
                at = pa.array(np.arange(len(q) + 1, dtype=np.int32) * unit.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(names[c]), pa.ListArray.from_arrays(at, pa.array(unit[q].ravel())), pa.array(kth)], names=["query", "cell", "unit", "kth"])

        return queries.mapInArrow(run, "query bigint, cell int, unit array<double>, kth double")

    def nearest(self, pairs: DataFrame, rows: DataFrame, k: int, own: bool, block: int = 512) -> DataFrame:
        """(query, key, distance): the best ``k`` rows of the cells that each query wants.

        Queries of a cell are packed in blocks, which each meet the cell's rows once; rows of
        a cell are dealt to slots, so that no cell is one task's.
        """
        n = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(n, "cell").select("cell", F.ceil(F.col("q") / block).cast("int").alias("blocks"), F.ceil(F.col("n") / 8192).cast("int").alias("slots"))
        sizes = F.broadcast(sizes)  # one row a cell
        asked = pairs.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks"))).groupBy("cell", "slots", "block").agg(F.collect_list(F.struct("query", "unit", "kth")).alias("qs"))
        asked = asked.select(F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("s"), "qs")
        dealt = rows.join(sizes, "cell").withColumn("slot", F.pmod(F.xxhash64("key"), F.col("slots")).cast("int")).groupBy("cell", "slot").agg(F.collect_list(F.struct("key", "unit")).alias("rs"))
        met = dealt.join(asked, (F.col("cell") == F.col("c")) & (F.col("slot") == F.col("s"))).select("rs", "qs")

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    rs, qs = b.column(0)[i].values, b.column(1)[i].values
                    keys, m = np.asarray(rs.field("key")), matrix(rs.field("unit"))
                    ids, q, kth = np.asarray(qs.field("query")), matrix(qs.field("unit")), np.asarray(qs.field("kth"))
                    out = []
                    for j in range(len(ids)):
                        # row by row in one order, so that equal rows have equal distances
                        d = 1 - np.einsum("ij,j->i", m, q[j])
                        use = np.flatnonzero((d <= kth[j] + SLACK) & ((keys != ids[j]) | own))
                        best = use[np.lexsort((keys[use], d[use]))[:k]]
                        out.append((np.full(len(best), ids[j]), keys[best], d[best]))
                    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], names=["query", "key", "distance"])

        found = met.mapInArrow(run, "query bigint, key bigint, distance double")
        w = Window.partitionBy("query").orderBy("distance", "key")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, first: int = 2, own: bool = False) -> DataFrame:
        """(query, key, distance, rank), exact: the ``k`` nearest rows of each query (key, vector), ties to smaller keys. ``own``: a row of the query's key counts."""
        state, q = self.state(), self.plain(queries)
        if not state["segments"]:
            return self.spark.createDataFrame([], f"query bigint, {self.key} bigint, distance double, rank int")
        cells, rows = self.cells(state), self.rows(state)
        limits = self.limits(q, state, cells, rows, k, first, own)
        found = self.nearest(self.wanted(limits, state, cells, None), rows, k, own)
        return found.select("query", F.col("key").alias(self.key), "distance", "rank")

    def limits(self, q: DataFrame, state: dict, cells: np.ndarray, rows: DataFrame, k: int, first: int, own: bool) -> DataFrame:
        """(key, vector, kth): a distance within which each query has ``k`` rows; infinite where its first cells hold fewer."""
        near = self.nearest(self.wanted(q, state, cells, first), rows, k, own).where(F.col("rank") == k).select(F.col("query").alias("key"), F.col("distance").alias("kth"))
        return q.join(near, "key", "left").select("key", "vector", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))


def matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten())
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)

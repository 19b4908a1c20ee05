"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors are quantized to whole numbers and kept as blocks in the shared folder. The
covariance is never formed: each Spark pass multiplies a block of directions Q by it as
X'(XQ)/n on rows centred before multiplying, QR keeps the block orthonormal, and a small
Rayleigh-Ritz problem turns it towards the eigenvectors. Passes end when the residuals of
all wanted components certify them. A block that converges too slowly is made wider,
up to the dimension, where one pass is exact. The driver holds matrices of dimension
times block width only; partial products are added up on Spark first.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Store, session
from .topk import usable

BLOCK = "dim int, n int, ids binary, comps binary"
ADDERS = 16  # tasks that add up partial products; the driver adds their sums
DEVIATION = "decimal(38,0)"


def blocks(df: DataFrame, ids: str, vectors: str, rows: int, scale: float, shift: int) -> DataFrame:
    """Quantized vectors of each partition, ``rows`` at the most to a block of one length."""

    def pack(batches):
        for b in batches:
            for d, keys, m in usable(b, ids, vectors):
                x = np.floor(scale * m).astype(np.int64) + shift
                for i in range(0, len(keys), rows):
                    raw = [keys[i : i + rows].tobytes(), x[i : i + rows].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(raw[0]) // 8], pa.int32()), *[pa.array([r], pa.binary()) for r in raw]], names=["dim", "n", "ids", "comps"])

    return df.select(F.col(ids).cast("long").alias(ids), F.col(vectors).cast("array<double>").alias(vectors)).mapInArrow(pack, BLOCK)


def opened(batches):
    """(ids, matrix) of every block."""
    for b in batches:
        for r in b.to_pylist():
            yield np.frombuffer(r["ids"], np.int64), np.frombuffer(r["comps"], np.int64).reshape(r["n"], r["dim"])


def added(staged: DataFrame, one, shape: tuple[int, ...], dtype=np.float64) -> np.ndarray:
    """The sum of ``one(ids, matrix)`` over all blocks: per task, then in a few adding tasks, then here."""
    kind = np.dtype(dtype)

    def total(parts):
        s = np.zeros(shape, kind)
        for p in parts:
            s += p
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["part"])

    each = staged.mapInArrow(lambda batches: total(one(i, m) for i, m in opened(batches)), "part binary")
    few = each.repartition(ADDERS).mapInArrow(lambda batches: total(np.frombuffer(r, kind).reshape(shape) for b in batches for r in b.column(0).to_pylist()), "part binary")
    return sum((np.frombuffer(r["part"], kind).reshape(shape) for r in few.collect()), np.zeros(shape, kind))  # ADDERS rows


class Spectrum:
    """Leading eigenpairs of the covariance of the staged rows."""

    def __init__(self, n: int, sums: np.ndarray, trace: float, values: np.ndarray, vectors: np.ndarray, residuals: np.ndarray, passes: int):
        self.n, self.sums, self.trace, self.values, self.vectors, self.residuals, self.passes = n, sums, trace, values, vectors, residuals, passes


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with one rounding, as n * x - sums is a whole number."""
    if int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)) < 2**63:
        return (n * x - sums) / float(n)
    return np.array([[float(Decimal(n * int(c) - int(s)) / n) for c, s in zip(r, sums, strict=True)] for r in x]).reshape(x.shape)


def iterate(staged: DataFrame, n: int, sums: np.ndarray, k: int, width: int, tolerance: float, patience: int, seed: int = 7) -> Spectrum:
    """Subspace iteration until ||V u - e u|| <= tolerance * largest e for the first ``k`` components.

    After ``patience`` passes the block is made twice as wide; at full width a pass is exact, so the iteration ends.
    """
    d, rng = len(sums), np.random.default_rng(seed)
    width = min(d, max(width, k))
    q, _ = np.linalg.qr(rng.standard_normal((d, width)))
    trace = float(added(staged, lambda _, x: np.array([(centred(x, n, sums) ** 2).sum()]), (1,))[0]) / n
    passes = since = 0
    while True:

        def product(_, x, q=q):
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        y = added(staged, product, q.shape) / n
        passes, since = passes + 1, since + 1
        small = q.T @ y
        e, s = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-e, kind="stable")
        e, s = e[order], s[:, order]
        u, vu = q @ s, y @ s
        off = np.linalg.norm(vu - u * e, axis=0)
        own = min(k, width)
        if (off[:own] <= tolerance * max(e[0], np.finfo(float).tiny)).all() or width == d and since > 2:
            return Spectrum(n, sums, trace, e[:own], u[:, :own], off[:own], passes)
        if since >= patience and width < d:
            vu = np.concatenate([vu, rng.standard_normal((d, min(d, 2 * width) - width))], 1)
            width, since = vu.shape[1], 0
        q, _ = np.linalg.qr(vu)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[Decimal]:
    """Each row's exact sum of (n * x - sums) ** 2."""
    if int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)) < 2**63:
        y = n * x - sums
        if float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2**62:
            return list(map(Decimal, (y * y).sum(1).tolist()))
    return [Decimal(sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True))) for r in x]


def whiten(vectors: DataFrame, store: Store, k: int = 32, scale: float = 64.0, shift: int = 1_000_000, ids: str = "vec_id", vector: str = "embedding", width: int | None = None, tolerance: float = 1e-12, patience: int = 8, rows: int = 4096, least: float = 1e-12) -> tuple[DataFrame, Spectrum | None, float]:
    """(rows, spectrum, identity error): every usable vector projected on up to ``k`` whitened components.

    Rows are ids, ``n``, the exact squared ``deviation`` (a decimal) and ``whitened``, an array
    with one entry a component. Rows with a null id, or a null, empty or partly null or
    non-finite vector take no part. A covariance needs one length: if vectors differ in
    length, those of the most frequent length take part (the longer one in a tie). Repeated rows count
    as often as they stand there. Components whose eigenvalue is at most ``least`` of the
    largest have no direction of their own and are left out, so that a table of equal rows, or of
    one row, gives no component (an empty array). An empty table gives no rows. Equal eigenvalues: any orthonormal basis.
    """
    staged = store.put(blocks(vectors, ids, vector, rows, scale, shift), "vectors")
    sizes = staged.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    names = f"{ids} bigint, n bigint, deviation {DEVIATION}, whitened array<double>"
    if not sizes:
        return staged.sparkSession.createDataFrame([], names), None, 0.0
    d, n = int(sizes[0]["dim"]), int(sizes[0]["n"])
    staged = staged.where(F.col("dim") == d)
    sums = added(staged, lambda _, x: x.sum(0), (d,), np.int64)
    found = iterate(staged, n, sums, min(k, d), width or 2 * k, tolerance, patience)
    kept = (found.values > least * max(found.values[0], 0)) & (found.values > 0)
    turn = found.vectors[:, kept] / np.sqrt(found.values[kept])
    c = turn.shape[1]

    def moments(_, x):
        z = centred(x, n, sums) @ turn
        return np.concatenate([z.sum(0, keepdims=True), z.T @ z])

    error = 0.0
    if c:
        m = added(staged, moments, (c + 1, c)) / n
        error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(c)).max())

    def project(batches):
        for keys, x in opened(batches):
            z = centred(x, n, sums) @ turn
            at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * c)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), n)), pa.array(deviations(x, n, sums), pa.decimal128(38, 0)), pa.ListArray.from_arrays(at, pa.array(z.ravel()))], names=[ids, "n", "deviation", "whitened"])

    return staged.mapInArrow(project, names), found, error


def components(rows: DataFrame, spectrum: Spectrum | None, ids: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1, with the share of variance it explains."""
    share = [float(e / spectrum.trace) for e in spectrum.values] if spectrum is not None and spectrum.trace > 0 else []
    explained: Column = F.array(*map(F.lit, share)) if share else F.array().cast("array<double>")
    out = rows.select(ids, "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(ids, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector's first 32 whitened components. A deviation beyond a long is null (from some millions of rows on); the operator's decimal holds it."""
    e = session(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows, spectrum, error = whiten(e, Store(spark))
    out = components(rows, spectrum)
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))

"""The stored vector index against a full scan."""

import numpy as np

from stratiform.operators import retrieve
from stratiform.operators.vectors import VectorIndex


def frame(spark, m):
    return spark.createDataFrame([(int(k), [float(x) for x in v] if v is not None else None) for k, v in sorted(m.items())], "k long, v array<float>")


def best(m, k, queries):
    keys = sorted(m)
    u = {i: np.float32(m[i]).astype(float) / np.linalg.norm(np.float32(m[i]).astype(float)) for i in keys}
    out = {}
    for q in queries:
        d = sorted((round(1 - float(u[i] @ u[q]), 9), i) for i in keys if i != q)
        out[q] = d[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((round(r.distance, 9), r.k))
    return out


def test_any_sequence_equals_a_full_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 4
    draw = lambda n: centres[rng.integers(12, size=n)] + rng.normal(size=(n, 8)) * 0.3
    now = dict(enumerate(draw(400)))
    index = VectorIndex(spark, str(tmp_path / "i"), "k", "v")
    assert index.search(frame(spark, now), 3).count() == 0
    odd = {900: None, 901: [], 902: [0.0] * 8, 903: [float("nan")] * 8}
    index.change(added=frame(spark, now | odd))
    more = dict(zip(range(390, 450), draw(60), strict=True)) | {500: now[0] * 2, 501: now[0]}
    index.change(added=frame(spark, more), batch=("s", 0))
    assert not index.change(added=frame(spark, {0: draw(1)[0]}), batch=("s", 0))
    now |= more
    gone = [3, 7, 500, 10_000]
    index.change(removed=spark.createDataFrame([(k,) for k in gone], "k long"))
    now = {k: v for k, v in now.items() if k not in gone}
    asked = {k: now[k] for k in (0, 1, 2, 55, 200, 395, 449, 501)}
    want = best(now, 5, asked)
    assert got(index.search(frame(spark, asked | odd), 5)) == want
    state = index.state()
    cells, rows, q = index.cells(state), index.rows(state), index.plain(frame(spark, asked))
    pairs = index.wanted(index.limits(q, state, cells, rows, 5, 2, False), state, cells, None)
    sizes = {int(c): int(n) for c, n in cells[:, :2]}
    scored = sum(sizes[r.cell] for r in pairs.collect())
    assert scored < len(asked) * len(now) / 3  # the others are turned away by their bounds
    assert index.compact() and not index.compact() and index.clean()
    assert got(index.search(frame(spark, asked), 5)) == want
    # few rows, more wanted than there are
    assert got(index.search(frame(spark, {0: now[0]}), 1000)) == best(now, 1000, [0])


def test_knn_is_dealt_to_shards(spark):
    rng = np.random.default_rng(2)
    m = dict(enumerate(rng.normal(size=(60, 4))))
    d = frame(spark, m)
    one = retrieve.knn(d, d, "k", "v", 5).orderBy("query", "rank").collect()
    assert retrieve.knn(d, d, "k", "v", 5, block=7, shards=3).orderBy("query", "rank").collect() == one

"""Toxicity recomputed row by row by plain code that shares nothing but the fixed word lists and patterns; very large pages and vectors."""

import math
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from stratiform.llm import registry, topk, toxicity
from stratiform.llm.common import Store

SF = "/root/testdata/sf0.01"


def words_of(text):
    found = set(re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()))
    out = set(found)
    for w in found:
        if len(w) > 5:
            out.add(w[:5] + b"*")
        if len(w) > 7:
            out.add(w[:7] + b"*")
    return out


def plain_scores(docs, labels):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    known = {}
    for i, y in labels:
        if y in (0, 1) and i is not None and not held(i):
            known[i] = max(y, known.get(i, 0))
    count, totals = {}, [0, 0]
    for i, t in docs:
        if i in known:
            totals[known[i]] += 1
            for w in words_of(t):
                count.setdefault(w, [0, 0])[known[i]] += 1
    ratio = lambda c: ((c[1] + 0.5) / (totals[1] + 1)) / ((c[0] + 0.5) / (totals[0] + 1))
    mined = sorted((-c[1] * math.log(ratio(c)), w) for w, c in count.items() if len(w) > 2 and c[1] >= 8 and ratio(c) >= 20)[:256]
    mined = [w for _, w in mined]
    groups = [{w.encode() for w in g} for g in toxicity.LEXICON] + [set(mined[i::8]) for i in range(8)]
    every = set().union(*groups)

    def votes(t):
        t, w = t or "", words_of(t)
        hit = len(every & w)
        loud = t.count("!") >= 3 and len(re.findall(r"\b[A-Z]{4,}\b", t)) >= 3
        return [bool(g & w) for g in groups] + [hit >= 2, hit >= 3, bool(hit) and loud, loud, bool(toxicity.ADDRESS.search(t)), bool(toxicity.MASKED.search(t))]

    v = np.array([votes(t) for _, t in docs], float)
    n = v.shape[1]
    prior = min(max((totals[1] + 1) / (sum(totals) + 10), 1e-4), 0.5)
    mean, cov = v.mean(0), np.cov(v.T, bias=True)
    use = [i for i in range(n) if mean[i] * (1 - mean[i]) > 1e-9]
    strength, free = np.zeros(n), np.ones((n, n), bool)
    for _ in range(2):
        for i in use:
            others = [x for x in use if x != i and free[i][x]]
            got = [math.sqrt(cov[i][j] * cov[i][k] / cov[j][k]) for j, k in combinations(others, 2) if free[j][k] and cov[j][k] > 1e-9 and cov[i][j] > 0 and cov[i][k] > 0]
            if got:
                strength[i] = np.median(got)
        strength = np.array([min(s, 0.98 * math.sqrt(m * (1 - m))) for s, m in zip(strength, mean, strict=True)])
        rest = np.array([max(m * (1 - m) - s * s, 1e-6) for s, m in zip(strength, mean, strict=True)])
        corr = np.clip((cov - np.outer(strength, strength)) / np.sqrt(np.outer(rest, rest)), -1, 1)
        free = np.abs(corr) < 0.25
    gap = strength / math.sqrt(prior * (1 - prior))
    toxic, clean = np.clip(mean + (1 - prior) * gap, 1e-4, 1 - 1e-4), np.clip(mean - prior * gap, 1e-4, 1 - 1e-4)
    weight = [1 / (1 + sum(abs(corr[i][j]) for j in use if j != i and not free[i][j])) if i in use else 0.0 for i in range(n)]

    def posterior(x):
        z = math.log(prior / (1 - prior))
        for i in range(n):
            z += weight[i] * (math.log(toxic[i] / clean[i]) if x[i] else math.log((1 - toxic[i]) / (1 - clean[i])))
        return 1 / (1 + math.exp(-max(-50, min(50, z))))

    def features(t, x):
        out = [zlib.crc32(w) % 2**20 for w in words_of(t)]
        if any(x):
            out += [2**20 + j for j in range(n) if x[j]] + [2**20 + n]
        return out

    sample = {(i, t or ""): (posterior(x), set(features(t, x))) for (i, t), x in zip(docs, v, strict=True) if not held(i)}
    sample = list(sample.values())
    pos, neg = sum(p for p, _ in sample), sum(1 - p for p, _ in sample)
    seen = {}
    for p, f in sample:
        for x in f:
            c = seen.setdefault(x, [0.0, 0.0])
            c[0] += p
            c[1] += 1 - p
    used = sorted(f for f, (a, b) in seen.items() if a >= 8 and ((a + 0.5) / (pos + 1)) / ((b + 0.5) / (neg + 1)) >= 4)
    x = np.array([[float(f in own) for f in used] + [1.0] for _, own in sample])
    y = np.array([p for p, _ in sample])
    share = y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1)
    share /= share.sum()
    w, m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, 301):
        g = x.T @ ((1 / (1 + np.exp(-x @ w)) - y) * share) + 1e-4 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    at = dict(zip(used, w, strict=False))
    return [1 / (1 + math.exp(-max(-50, min(50, w[-1] + sum(at.get(f, 0.0) for f in features(t, row)))))) for (_, t), row in zip(docs, v, strict=True)]


def test_scores_against_plain_code(spark):
    d = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = dict(zip([i for i, _ in d], plain_scores(d, labels), strict=True))
    got = registry.QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(got) == len(d) == len(want)
    assert max(abs(r.score - want[r.doc_id]) for r in got) < 1e-3
    assert all(r.predicted == int(r.score >= 0.7) for r in got) and 0 < sum(r.predicted for r in got) < len(got) / 2


@pytest.mark.parametrize("n", [20_000])
def test_very_long_vectors_of_topk(spark, n):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(9, n))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id < 2"), Store(spark), k=3).collect()
    x = np.floor(64 * m).astype(int)
    for q in (0, 1):
        s = sorted((-int(x[q] @ x[i]), i) for i in range(9) if i != q)[:3]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == s


def test_very_large_pages(spark, tmp_path):
    big = "<p>" + "é words and more words " * 400_000  # some 10 MB
    pages = [(1, "u", big), (2, "u", "small"), (3, "u", big), (4, "u", big + "!")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in registry.QUERIES["op9_warc"](spark, str(tmp_path)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None)}
    assert got[1].payload_bytes == len(big.encode()) and got[4].payload_bytes == len(big.encode()) + 1

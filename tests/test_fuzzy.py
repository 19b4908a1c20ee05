"""Bounds of subsequence scores, and the best rows against a full scan."""

import random

from pyspark.sql import functions as F

from stratiform.operators import fuzzy
from stratiform.operators.ranking import fuzzy as plain

PATTERNS = ["rdg", "Read", "me", "a", "z9", "é_", "İx", "aab", "ｆ", "io"]


def names(n):
    rng = random.Random(8)
    parts = ["read", "Me", "Road", "guide", "x", "_", "-", ".", "é", "İ", "ﬀ", "9", "Ⅷ", "aa", "b", "🐘", "ORG", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def test_bounds_hold(spark):
    own = names(400)
    d = fuzzy.signed(spark.createDataFrame([(i, t) for i, t in enumerate(own)], "k int, t string"), ["t"])
    for p in PATTERNS:
        got = {r.k: r.b for r in d.select("k", fuzzy.bound(F.col("sign_0"), p).alias("b")).collect()}
        for i, t in enumerate(own):
            s = plain(p, t)
            assert s < 0 or (got[i] is not None and got[i] >= s), (p, t, s, got[i])


def test_best_rows_equal_a_full_scan(spark):
    own = names(3000)
    rows = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(own)], "k int, t string, u string")
    d = fuzzy.signed(rows, ["t", "u"])
    for p in PATTERNS:
        want = sorted((-max(a, b + 100 if b >= 0 else -1), t, i) for i, t in enumerate(own) for a, b in [(plain(p, t), plain(p, t[::-1]))] if a >= 0 or b >= 0)[:20]
        got = fuzzy.top(d, p, [("t", 0), ("u", 100)], ["t", "k"], first=40).collect()
        assert [(-r.score, r.t, r.k) for r in got] == want


def test_few_rows_are_verified(spark):
    rng = random.Random(9)
    own = ["".join(rng.choice("abcdefghijklmnop_ ") for _ in range(30)) for _ in range(2000)] + ["read_guide"] * 30
    d = fuzzy.bounded(fuzzy.signed(spark.createDataFrame([(t,) for t in own], "t string"), ["t"]), "ead", [("t", 0)])
    left = d.where(F.col("bound") >= fuzzy.kth(d, "ead", [("t", 0)], 20, 64)).count()
    assert 30 <= left < 400

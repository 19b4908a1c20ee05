"""Chunk reuse in encoding, whitening and hard negatives against brute force."""

import hashlib
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from stratiform.llm import bpe, negatives, packing, registry, whitening
from stratiform.llm.common import Store

SF = "/root/testdata/sf0.001"


def odd_texts():
    rng = random.Random(3)
    letters = ["é", "ä", "́", "İ", "ﬀ", "Ω", "Σ", "中", "文", "🐘", "👩‍👧", "'s", "12", ".", "<|endoftext|>", "<|startoftext|>", "x", "Yz"]
    spaces = [" ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "  "]
    out = ["", " ", "\n\t ", "A" * 3000, "é" * 2000, "é" * 900, "中文字" * 400, "<|endoftext|>" * 60, "🐘" * 500, "word " * 500, " ".join(["same passage of words"] * 40)]
    for n in (1, 5, 40, 400, 1500):
        for share in (0.0, 0.03, 0.3):
            out.append("".join(rng.choice(spaces) if rng.random() < share else rng.choice(letters) for _ in range(n)))
    shared = " ".join(rng.choice(["alpha", "beta", "gamma,", "İx", "don't", "42"]) for _ in range(300))
    return out + [shared, "head " + shared, shared[7:] + " tail", "x" + shared + "y"]


@pytest.mark.parametrize("size", [(16, 8, 64), (64, 16, 256), (1024, 128, 8192)])
def test_encoding_is_the_tokenizers(spark, size):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = odd_texts()
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 2), (None, "no id", "x", 2), (99, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, src int").repartition(3)
    mean, least, most = size
    got = bpe.encode(docs, packing.tokenizer_path(), mean, least, most, buckets=3, tasks=2, block=20_000, most_bytes=50_000, out_ids=500).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids
        for r in by[i]:
            assert r.ids == want, (i, (t or "")[:60])
            assert r.decoded == tok.decode(want, skip_special_tokens=False)
    assert len(by[3]) == 2


def test_query_and_empty_table(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op11_bpe"](spark, SF).collect()}
    for r in d.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[r.doc_id])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    d.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["op11_bpe"](spark, str(tmp_path)).count() == 0


def test_cuts_follow_the_content():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    chunks = []
    for head in (b"", b"some other words before ", b"x" * 777):
        data = np.frombuffer(head + shared, np.uint8)
        at = [0, *bpe.cuts(data, np.array([0, len(data)]), 256, 32, 4096)[0], len(data)]
        assert all(0 < b - a <= 4096 for a, b in zip(at[:-1], at[1:], strict=True))
        chunks.append({bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)})
    assert len(chunks[0]) > 30 and all(len(chunks[0] & c) > 0.9 * len(chunks[0]) for c in chunks[1:])
    # several texts in one buffer are cut as each is alone, and never inside a character
    texts = [x.encode() for x in ("é" * 3000, "", "plain " * 300, "中文" * 700)]
    ends = np.cumsum([0, *map(len, texts)])
    for t, lo, own in zip(texts, ends[:-1], bpe.cuts(np.frombuffer(b"".join(texts), np.uint8), ends, 64, 40, 200), strict=True):
        assert [c - lo for c in own] == bpe.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 64, 40, 200)[0]
        for a, b in zip([0, *(c - lo for c in own)], [*(c - lo for c in own), len(t)], strict=True):
            t[a:b].decode()


def test_a_bucket_encodes_a_chunk_once(monkeypatch):
    e, seen = bpe.Encoder(packing.tokenizer_path(), 1 << 20), []
    real = e.ids
    e.ids = lambda col: (seen.append(len(col)), real(col))[1]
    e.learn({b"1": b"one two three", b"2": b"nospace"})
    assert seen == [2, 2, 2] and e.known[b"2"][4] == b"" and e.known[b"1"][3:] == (b"one", b" three")


def test_ends_are_widened_until_they_agree():
    """A tokenizer for which a single word is no unit: the head grows until its ids are a beginning of the whole's."""
    def encode(t: bytes) -> bytes:  # pairs of words are one id
        w = t.split()
        return b"".join(bytes([len(b"".join(w[i : i + 2]))]) * 4 for i in range(0, len(w), 2))

    text = b"aa bb c dddd e"
    head, tail = bpe.split(text, encode(text), encode)
    assert head and encode(text).startswith(encode(text[:head])) and (not tail or encode(text).endswith(encode(text[-tail:])))


def vectors(spark, n=70, d=6):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=d) * np.arange(1, d + 1)).tolist(), int(i % 3)) for i in range(n)]
    rows += [(5, rows[5][1], 2), (100, rows[0][1], 0), (200, rows[7][1], 1), (201, rows[7][1], 1), (202, rows[7][1], 2)]
    rows += [(300, None, 1), (301, [None] + [1.0] * (d - 1), 1), (302, [float("inf")] * d, 1), (303, [], 1), (None, [1.0] * d, 1), (304, [1.0] * d, None), (400, [1.0, 2.0], 1)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n string")


def usable(rows, label=False):
    out = []
    for i, v, y in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (not label or y is not None):
            out.append((i, v, y))
    return out


@pytest.mark.parametrize("k,width", [(6, None), (2, 2), (3, 4), (32, None)])
def test_whitening(spark, k, width):
    rows, df = vectors(spark)
    got, found, error = whitening.whiten(df.repartition(3), Store(spark), k=k, width=width, rows=16, patience=40 if width == 4 else 5)
    own = [r for r in usable(rows) if len(r[1]) == 6]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in own]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    c = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    m = min(k, 6)
    assert np.allclose(found.values, e[:m], rtol=1e-9) and error < 1e-9 and (found.residuals <= 1e-12 * e[0]).all()
    assert np.isclose(found.trace, e.sum())
    want = c @ u[:, :m] / np.sqrt(e[:m])
    by = {}
    for r in got.collect():
        by.setdefault(r.vec_id, []).append(r)
    assert sum(map(len, by.values())) == n and len(by[5]) == 2 and 400 not in by
    sign = None
    for (i, _, _), w, r in zip(own, want, x, strict=True):
        sign = sign if sign is not None else np.sign(np.array(by[i][0].whitened) * w)
        assert any(np.allclose(np.array(g.whitened) * sign, w, atol=1e-7) for g in by[i])
        assert int(by[i][0].deviation) == sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) and by[i][0].n == n
    flat = whitening.components(got, found).where("vec_id = 0").orderBy("component").collect()
    assert [r.component for r in flat] == list(range(1, m + 1))
    assert np.allclose([r.explained for r in flat], e[:m] / e.sum())
    if width == 2:
        assert found.passes > 1


def test_whitening_without_directions(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)] + [(9, None)], "vec_id long, embedding array<double>")
    got, found, error = whitening.whiten(same, Store(spark))
    assert sorted((r.vec_id, r.n, int(r.deviation), r.whitened) for r in got.collect()) == [(i, 3, 0, []) for i in range(3)] and error == 0
    assert whitening.components(got, found).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    got, found, error = whitening.whiten(line, Store(spark))
    assert {len(r.whitened) for r in got.collect()} == {1} and error < 1e-12
    none = same.where("vec_id = 9")
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["op12_whitening"](spark, str(tmp_path)).count() == 0
    # a deviation beyond a long is exact in the operator
    far = spark.createDataFrame([(0, [1e15]), (1, [-1e15])], "vec_id long, embedding array<double>")
    assert {int(r.deviation) for r in whitening.whiten(far, Store(spark), scale=1.0)[0].collect()} == {(2 * 10**15) ** 2}


def brute_negatives(rows, anchors, positives, k, scale=256):
    own = [(i, [int(np.floor(scale * c)) for c in v], y) for i, v, y in usable(rows, True)]
    out = []
    for a, v, y in own:
        if a % anchors:
            continue
        s = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z in own if i != a and len(w) == len(v))
        for ps, p, _ in [x for x in s if x[2] == y][:positives]:
            hits = [x for x in s if x[2] != y and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:k]
            out += [(a, p, n, i, -ps, -ns) for n, (ns, i, _) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 2048])
def test_hard_negatives(spark, shard):
    rows, df = vectors(spark)
    got = negatives.hard_negatives(df.repartition(3), df.where("vec_id % 5 = 0"), Store(spark), shard_rows=shard, anchor_rows=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 5, 5, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_negative_limits():
    for p in [*range(-25, 26), 10**17 + 7, -(10**17) - 3]:
        low, high = (int(x) for x in negatives.limits(np.int64(p), 3, 9))
        assert low == -((-3 * p) // 10) and high == 9 * p // 10


def test_negatives_of_given_tables(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, registry.QUERIES["op13_negatives"](spark, SF).collect()))
    assert got == sorted(con.execute(registry.ORACLES["op13_negatives"]).fetchall()) and got
    e.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["op13_negatives"](spark, str(tmp_path)).count() == 0


def test_very_long_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3000).tolist(), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(df, df.where("vec_id % 10 = 0"), Store(spark))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, 5, 10)
    found = whitening.whiten(df, Store(spark), k=8, width=16)
    assert found[2] < 1e-6 and {len(r.whitened) for r in found[0].collect()} == {8}

"""Rerank and pruning against a plain Python checker, the stored index against SQLite, and the tools' rules."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from stratiform.functions import tools
from stratiform.operators import lexical, retrieve

RAW, FOCUS, WORDS = "how to reset the cache", "reset cache", ["reset", "cache"]


def low(text):
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    coded = len(lines) >= 2 and all(len(x) >= 24 and all(c.isalnum() or c in "+/=" for c in x) for x in lines)
    headings = bool(lines) and all(x.startswith("#") for x in lines) and len("".join(text.split())) <= 24
    return not text.strip() or coded or headings


def check(hits, min_score, k):
    """The kept ids in order, by the rules as written down in the blueprint's appendix."""
    ranked = []
    for h in hits:
        head, path, anchor = " ".join(h["headings"]).lower(), h["path"].lower(), (h["anchor"] or "").lower()
        hay = f"{h['path']} {' '.join(h['headings'])} {h['text']}".lower()
        m = sum(w in hay for w in WORDS)
        cov, exact = m / len(WORDS), FOCUS in hay
        lex = exact + 0.3 * (RAW in hay) + 1.2 * cov
        struct, anchored = 0.0, False
        for place, whole, part in ((path, 0.8, 0.35), (head, 0.6, 0.25), (anchor, 0.3, 0.1)):
            n = sum(w in place for w in WORDS)
            struct += whole * (FOCUS in place) + part * n / len(WORDS)
            anchored |= FOCUS in place or n > 0
        c = h["score"] + 0.45 * lex + 0.2 * struct + 0.25 * h["boost"] + 0.15 * cov
        ranked.append((-c, h["distance"], h["id"], h | {"c": c, "cov": cov, "m": m, "exact": exact, "anchored": anchored}))
    ranked = [r[3] for r in sorted(ranked, key=lambda r: r[:3])]
    best = ranked[0]
    floor = 0.6 if best["score"] >= 0.8 else 0.5 if best["score"] >= 0.65 else 0.4 if best["score"] >= 0.5 else 0.3
    need = 0.75 if best["cov"] >= 0.8 else 0.5 if best["cov"] >= 0.6 else 0.0
    strong, fair = best["cov"] >= 0.8 and best["m"] >= 2, best["cov"] >= 0.6 and best["m"] >= 2
    why, kept = {}, []
    for h in ranked:
        tests = {
            "score": h["score"] >= max(min_score, floor),
            "combined": h["c"] >= 0.7 * best["c"],
            "distance": not (strong and best["has_vector"]) or not h["has_vector"] or h["distance"] <= best["distance"] + 0.12,
            "low": not low(h["text"]),
            "coverage": h["cov"] >= need or h["exact"] or need == 0,
            "presence": not fair or h["exact"] or h["anchored"] or h["m"] >= 1,
            "anchor": not strong or h["anchored"] or h["m"] >= 2,
        }
        for name, ok in tests.items():
            if not ok and all(v for n, v in tests.items() if n != name):
                why[name] = why.get(name, 0) + 1
        if all(tests.values()):
            kept.append(h)
    files = list(dict.fromkeys(h["path"] for h in kept))
    out = [[h for h in kept if h["path"] == f][r] for r in range(2) for f in files if len([h for h in kept if h["path"] == f]) > r]
    return [h["id"] for h in out][:k], why


def hits(rng, n, plain):
    """Random hits; ``plain`` ones hold the words apart, so that the score alone does not decide."""
    if plain:
        texts, paths = ["cache, then reset", "the cache is here", "please reset it"], ["~/a.md", "~/c.md", "~/d.md"]
        return [{"id": i, "path": rng.choice(paths), "headings": [], "anchor": rng.choice([None, "the cache"]), "text": rng.choice(texts), "score": round(0.85 + rng.random() / 10, 3), "distance": round(rng.random() / 3, 3), "boost": 0.0, "has_vector": rng.random() < 0.8} for i in range(n)]
    out = []
    for i in range(n):
        text = rng.choice(["how to reset the cache now", "reset cache at once", "the cache is here", "please reset it", "nothing", "# reset cache", "QUJDREVGR0hJSktMTU5PUFFSU1RV\nQUJDREVGR0hJSktMTU5PUFFSU1RV", "cache, then reset"])
        vector = rng.random() < 0.6
        out.append({"id": i, "path": rng.choice(["~/a.md", "~/reset cache.md", "~/cache/b.md", "~/c.md", "~/d.md"]), "headings": rng.choice([[], ["Reset cache"], ["Intro", "cache"]]), "anchor": rng.choice([None, "reset cache", "x"]), "text": text, "score": round(rng.choice([0.3, 0.55, 0.7, 0.9]) + rng.random() / 20, 3), "distance": round(rng.random() / 3, 3), "boost": rng.choice([0.0, 0.12, 0.2]), "has_vector": vector})
    return out


def test_prune_against_a_checker(spark):
    rng, bit = random.Random(3), {}
    schema = "id int, path string, headings array<string>, anchor string, text string, score double, distance double, boost double, has_vector boolean"
    for n in (1, 3, 12, 40, 80, 120, 160):
        rows = hits(rng, n, n in (40, 120))
        df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
        ranked = retrieve.rerank(df, F.col("text"), F.col("path"), F.col("headings"), F.col("anchor"), RAW, FOCUS, WORDS)
        got = [r.id for r in retrieve.prune(ranked, "id", "path", 0.35, 8).orderBy("place").collect()]
        want, why = check(rows, 0.35, 8)
        assert got == want
        for k, v in why.items():
            bit[k] = bit.get(k, 0) + v
    assert {"score", "combined", "distance", "low", "coverage"} <= set(bit)


def test_limits():
    assert [retrieve.candidate_limit(k) for k in (1, 11, 20, 50)] == [24, 88, 160, 160]
    assert [retrieve.limit_of_each(24, n) for n in (0, 1, 2, 3)] == [24, 24, 12, 12]


def test_stored_index_agrees_with_fts5(spark, tmp_path):
    rng = random.Random(4)
    words = "quick fox dog lazy café a_b x-y the".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), rng.choice(words)) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, h, tokenize=\"unicode61 remove_diacritics 2 tokenchars '-_./#'\")")
    con.executemany("insert into f(rowid, t, h) values (?, ?, ?)", rows)
    folder = str(tmp_path / "index")
    index = lexical.Postings(spark, folder, "k", {"t": 1.5, "h": 4.0})
    index.change(added=spark.createDataFrame(rows, "k int, t string, h string").repartition(3))
    for match, phrases, every in (("quick OR dog", [["quick"], ["dog"]], False), ("quick AND cafe", [["quick"], ["cafe"]], True), ('"lazy dog"', [["lazy", "dog"]], False), ('"lazy dog" OR "a_b"', [["lazy", "dog"], ["a_b"]], False)):
        want = dict(con.execute("select rowid, bm25(f, 1.5, 4.0) from f where f match ?", (match,)).fetchall())
        got = {r.k: r["rank"] for r in index.search(phrases, every).collect()}
        assert got.keys() == want.keys() and want
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want), match
    plan = index.search([["quick"]])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(term,quick)" in plan


def test_knn_in_blocks(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(90)] + [(90, [0.5] * 4), (91, [0.5] * 4)]
    df = spark.createDataFrame(rows, "k int, v array<float>")
    one = retrieve.knn(df, df.where("k % 3 = 0"), "k", "v", 5).orderBy("query", "rank").collect()
    assert one == retrieve.knn(df, df.where("k % 3 = 0"), "k", "v", 5, block=7).orderBy("query", "rank").collect() and len(one) == 31 * 5


@pytest.mark.parametrize("start,count,want", [(0, 0, (1, 1, "1: a")), (2, 5, (2, 3, "2: b\n3: ")), (3, 1, (3, 3, "3: ")), (4, 1, None), (1, 1000, (1, 3, "1: a\n2: b\n3: "))])
def test_line_window(spark, start, count, want):
    df = spark.createDataFrame([("a\r\nb\n\n",)], "t string")
    w = df.select(tools.line_window(F.col("t"), F.lit(start), F.lit(count)).alias("w")).first().w
    assert (w and (w.line_start, w.line_end, w.lines)) == want


def test_odd_vectors_come_last_and_no_pair_is_a_row_of_the_plan(spark):
    """Numbers first, then vectors without a direction, then those that can't be compared, by key each, as in DuckDB."""
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, 2.0]), (3, [3.0, 1.0]), (4, [2.0, 4.0, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0]), (50, [0.0, 0.0]), (100, None), (7, [-1.0, -2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    for block, shards in ((40_000, None), (2, 3)):
        found = retrieve.knn(df, df.where("k % 50 = 0"), "k", "v", 9, block, shards)
        got = {}
        for r in found.orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.k, r.distance))
        assert [k for k, _ in got[0]] == [2, 6, 3, 7, 50, 1, 4, 5, 100] and [k for k, _ in got[100]] == [0, 1, 2, 3, 4, 5, 6, 7, 50]
        assert got[0][0][1] == got[0][1][1] and got[0][4][1] != got[0][4][1] and all(d is None for _, d in got[0][5:] + got[100])
        assert [k for k, _ in got[50]] == [0, 2, 3, 6, 7, 1, 4, 5, 100]
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_copies_keep_smaller_keys(spark):
    rng = np.random.default_rng(5)
    m = np.float32(rng.normal(size=(7, 16)))[rng.integers(7, size=900)]
    df = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in enumerate(m)], "k long, v array<float>")
    got = {}
    for r in retrieve.knn(df, df.where("k % 90 = 0"), "k", "v", 4, 4, 3).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.k)
    assert got == {q: [k for k in range(900) if k != q and (m[k] == m[q]).all()][:4] for q in range(0, 900, 90)}

"""Stored postings after any sequence of changes, against a fresh build."""

import random

import pytest

from stratiform.operators import lexical
from stratiform.sources.versions import Late

WORDS = "quick fox dog lazy café a_b x-y the the the the".split()
ASKED = [([["quick"], ["dog"]], False), ([["the"], ["cafe"]], True), ([["the"]], False), ([["lazy", "dog"], ["fox"]], False), ([["none"]], False)]


def text(rng, n=30):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "k long, t string")


def index(spark, folder, **more):
    return lexical.Postings(spark, str(folder), "k", {"t": 1.5}, lot_rows=4, **more)


def ranks(df):
    return {r.k: round(r["rank"], 9) for r in df.collect()}


def agree(spark, own, fresh):
    for phrases, every in ASKED:
        want = ranks(fresh.search(phrases, every))
        assert ranks(own.search(phrases, every)) == want, phrases
        best = sorted(want.items(), key=lambda x: (x[1], x[0]))[:5]
        assert [(r.k, round(r["rank"], 9)) for r in own.top(phrases, 5, every, first=2).collect()] == best, phrases


def test_any_sequence_equals_a_fresh_build(spark, tmp_path):
    rng = random.Random(1)
    own, now = index(spark, tmp_path / "own", task_bytes=2000), {}
    assert own.search([["the"]]).count() == 0 and own.top([["the"]], 3).count() == 0
    for step in range(6):
        if step in (2, 4):
            gone = rng.sample(sorted(now), 7) + [10_000]
            own.change(removed=spark.createDataFrame([(k,) for k in gone], "k long"))
            now = {k: v for k, v in now.items() if k not in gone}
        else:
            more = {rng.randrange(60): text(rng) for _ in range(25)}  # new rows, and rows that replace others
            own.change(added=frame(spark, more))
            now |= more
    assert len(own.state()["segments"]) > 1
    fresh = index(spark, tmp_path / "fresh")
    fresh.change(added=frame(spark, now))
    agree(spark, own, fresh)
    while own.compact(2):
        pass
    assert len(own.state()["segments"]) == 1 and not own.state()["segments"][0]["dead"]
    agree(spark, own, fresh)
    assert own.clean() and not own.clean()
    assert ranks(own.search([["the"]])) == ranks(fresh.search([["the"]]))


def test_changes_read_no_postings(spark, tmp_path):
    own = index(spark, tmp_path)
    own.change(added=frame(spark, {k: "the quick dog" for k in range(20)}))
    for p in (tmp_path / own.state()["segments"][0]["name"] / "postings").rglob("*.parquet"):
        p.write_bytes(b"unreadable")
    own.change(added=frame(spark, {3: "dog", 30: "fox"}), removed=spark.createDataFrame([(4,)], "k long"))
    assert [s["rows"] - sum(d["rows"] for d in s["dead"]) for s in own.state()["segments"]] == [18, 2]


def test_failed_and_late_writers_change_nothing(spark, tmp_path, monkeypatch):
    own = index(spark, tmp_path)
    for a in range(3):
        own.change(added=frame(spark, {k: f"the quick {'dog' * a}" for k in range(a * 5, a * 5 + 5)}))
    before = ranks(own.search([["the"], ["quick"]]))
    state, real = own.state(), lexical.Postings.write

    def broken(self, *a):
        real(self, *a)
        raise RuntimeError("lost")

    monkeypatch.setattr(lexical.Postings, "write", broken)
    with pytest.raises(RuntimeError):
        own.compact(3)
    with pytest.raises(RuntimeError):
        own.change(added=frame(spark, {1: "fox"}))
    monkeypatch.undo()
    assert own.state() == state and ranks(own.search([["the"], ["quick"]])) == before
    # a compaction that another writer overtakes is late and leaves the other's version
    monkeypatch.setattr(lexical.Postings, "state", lambda self: state)
    index(spark, tmp_path).versions.commit(state | {"batches": {"other": 1}})
    with pytest.raises(Late):
        own.compact(3)
    monkeypatch.undo()
    assert own.state()["batches"] == {"other": 1} and len(own.state()["segments"]) == 3
    assert own.compact(3) and ranks(own.search([["the"], ["quick"]])) == before
    assert len(own.clean()) >= 4


def test_repeated_batches(spark, tmp_path):
    own = index(spark, tmp_path)
    assert own.change(added=frame(spark, {1: "fox"}), batch=("s", 0))
    assert not own.change(added=frame(spark, {2: "fox"}), batch=("s", 0))
    assert own.change(added=frame(spark, {2: "fox"}), batch=("s", 1)) and own.change(added=frame(spark, {3: "fox"}), batch=("t", 0))
    assert set(ranks(own.search([["fox"]]))) == {1, 2, 3}


def test_lots_that_cannot_reach_the_best_rows_are_not_read(spark, tmp_path):
    rng = random.Random(2)
    rows = {k: " ".join(["the"] * rng.randint(1, 3) + [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 20, 80, 300]))]) for k in range(400)}
    rows |= {k: "the the the fox" for k in range(400, 403)}
    own = index(spark, tmp_path)
    own.change(added=frame(spark, rows))
    segments, phrases = own.state()["segments"], [["the"]]
    weights = own.weights(segments, phrases)
    bounds = own.bounds(segments, phrases, weights, False)
    left = own.reaching(segments, phrases, weights, 3, False, first=1)(own.blocks(segments, ["the"], "n"))
    n, few = bounds.count(), left.count()
    assert n > 90 and few < n / 4
    assert [r.k for r in own.top(phrases, 3, first=1).collect()] == [400, 401, 402]
    plan = own.top(phrases, 3, first=1)._jdf.queryExecution().toString()
    assert "lot" in plan.split("PushedFilters")[1]
    # more lots than may be named are joined
    assert [r.k for r in own.top([["the"], ["w1"]], 5, few=0).collect()] == [r.k for r in own.search([["the"], ["w1"]]).orderBy("rank", "k").limit(5).collect()]


def test_frequent_terms_are_split(spark, tmp_path):
    own = index(spark, tmp_path, task_bytes=1000)
    own.change(added=frame(spark, {k: "the quick brown fox" for k in range(300)}))
    files = [p for p in (tmp_path / own.state()["segments"][0]["name"] / "postings").rglob("*.parquet")]
    held = [n for p in files if (n := spark.read.parquet(str(p)).where("term = 'the'").count())]
    assert len(held) > 3


def test_merging_reads_words_and_shuffles_no_postings(spark, tmp_path):
    own = index(spark, tmp_path)
    for a in range(3):
        own.change(added=frame(spark, {k: f"the quick {'dog ' * a}" for k in range(a * 5, a * 5 + 5)}))
    before = ranks(own.search([["the"], ["dog"]]))
    for s in own.state()["segments"]:
        for p in (tmp_path / s["name"] / "postings").rglob("*.parquet"):
            p.write_bytes(b"unreadable")
    assert own.compact(3) and ranks(own.search([["the"], ["dog"]])) == before


def test_lots_that_go_on_in_the_next_batch(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "HELD", 40)
    rows = pa.record_batch({"key": [1, 2, 3, 4, 5], "len": pa.array([2, 3, 0, 2, 1], pa.int32()), "t_0": ["a b", "a a c", "", "b a", "a"], "t_1": ["", "", "", "", ""], "lot": [7, 7, 7, 8, 8]})
    out = [r for b in lexical.inverted([1.5, 4.0], 2.0)([rows.slice(i, 1) for i in range(5)]) for r in b.to_pylist()]
    assert [(r["lot"], r["term"], r["n"], r["key"], r["tf"], r["places"]) for r in sorted(out, key=lambda r: (r["lot"], r["term"]))] == [
        (7, "a", 2, [1, 2], [1.5, 3.0], [[0], [0, 1]]), (7, "b", 1, [1], [1.5], [[1]]), (7, "c", 1, [2], [1.5], [[2]]), (8, "a", 2, [4, 5], [1.5, 1.5], [[1], [0]]), (8, "b", 1, [4], [1.5], [[0]])]

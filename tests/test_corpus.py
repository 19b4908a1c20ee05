"""A followed corpus: batches that fail half-way, are repeated or come again lose and double nothing."""

import pytest
from pyspark.sql import functions as F

from stratiform.operators import lexical
from stratiform.streaming.upkeep import Corpus


def cut(files):
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text")).where("chunk_text <> ''")


class Disk:
    """Files as they are now."""

    def __init__(self, spark):
        self.spark, self.files = spark, {}

    def look(self, paths):
        rows = [(p, t, len(t), m) for p, (t, m) in sorted(self.files.items())]
        f = self.spark.createDataFrame(rows, "path string, text string, size_bytes long, modified_at_ms long")
        more = {"content_md5": F.md5("text"), "fingerprint": F.lit("v1"), "eligible": ~F.endswith("path", F.lit(".bin")), "has_text": F.trim("text") != ""}
        return f.withColumns(more).join(paths, "path", "left_semi")


def holds(corpus, disk):
    want = sorted((p, i, x) for p, (t, _) in disk.files.items() if not p.endswith(".bin") for i, x in enumerate(t.split("\n")) if x)
    got = sorted((r.path, r.chunk_index, r.chunk_text) for r in corpus.chunks().collect())
    assert got == want
    keys = [r.chunk_key for r in corpus.chunks().collect()]
    assert len(set(keys)) == len(keys)
    indexed = sorted(r.key for r in corpus.postings.documents(corpus.postings.state()["segments"]).collect()) if keys else []
    assert indexed == sorted(keys)


def test_batches(spark, tmp_path):
    disk = Disk(spark)
    corpus = Corpus(spark, str(tmp_path), cut)
    batch = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    disk.files = {"/a": ("red fox\nblue dog", 1), "/b": ("green dog", 1), "/c.bin": ("dog", 1), "/e": ("  ", 1)}
    assert corpus.apply(batch("/a", "/a", "/b", "/c.bin", "/e", None, "/none"), disk.look, ("w", 0))
    holds(corpus, disk_without(disk, "/e"))
    assert {(r.path, r.chunk_index) for r in corpus.search([["dog"]], 5).collect()} == {("/a", 1), ("/b", 0)}
    before = corpus.state()
    disk.files["/a"] = ("red fox", 2)
    assert not corpus.apply(batch("/a"), disk.look, ("w", 0)) and corpus.state() == before  # applied before
    assert corpus.apply(batch("/a"), disk.look, ("w", 1))
    disk.files["/b"] = ("green dog", 9)  # touched, not changed
    keys = sorted(r.chunk_key for r in corpus.chunks().collect())
    assert corpus.apply(batch("/b"), disk.look, ("w", 2)) and sorted(r.chunk_key for r in corpus.chunks().collect()) == keys
    del disk.files["/b"]
    disk.files["/d"] = ("grey dog\n\nwolf", 3)
    assert corpus.apply(batch("/b", "/d"), disk.look, ("w", 3))
    holds(corpus, disk_without(disk, "/e"))
    assert corpus.merge() and not corpus.merge()
    holds(corpus, disk_without(disk, "/e"))
    corpus.postings.compact(2)
    assert {r.path for r in corpus.search([["dog"]], 5).collect()} == {"/d"}


def disk_without(disk, path):
    out = Disk(disk.spark)
    out.files = {p: x for p, x in disk.files.items() if p != path}
    return out


@pytest.mark.parametrize("where", ["staging", "postings", "commit"])
def test_a_stream_that_fails_and_starts_again(spark, tmp_path, monkeypatch, where):
    disk, folder = Disk(spark), str(tmp_path / "own")
    corpus = Corpus(spark, folder, cut)

    def drain():
        events = spark.readStream.schema("path string, kind string").json(str(tmp_path / "events"))
        q = corpus.follow(events, disk.look, "w", str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        return q.exception()

    def send(n, *paths):
        (tmp_path / "events").mkdir(exist_ok=True)
        (tmp_path / "events" / f"{n}.json").write_text("".join(f'{{"path": "{p}", "kind": "modify"}}\n' for p in paths))

    disk.files = {f"/{i}": (f"dog {i}\nfox {i}", 1) for i in range(6)}
    send(0, *disk.files)
    assert drain() is None
    disk.files |= {"/1": ("wolf\ncat", 2), "/7": ("dog", 1)}
    del disk.files["/2"]
    send(1, "/1", "/2", "/7")
    target = {"staging": (Corpus, "stage"), "postings": (lexical.Postings, "change"), "commit": (type(corpus.versions), "commit")}[where]
    real, calls = getattr(*target), []

    def lost(self, *a, **k):
        if where == "commit" and self is not corpus.versions:
            return real(self, *a, **k)
        if where != "commit":
            real(self, *a, **k)  # the work is done, but nobody hears of it
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(*target, lost)
    with pytest.raises(Exception, match="lost"):
        if e := drain():
            raise e
    monkeypatch.undo()
    assert calls
    assert drain() is None
    holds(corpus, disk)
    assert drain() is None and corpus.state()["batches"] == {"w": 1}
    holds(corpus, disk)


def test_no_text_is_sorted_or_shuffled_for_keys(spark, tmp_path, monkeypatch):
    """Chunks are written once, with their keys; hash tables of paths, not sorts, pick the files."""
    disk, plans = Disk(spark), []
    disk.files = {f"/{i}": (f"dog {i}\nfox {i}", 1) for i in range(40)}
    corpus = Corpus(spark, str(tmp_path), cut)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    real = type(spark.range(1)).withColumn
    monkeypatch.setattr(type(spark.range(1)), "withColumn", lambda self, name, c: plans.append(real(self, name, c)) or plans[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert corpus.apply(spark.createDataFrame([(p,) for p in disk.files], "path string"), lambda p: disk.look(p.hint("shuffle_hash")), ("w", 0))
        keyed = [p._jdf.queryExecution().executedPlan().toString() for p in plans if "chunk_key" in p.columns and "chunk_text" in p.columns and "log" not in p.columns]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(keyed) == 1 and "Window" not in keyed[0]
    assert keyed[0].count("ShuffledHashJoin") >= 2
    monkeypatch.undo()
    holds(corpus, disk)
    assert {p.name for p in (tmp_path / "corpus" / "batch-w-000000000000").iterdir()} == {"files", "chunks"}

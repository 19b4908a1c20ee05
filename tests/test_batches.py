"""Long texts in Python workers: how much is held together, and how often a text is read."""

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from stratiform.functions import predicates
from stratiform.operators import batches, chunk, outline, pages


def test_each_count_of_characters_is_made_once(spark):
    texts = ["plain words that are long enough to be read", "漢字漢字漢字漢字" + "бвгдежзик" + "αβγδεζηθικ" + "latin letters", "x​", "a" * 30 + "\x01" * 2, "𠀀𠀁 한글 क", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    n = predicates.script_counts(F.col("t"))
    counts = [(r.cjk, r.greek, r.cyrillic, r.latin, r.other) for r in d.select(*[c.alias(k) for k, c in n.items()]).collect()]
    assert counts[1] == (8, 10, 9, 12, 0) and counts[4] == (4, 0, 0, 0, 1) and counts[5] == (0, 0, 0, 0, 0) and counts[6] == (None,) * 5
    read = d.select(predicates.readable(F.col("t")).alias("r"))
    assert [r.r for r in read.collect()] == [True, False, False, True, True, False, None]
    assert len(re.findall("regexp_", read._jdf.queryExecution().analyzed().toString())) == len(predicates.SCRIPTS) + 4


def test_rows_of_many_segments_are_handed_on_together(spark, monkeypatch):
    made = []
    real = batches.map_frames
    monkeypatch.setattr(outline, "map_frames", lambda df, run, schema: made.append(run) or real(df, run, schema))
    outline.line_outline(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), segment_lines=1)
    f = pd.DataFrame({"id": [1] * 500, "segment": range(500), "lines": [["a", "# b"]] * 500, "following": ["c"] * 500, "state": ["n"] * 500, "stack": [[]] * 500, "start": range(500)})
    out = list(made[-1](iter([f])))
    assert len(out) == 1 and len(out[0]) == 1000


def test_batches_of_long_texts_are_cut(spark, monkeypatch):
    b = pa.record_batch({"k": list(range(100)), "t": ["x" * 10_000] * 100})
    own = list(batches.frames([b], 100_000))
    assert sum(map(len, own)) == 100 and max(map(len, own)) <= 10
    held = []
    monkeypatch.setattr(batches, "frames", lambda bs, f=batches.frames: f(bs, 50))
    d = spark.createDataFrame([(k, f"Head {k} word\nline {k}" * 20) for k in range(30)], "doc_id long, text string")
    for name in ("chunk", "pages"):
        monkeypatch.setattr({"chunk": chunk, "pages": pages}[name], "map_frames", lambda df, run, schema: held.append(schema) or batches.map_frames(df, run, schema))
    assert {r.doc_id: r.n for r in chunk.chunk_plain(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {k: len(chunk.plain_chunks(f"Head {k} word\nline {k}" * 20)) for k in range(30)}
    p = d.select("doc_id", F.array(F.split("text", "\n"), F.split("text", "\n"), F.array(F.lit("own"))).alias("pages"))
    assert pages.clean_pages(p).count() == 90 and len(held) == 2

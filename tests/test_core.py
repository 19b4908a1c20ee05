"""Golden and property tests of the pieces that SQL can't check."""

import math
import sqlite3

import pytest

from stratiform import catalog
from stratiform.functions import predicates as P, text as T
from stratiform.operators import chunk, lexical, ranking
from stratiform.plans import files, search, upkeep  # noqa: F401  add their queries to the catalog


def test_markdown_chunks_cover_every_line_and_keep_limits():
    text = "# A\n\n" + "\n\n".join("word " * 20 + str(i) for i in range(30)) + "\n\n## B\n```\n# no heading\n```\n- item\n- item two\n" + "x" * 1400
    got = chunk.markdown_chunks(text)
    lines = text.split("\n")
    covered = {i for s, e, _, _ in got for i in range(s, e)}
    assert all(i in covered for i, x in enumerate(lines) if x.strip())
    assert all(len(t) <= 550 for *_, t in got)
    assert got[0][2] == ("A",) and got[-1][2] == ("A", "B")
    assert [g[0] for g in got] == sorted(g[0] for g in got)


def test_plain_chunks():
    text = "some words here. " * 400
    got = chunk.plain_chunks(text)
    assert all(len(t) <= 1200 for _, t in got)
    assert got[0][0] == 0 and got[-1][0] + len(got[-1][1]) == len(text)
    assert all(b[0] <= a[0] + len(a[1]) for a, b in zip(got, got[1:]))


def test_fuzzy_orders():
    assert ranking.fuzzy("app", "app.rs") > ranking.fuzzy("app", "a_p_p.rs") > 0
    assert ranking.fuzzy("readme", "docs/readme.md") > ranking.fuzzy("readme", "r-e-a-d-m-e")
    assert ranking.fuzzy("zz", "abc") == -1
    assert ranking.fuzzy("App", "app") == -1


def test_bm25_agrees_with_fts5(spark):
    rows = [(1, "the quick fox"), (2, "the lazy dog dog"), (3, "quick quick dog"), (4, "nothing"), (5, "a fox and more words here")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize=\"unicode61 remove_diacritics 2 tokenchars '-_./#'\")")
    con.executemany("insert into f(rowid, t) values (?, ?)", rows)
    want = dict(con.execute("select rowid, bm25(f, 1.5) from f where f match 'quick OR dog'").fetchall())
    got = {r["k"]: r["rank"] for r in lexical.bm25(spark.createDataFrame(rows, "k int, t string"), "k", {"t": 1.5}, ["quick", "dog"]).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_text_functions(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("HTTPServer name", "hello_world x", '{"b":1,"a":[2]}', "Café Über!", "plain text"), (None,) * 5], "a string, b string, j string, s string, p string")
    r = d.select(T.snake_case(F.col("a")), T.camel_case(F.col("a")), T.title_case(F.col("b")), T.json_pretty("j"), T.slugify("s"), T.base64_auto(F.col("p"))).collect()
    assert tuple(r[0])[:3] == ("http_server_name", "httpServerName", "Hello_World X")
    assert r[0][3] == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}' and r[0][4] == "cafe-uber" and r[0][5] == "cGxhaW4gdGV4dA=="
    assert all(x is None for x in r[1])


def test_globs():
    import re

    m = lambda g, p: bool(re.search(P.glob_regex(g), p))
    assert m("**/node_modules/**", "a/node_modules/b.js") and m("*.log", "x.log") and not m("*.log", "d/x.log")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0

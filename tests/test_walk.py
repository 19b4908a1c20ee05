"""Rule files against golden trees, the folder source, and joins of prefixes."""

import pytest
from pyspark.sql import functions as F

from stratiform.operators import ignore, paths
from stratiform.sources.walk import walk

TREES = {
    "order and letting in again": ({"/.gitignore": "*.log\n!keep.log\nkeep.log\n!/a/keep.log"}, {"x.log": 0, "keep.log": 0, "a/keep.log": 1, "a/b.txt": 1}),
    "no way back into a folder": ({"/.gitignore": "dist/\n!dist/a.txt"}, {"dist/a.txt": 0, "x/dist/b.txt": 0, "y/dist": 1}),
    "anchored and not": ({"/.gitignore": "/top.txt\nsub/only.txt\nany.txt"}, {"top.txt": 0, "a/top.txt": 1, "sub/only.txt": 0, "a/sub/only.txt": 1, "any.txt": 0, "a/b/any.txt": 0}),
    "nested files": ({"/.gitignore": "*.tmp\n", "/a/.gitignore": "!good.tmp\n/own.md\n"}, {"good.tmp": 0, "a/good.tmp": 1, "a/b/good.tmp": 1, "a/bad.tmp": 0, "a/own.md": 0, "a/b/own.md": 1}),
    "stars": ({"/.gitignore": "a/**/z.txt\n**/deep\nall/**\nx*y.md\nq?.md\n"}, {"a/z.txt": 0, "a/b/c/z.txt": 0, "z.txt": 1, "m/deep/f": 0, "all/f": 0, "xaby.md": 0, "x/y.md": 1, "q1.md": 0, "q12.md": 1}),
    "classes and escapes": ({"/.gitignore": "[a-c]1\n[!x]2\n\\#real\n\\!real\n# comment\n\nsp\\ \ntrail   \n"}, {"b1": 0, "d1": 1, "y2": 0, "x2": 1, "#real": 0, "!real": 0, "# comment": 1, "sp ": 0, "trail": 0}),
    "kinds": ({"/.gitignore": "a.md\n", "/.ignore": "!a.md\nb.md", "/.git/info/exclude": "a.md\nc.md", "/d/.gitignore": "!b.md\n!c.md"}, {"a.md": 1, "b.md": 0, "c.md": 0, "d/b.md": 0, "d/c.md": 1}),
    "special characters": ({"/.gitignore": "a.b\n(x)\n+%_\n"}, {"a.b": 0, "axb": 1, "(x)": 0, "x": 1, "+%_": 0, "+ab": 1}),
    "never": ({}, {".git/config": 0, "node_modules/a.js": 0, "a/target/b": 0, "a/targets/b": 1, ".hidden": 1}),
}


@pytest.mark.parametrize("name", sorted(TREES))
def test_trees(spark, name):
    texts, want = TREES[name]
    files = spark.createDataFrame([(f"/r{p}", t) for p, t in texts.items()] + [(f"/r/{p}", None) for p in want], "path string, text string")
    got = {r.path[3:] for r in ignore.kept(files, ignore.rules(files), "/r").collect()}
    assert {p: int(p in got) for p in want} == want


def test_rules_outside_a_repository(spark):
    files = spark.createDataFrame([("/r/.gitignore", "a"), ("/r/.ignore", "b"), ("/r/a", None), ("/r/b", None), ("/s/a", None)], "path string, text string")
    assert {r.path for r in ignore.kept(files, ignore.rules(files, False), "/r/").collect()} == {"/r/.gitignore", "/r/.ignore", "/r/a"}


def test_folder_source_and_changed_rules(spark, tmp_path):
    for f in ("a/one.md", "a/dist/two.md", "b/three.md", "b/c/d/four.md"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / ".gitignore").write_text("four.md\n")
    root = str(tmp_path)
    seen = walk(spark, root, tasks="3").select("path").collect()
    assert sorted(r.path.removeprefix(root) for r in seen) == ["/.gitignore", "/a/dist/two.md", "/a/one.md", "/b/c/d/four.md", "/b/three.md"]
    tree = walk(spark, root)
    records = spark.createDataFrame(ignore.kept(tree, ignore.rules(tree), root).select("path").collect())
    assert records.count() == 4
    # a rule file of a folder changes: only that folder is listed again, under the rules above it too
    (tmp_path / "b/three.md").unlink()
    for text, want in (("dist/\n", ["/.gitignore", "/a/.gitignore", "/a/one.md", "/b/three.md"]), (None, ["/.gitignore", "/a/dist/two.md", "/a/one.md", "/b/three.md"])):
        (tmp_path / "a/.gitignore").write_text(text) if text else (tmp_path / "a/.gitignore").unlink()
        part = walk(spark, root, scope=f"{root}/a")
        assert not part.where(F.contains("path", F.lit("/b/"))).count()
        records = spark.createDataFrame(ignore.rescanned(records, ignore.kept(part, ignore.rules(part), root).select("path"), f"{root}/a").collect())
        assert sorted(r.path.removeprefix(root) for r in records.collect()) == want


def test_prefixes(spark):
    files = ["/a/b/c.md", "/a/b", "/a/bc/d.md", "/a/%/e.md", "/a/_/f.md", "/a/x/f.md", "/z"]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "k int, path string")
    given = ["/a/b", "/a/b/", "/a/%", "/a/_", "/", "/nope", None, "/a/b/c.md/deeper"]
    p = spark.createDataFrame([(g,) for g in given], "prefix_ string")
    found = paths.covered(rows, "path", p, "prefix_")
    want = sorted((f, g) for f in files for g in set(given) - {None} if f == g.rstrip("/") or f.startswith(g.rstrip("/") + "/"))
    assert sorted((r.path, r.prefix) for r in found.collect()) == want
    assert {r.k: r.prefix for r in paths.nearest(rows, "k", "path", p, "prefix_").collect()}[0] == "/a/b/"
    few = p.where("prefix_ in ('/a/b', '/a/_')")
    assert sorted(r.k for r in paths.within(rows, "path", few, "prefix_").collect()) == [0, 1, 4]
    assert sorted(r.k for r in paths.without([rows], "path", few, "prefix_")[0].collect()) == [2, 3, 5, 6]
    assert paths.covered(rows, "path", p.limit(0), "prefix_").count() == 0


def test_many_prefixes_need_no_nested_loop(spark, monkeypatch):
    rows = spark.range(5000).select(F.concat(F.lit("/d"), (F.col("id") % 50).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit("/x.md")).alias("path"))
    p = spark.range(4000).select(F.concat(F.lit("/d"), (F.col("id") % 50).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("q"))
    for most in (paths.FEW, 10):  # sent to all tasks, and not
        monkeypatch.setattr(paths, "FEW", most)
        found = paths.covered(rows, "path", p, "q")
        assert found.count() == 4000 and "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()

"""Planning, commands, bodies, pages, snapshots and stateful operators against small hand-made cases."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from stratiform.functions import bodies, commands, planning, predicates
from stratiform.operators import pages, snapshots
from stratiform.sources import office
from stratiform.streaming import stateful


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first())


def test_query_plan(spark):
    (p,) = one(spark, 'Where is the Config "loader" of src/main.rs', planning.query_plan(F.col("x")))
    assert p.focus == "config loader src main rs"
    assert [s.weight for s in p.semantic] == [0.0, 0.12]  # the path terms repeat the focus
    assert [s.weight for s in p.lexical] == [0.25, 0.15, 0.0]
    assert p.lexical[1].text.startswith('"config" AND "loader"')
    (p,) = one(spark, "the", planning.query_plan(F.col("x")))
    assert p.focus == "the" and [s.text for s in p.lexical] == ['"the"']
    (p,) = one(spark, "  ", planning.query_plan(F.col("x")))
    assert list(p.semantic) == [] and list(p.lexical) == []


def test_commands(spark):
    a = ["/translate", "/tr"]
    for text, want in {"/tr": None, "/tr  hello ": "hello", "/TRANSLhello": "hello", "/trhello": "hello", "x": None, "": None}.items():
        assert one(spark, text, commands.command_payload(F.col("x"), a)) == (want,), text
    assert commands.slash("/translate  hi there", a) == ("/translate", "/translate", "hi there")
    assert commands.slash("/tran", a) == ("/translate", "/tran", "")
    assert commands.slash("/translatehi", a) == ("/translate", "/translate", "hi")
    assert commands.slash("/transhi", a) == ("/tr", "/tr", "anshi") and commands.slash("/transhi", a[:1]) == ("/translate", "/trans", "hi")
    assert commands.slash("no", a) is None and commands.slash("/zz", a) is None
    assert commands.preview("# H\n```\ncode\n```\n\n- first  line\n2. second\nthird") == "first line second"
    assert commands.preview("x" * 200) == "x" * 137 + "..." and commands.preview("") is None
    order = ["1.0.0-1", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0", "1.0.1", "2.0.0"]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string")
    pairs = d.crossJoin(d.select(F.col("i").alias("j"), F.col("v").alias("w"))).select("i", "j", commands.compare_versions(F.col("v"), F.col("w")).alias("c")).collect()
    assert all(r.c == (r.i > r.j) - (r.i < r.j) for r in pairs)
    for path, want in {"/a/./b/../c": "/a/c", "../x/..": "..", "a/..": ".", "/": "/"}.items():
        assert one(spark, path, commands.normal_path(F.col("x"))) == (want,)


def test_bodies():
    chunk = lambda **d: "data: " + json.dumps({"choices": [{"index": 0, "delta": d}]}) + "\n\n"
    body = chunk(content="Hel") + chunk(content="lo ") + chunk(reasoning="why") + chunk(tool_calls=[{"index": 0, "id": "c1", "function": {"name": "f", "arguments": '{"a"'}}]) + chunk(tool_calls=[{"index": 0, "function": {"arguments": ":1}"}}]) + "data: [DONE]"
    content, why, calls, _, error = bodies.fold(body)
    assert (content, why, error) == ("Hello ", "why", None) and json.loads(calls) == [{"arguments": '{"a":1}', "id": "c1", "name": "f"}]
    done = {"type": "response.completed", "response": {"status": "completed", "output": [{"type": "message", "content": [{"type": "output_text", "text": "all"}]}]}}
    assert bodies.fold('data: {"type":"response.output_text.delta","delta":"al"}\n\ndata: ' + json.dumps(done))[0] == "all"
    assert bodies.fold('{"error":{"message":"bad key"}}')[4] == "bad key"
    assert bodies.fold("plain")[4] and bodies.fold("data: {oops\n\n")[4].startswith("malformed")
    assert bodies.translation("Analysis\nFinal Translation: ** Hallo ") == "Hallo" and bodies.translation("Hallo") is None
    assert bodies.visible("Thinking process: x") == ""


def test_docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text, props="": f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"
    xml = f'<w:document xmlns:w="{w}"><w:body>{p("Top", "<w:pPr><w:pStyle w:val=%sKopf%s/></w:pPr>" % (chr(34), chr(34)))}{p("item", "<w:pPr><w:numPr/></w:pPr>")}<w:tbl><w:tr><w:tc>{p("a")}{p("b")}</w:tc><w:tc>{p("c")}</w:tc></w:tr></w:tbl>{p("end")}</w:body></w:document>'
    styles = f'<w:styles xmlns:w="{w}"><w:style w:type="paragraph" w:styleId="Kopf"><w:name w:val="heading 2"/></w:style></w:styles>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/styles.xml", styles)
    assert office.docx_text(buf.getvalue()) == "## Top\n\n- item\n\na / b | c\n\nend"
    assert office.docx_text(b"no zip") is None


def test_pages(spark):
    ps = [["Head", f"body {i}", "foot"] for i in range(4)]
    assert pages.without_edges(ps) == [[f"body {i}"] for i in range(4)]
    assert pages.without_edges(ps[:2]) == ps[:2]
    assert pages.page_blocks(["a" * 300 + ".", "b", "", "c"]) == ["a" * 300 + ".", "b", "c"]
    assert pages.pack_blocks([(1, "x" * 700), (1, "y" * 600), (1, "z"), (2, "w")]) == [(1, "x" * 700), (1, "y" * 600 + "\n\nz"), (2, "w")]
    for text, want in {"": False, "ok": True, "� a": False, "plain English words and more words": True, "Русский текст про разные вещи и слова": True, "漢字漢字漢字漢字漢字абвгдежзабвгαβγδεζηθικλ": False}.items():
        assert one(spark, text, predicates.readable(F.col("x"))) == (want,), text


def test_snapshots(spark, tmp_path):
    s = snapshots.Snapshots(spark, f"file://{tmp_path}/t")
    assert s.current() is None
    s.commit(spark.range(3))
    s.commit(spark.range(5))
    s.commit(spark.range(7))
    assert s.current().count() == 7
    s.prune(1)
    assert len(s.marks()) == 1 and s.current().count() == 7
    s.reset()
    assert s.current() is None
    assert snapshots.start_mode(None, {}) == "reuse"
    same = {"roots": ["a", "b"], "globs": [], "target": "m"}
    assert snapshots.start_mode(same, same | {"roots": ["b", "a"]}) == "reuse" and snapshots.start_mode(same, same | {"target": "n"}) == "rebuild"


def test_deadlines(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 2000), i) for i, k in enumerate(rng.choices([1, 2, None], k=300))]
    want = []
    for k in (1, 2, None):
        first, n = None, 0
        for t in sorted(t for q, t, _ in rows if q == k):
            if n and t - first >= 180:
                want.append((k, n, first))
                n = 0
            first, n = (t if not n else first), n + 1
        want.append((k, n, first))
    got = stateful.deadline_batches(spark.createDataFrame(rows, "k int, t long, i int"), "k", "t", "i", 180).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got)


def test_states():
    s = stateful.Session()
    kinds = ["ready", "prompt", "prompt", "failed", "prompt", "finished", "exit", "prompt"]
    got = [s.add({"session_id": 1, "seq": i, "kind": k, "detail": "why"})[0][2:] for i, k in enumerate(kinds)]
    assert [g[0] for g in got] == ["idle", "running", "running", "error", "running", "idle", "exited", "exited"]
    assert [g[3] for g in got] == [False, False, True, False, False, False, False, True] and got[3][2] == "why"
    c = stateful.ClipboardPoll()
    poll = lambda text, at, counter=None, own=False: bool(c.add({"device": 1, "text": text, "at_ms": at, "counter": counter, "own": own}))
    assert [poll("a", 0), poll("a", 1), poll(" ", 2), poll("a", 3), poll("b", 4, own=True), poll("b", 5), poll("c", 6), poll("b", 7)] == [True, False, False, True, False, False, True, True]
    v = stateful.Visible()
    assert [x for d in ("Ha", "llo", " Final translation: Hal") for x in v.add({"id": 1, "seq": 0, "delta": d})] == [(1, 0, "Ha"), (1, 0, "llo")]
    p = stateful.BatchPlanner()
    for _ in range(3):
        p.done(4)
    assert p.size == 5
    p.done(5, largest=2)
    assert p.size == 2 and p.full(2, 10, 1) and p.full(1, 4700, 200) and not p.full(0, 0, 9000)


def test_paths(spark):
    d = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",), ("/c/d/e",), (None,)], "path string")
    assert sorted(r.path for r in snapshots.outermost(d).collect()) == ["/a", "/ab", "/c/d"]
    for a, b, want in ((["x", "y"], ["x", "z"], ["x"]), ([], ["x"], []), (["x"], ["x", "y"], ["x"])):
        r = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(snapshots.common_prefix(F.col("a"), F.col("b")).alias("p")).first()
        assert r.p == want


def test_deadlines_on_a_stream(spark, tmp_path):
    def write(rows):
        d = spark.createDataFrame(rows, "k int, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def drain():
        s = spark.readStream.schema("k int, ts timestamp").parquet(f"{tmp_path}/in")
        out = stateful.deadline_stream(s, "k", "ts", "1 second", 180)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(60)

    for rows in ([(1, 1_000), (1, 1_100), (1, 1_500)], [(2, 60_000)], [(2, 120_000)]):  # a stream's watermark begins at 0
        write(rows)
        drain()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 1, 1_500, 1_500), (1, 2, 1_000, 1_100), (2, 1, 60_000, 60_000)]


FOLDS = {
    "clipboard": (stateful.clipboard_polls, stateful.clipboard_stream, "device long, at_ms long, counter long, text string, own boolean", [(1, 10, 1, "a", False), (1, 20, 1, "a", False), (1, 30, 2, " ", False), (1, 40, None, "b", False), (1, 50, None, "b", False), (1, 60, None, "c", True), (1, 70, None, "c", False), (2, 15, 1, "z", False)]),
    "session": (stateful.session_states, stateful.session_stream, "session_id long, seq long, kind string, detail string", [(1, 1, "ready", None), (1, 2, "prompt", None), (1, 3, "prompt", None), (1, 4, "failed", "no"), (1, 5, "exit", None), (2, 1, "prompt", None)]),
    "visible": (stateful.visible_deltas, stateful.visible_stream, "id long, seq long, delta string", [(1, 1, "Hel"), (1, 2, "lo"), (1, 3, ""), (1, 4, " you"), (2, 1, "x")]),
    "transcript": (stateful.transcript_blocks, stateful.transcript_stream, "conv_id long, turn long, role string, text string", [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "bot", "c"), (1, 4, "user", ""), (1, 5, "bot", "d"), (1, 6, "user", "e"), (2, 1, "bot", "f")]),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_folds_on_a_stream(spark, tmp_path, name):
    """A stream in two parts, the second one's rows out of order, against the batch fold; a last event moves the watermark."""
    batch, stream, schema, rows = FOLDS[name]
    want = sorted(map(str, batch(spark.createDataFrame(rows, schema)).collect()))
    kinds = schema + ", ts timestamp"
    d = spark.createDataFrame([(*r, i * 100) for i, r in enumerate(rows, 1)], schema + ", ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    half = d.where(F.unix_millis("ts") <= 100 * (len(rows) // 2))
    late = d.where(F.unix_millis("ts") > 100 * (len(rows) // 2)).orderBy(F.desc("ts"))
    end = [spark.createDataFrame([(99, *rows[0][1:], t)], schema + ", ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms") for t in (60_000, 120_000)]
    for part in (half, late, *end):
        part.select(*[c.split()[0] for c in kinds.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        q = stream(s, "ts", "2 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(120)
    got = sorted(str(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r[0] != 99)
    if name == "transcript":  # the last block of each conversation may still grow
        want = [x for x in want if "content='e'" not in x and "content='f'" not in x]
    assert got == want and got


def test_files(spark, tmp_path):
    from stratiform.sources import tables

    for name, data in (("a.md", "é text".encode()), ("nul.md", b"a\x00b"), ("bad.md", b"\xff\xfe"), ("large.md", b"x" * 200), ("sub/b.md", b"b")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in tables.files(spark, str(tmp_path), 100).collect()}
    assert got == {"a.md": "é text", "b.md": "b"}


WHOLE = [
    'data: {"choices": [{"index": 0, "delta": {"content": "Né 🐘"}}]}\r\n\r\ndata: {"choices": [{"index": 0, "delta": {"reasoning_content": "hm", "tool_calls": [{"index": 0, "id": "c", "function": {"name": "find", "arguments": "{\\"q\\": \\"é"}}]}}]}\n\n: note\n\ndata: {"choices": [{"index": 0, "delta": {"content": " two", "tool_calls": [{"index": 0, "function": {"arguments": "🐘\\"}"}}]}, "finish_reason": "stop"}]}\n\ndata: [DONE]\n\n',
    'data: {"choices":\ndata: [{"index": 0, "delta": {"content": "a"}}]}\n\ndata: {"choices": [{"index": 0, "delta": {"content": "no blank line at the end"}}]}',
    ' {"choices": [{"message": {"content": "é whole"}, "finish_reason": "stop"}]}',
    'data: {"choices": [{"delta": {"content": "a"}}]}\n\ndata: {broken\n\ndata: {"choices": [{"delta": {"content": "never"}}]}\n\n',
    "plain words",
    "",
]


def pieces(rng, body):
    data = body.encode()
    at = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(12)))})
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] or [b""]


def test_any_cut_of_a_body_gives_its_answer(spark):
    import random

    rng = random.Random(6)
    want = {str(i): bodies.fold(b) for i, b in enumerate(WHOLE)}
    assert want["0"][:2] == ("Né 🐘 two", "hm") and "\\u00e9" in want["0"][2] and want["3"][0] == "a" and want["3"][4].startswith("malformed")
    for _ in range(300):
        for i, b in enumerate(WHOLE):
            own, cut = bodies.Body(), pieces(rng, b)
            for j, c in enumerate(cut):
                own.feed(c, j == len(cut) - 1)
            assert own.answer.row() == want[str(i)], cut
    rows = [(f"{i}", j, bytearray(c), last and j == len(cut) - 1) for i, b in enumerate(WHOLE) for last in [i % 2 == 0] for cut in [[bytes([x]) for x in b.encode()] or [b""]] for j, c in enumerate(cut)]
    rng.shuffle(rows)
    got = stateful.chunked_answers(spark.createDataFrame(rows, "body string, seq long, chunk binary, last boolean")).collect()
    assert {r.body: tuple(r)[1:] for r in got} == want  # bodies without a last chunk end with their rows


def test_bodies_on_a_stream(spark, tmp_path):
    import random

    rng, kinds = random.Random(7), "body string, seq long, chunk binary, last boolean, ts timestamp"
    cut = {str(i): pieces(rng, b) for i, b in enumerate(WHOLE)}
    rows = [(k, j, bytearray(c), j == len(own) - 1, 1000 + 50 * j) for k, own in cut.items() for j, c in enumerate(own)]
    rng.shuffle(rows)
    end = [[("end", n, bytearray(b"x"), False, t)] for n, t in enumerate((60_000, 120_000))]
    for part in (rows[::2], rows[1::2], *end):  # chunks come late and out of order
        d = spark.createDataFrame(part, "body string, seq long, chunk binary, last boolean, ms long").select("body", "seq", "chunk", "last", F.timestamp_millis("ms").alias("ts"))
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        q = stateful.chunked_stream(s, "ts", "2 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(120)
    got = {r.body: tuple(r)[1:] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {str(i): bodies.fold(b) for i, b in enumerate(WHOLE)}


def test_labels_summaries_and_trims(spark):
    from stratiform.functions import predicates, text, tools

    d = spark.createDataFrame([(1, 1, 5, 9, 3, 7), (1, 2, 5, 9, 3, 7), (1, None, 5, 9, 3, 7), (None, None, 5, 9, 3, None), (None, None, 5, None, 3, 7)], "a int, b int, c int, d int, e int, f int")
    got = [r.x for r in d.select(text.location_label(*map(F.col, "abcdef")).alias("x")).collect()]
    assert got == ["page 1", "pages 1-2", "lines 5-9, paragraph 7", "lines 5-9", "chunk 3"]
    q = spark.createDataFrame([('a "b" \\ \n\t\r\0\x1b é',)], "q string").select(text.quoted(F.col("q")).alias("x")).first().x
    assert q == '"a \\"b\\" \\\\ \\n\\t\\r\\0\\u{1b} é"'
    empty = F.array().cast("array<string>")
    s = spark.range(1).select(tools.search_summary(F.lit("x"), empty, F.lit(False)).alias("x")).first().x
    assert s == 'Retrieved 0 hit(s) for query "x".'
    t = spark.createDataFrame([(" a \n b\n0 c ",)], "t string").select(text.trim_lines(F.col("t")).alias("x")).first().x
    assert t == "a\nb\n0 c"
    th, an = text.reasoning(F.col("t"))
    r = spark.createDataFrame([("<think> one\n</think> x <think>\n two </think>\n",)], "t string").select(th.alias("a"), an.alias("b")).first()
    assert tuple(r) == ("one\ntwo", "x")
    assert spark.createDataFrame([("  #  \n # x",)], "t string").select(predicates.low_information(F.col("t")).alias("x")).first().x is True


@pytest.mark.parametrize("kind,paths,folder,want", [("access", 1, False, "ignore"), ("metadata", 1, True, "ignore"), ("other", 1, False, "path"), ("other", 0, False, "rescan"), ("any", 1, False, "rescan"), (None, 1, False, "rescan"), ("rename", 1, True, "rescan"), ("rename", 1, False, "path"), ("create", 1, True, "walk"), ("modify", 1, True, "ignore"), ("remove", 1, False, "delete")])
def test_event_plans_of_kinds(spark, kind, paths, folder, want):
    from stratiform.functions import predicates

    d = spark.createDataFrame([(kind, ["/a"] * paths, folder)], "k string, p array<string>, f boolean")
    assert d.select(predicates.event_plan(F.col("k"), F.col("p"), F.col("f")).alias("x")).first().x == want


def test_change_steps(spark):
    from stratiform.operators import index

    now = [("/a", 1, 1, "m", "v", "/r", "a"), ("/b", 1, 1, "m", "v", "/r2", "b"), ("/c", 1, 2, "m", "v", "/r", "c"), ("/d", 1, 1, "m", "v", "/r", "d"), ("/e", 1, 1, "n", "w", "/r", "e"), ("/f", 1, 1, "m", "v", "/r", "f")]
    old = [("/a", 1, 1, "m", "v", "/r", "a", 3, False), ("/b", 1, 1, "m", "v", "/r", "b", 3, False), ("/c", 1, 1, "m", "v", "/r", "c", 3, True), ("/d", 1, 1, "m", "v", "/r", "d", 3, True), ("/e", 1, 1, "m", "v", "/r", "e", 3, True), ("/f", None, None, None, "v", "/r", "f", 0, True), ("/g", 1, 1, "m", "v", "/r", "g", 1, False)]
    cols = "path string, size_bytes long, modified_at_ms long, content_md5 string, fingerprint string, source_root string, relative_path string"
    s = spark.createDataFrame(now, cols).withColumns({"eligible": F.lit(True), "has_text": F.lit(True)})
    t = spark.createDataFrame(old, cols + ", chunk_count long, pending boolean")
    got = {r[0]: tuple(r)[1:] for r in index.change_steps(s, t, "path").collect()}
    assert got == {"/a": ("unchanged", False, False, False), "/b": ("unchanged", True, False, True), "/c": ("refresh", True, True, False), "/d": ("unchanged", True, True, False), "/e": ("reindex", False, False, False), "/f": ("reindex", False, False, False), "/g": ("delete", False, False, False)}


def test_growing_translations_show_what_whole_ones_do():
    rng = random.Random(13)
    bits = ["Final Translation: ", "final ", "translation:", "译文：", "翻译:", "Thinking Process", " analyze the request", "input text", "part of speech", "**", "- ", "\n", " ", "hello", "é!", "A", "translatedtext:", "最终译文："]
    for _ in range(3000):
        grow, raw = bodies.Growing(), ""
        deltas = [rng.choice(bits) for _ in range(rng.randint(1, 9))]
        deltas = [c for d in deltas for c in ([d] if rng.random() < 0.6 else list(d))]
        fold, shown = stateful.Visible(), ""
        for i, d in enumerate(deltas):
            raw += d
            grow.add(d)
            begin, end = grow.part()
            new = bodies.visible(raw)
            assert raw[begin:end] == new, deltas[: i + 1]
            want = []
            if len(new) > len(shown) and new.startswith(shown):
                want, shown = [(1, i, new[len(shown) :])], new
            elif not new:
                shown = ""
            assert fold.add({"id": 1, "seq": i, "delta": d}) == want, deltas[: i + 1]


def test_errors_schemas_and_reuse_keys(spark):
    import hashlib

    from stratiform.functions import text, tools
    from stratiform.operators import index

    said = [('{"error": {"message": " no "}}', "no"), ('{"error": {"details": [{"x": 1}, {"detail": "deep"}]}}', "deep"), ('{"message": "", "title": "t"}', "t"), ('[{"error": "list"}]', "list"), ("{}", None), ("not json", None), (None, None)]
    d = spark.createDataFrame(said, "j string, want string")
    assert all(r.x == r.want for r in d.select("want", text.error_message(F.col("j")).alias("x")).collect())
    assert tools.schema("search")["required"] == ["query"] and tools.schema("read_lines")["properties"]["line_count"] == {"type": "integer", "minimum": 1, "maximum": 240}
    calls = [("search", '{"query": "a", "topK": 20, "minScore": 1}', None), ("search", '{"query": "a", "topK": 21}', "topK must be at most 20"), ("open", None, "tool arguments are required"), ("open", '{"target": "x", "y": 1}', "unknown tool argument: y"), ("read_excerpt", '{"path": "p", "chunk_index": 0}', None), ("read_excerpt", '{"path": "p"}', "chunk_index is required")]
    for tool, raw, want in calls:
        assert spark.createDataFrame([(raw,)], "r string").select(tools.call_error(tool, F.col("r")).alias("x")).first().x == want, raw
    k = spark.createDataFrame([("é", ["a", "b"])], "t string, h array<string>").select(index.reuse_key(F.col("t"), F.col("h")).alias("k")).first().k
    assert k == hashlib.md5("a\x1fb\0é".encode()).hexdigest()
    w = spark.createDataFrame([('{"b": 1, "a": "x"}',)], "c string").select(tools.pending_envelope(F.lit("wait"), F.col("c")).alias("x")).first().x
    assert json.loads(w) == {"content": [{"type": "text", "text": "wait"}, {"type": "text", "text": '{\n  "a": "x",\n  "b": 1\n}'}], "structuredContent": {"b": 1, "a": "x"}, "isError": False}


def test_longest_prefixes(spark, tmp_path):
    texts = ["large ring", "large ring", "lar", "", None, "zz", "日本語の文"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    cache = spark.createDataFrame([("larg",), ("large r",), ("larg",), ("",), (None,), ("日本",), ("large rings",)], "prefix string")
    found = {r.id: r.prefix for r in snapshots.longest_prefix(rows, "text", cache, "prefix").collect()}
    assert found == {0: "large r", 1: "large r", 2: "", 3: "", 4: None, 5: "", 6: "日本"}
    # the beginnings of a few texts look smaller than the prefixes, and are yet not sent to the driver
    spark.range(50).select(F.repeat(F.col("id").cast("string"), 300).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/texts")
    spark.range(5000).select(F.col("id").cast("string").alias("prefix")).coalesce(1).write.parquet(f"{tmp_path}/cache")
    plan = snapshots.longest_prefix(spark.read.parquet(f"{tmp_path}/texts"), "text", spark.read.parquet(f"{tmp_path}/cache"), "prefix")._jdf.queryExecution().sparkPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastHashJoin" in line and "BuildLeft" in line:
            left = next(j for j in range(i + 2, len(lines) + 1) if j == len(lines) or depth(lines[j]) <= depth(lines[i + 1]))
            assert not any("Generate" in x for x in lines[i + 1 : left]), plan

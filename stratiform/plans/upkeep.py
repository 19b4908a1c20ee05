"""Queries on planning, index upkeep, paths and commands; they join the catalog when imported."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..catalog import PATH, query
from ..functions import bodies as B, commands as C, planning as N, text as T
from ..operators import index, pages as G, snapshots as S
from ..sources.tables import corpus, table
from ..streaming import stateful as Z

ROOTS = ["/corpus", "/corpus/src1", "/corpus/src1/en", "/other"]
ALIASES = ["/translate", "/tr"]
NOISE_SQL = "(" + ", ".join(f"'{w}'" for w in N.ENGLISH_NOISE + N.CHINESE_NOISE) + ")"


@query(r"WITH w AS (SELECT item_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_-]+'), lambda x: length(x) >= 2) AS l FROM benchmark), t AS (SELECT item_id, text, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM w) "
       f"SELECT item_id, array_to_string(l, ' ') AS terms, array_to_string(list_filter(l, lambda x: x NOT IN {NOISE_SQL}), ' ') AS required FROM t")
def query_terms(spark, sf):
    t = N.terms(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(t, " ").alias("terms"), F.array_join(N.informative(t), " ").alias("required"))


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _subs(entries: str, most: int) -> str:
    """JSON of the sub-queries that are neither blank nor, but for ASCII case, a repeat."""
    known = f"list_transform(list_filter({entries}, lambda e: trim(e.t) <> ''), lambda e: {{'t': trim(e.t), 'w': e.w, 'k': {LOW.format('trim(e.t)')}}})"
    first = f"list_filter({known}, lambda e, i: list_position(list_transform({known}, lambda x: x.k), e.k) = i)[1:{most}]"
    return f"""'[' || array_to_string(list_transform({first}, lambda e: '{{"text":' || CAST(to_json(e.t) AS VARCHAR) || ',"weight":' || e.w || '}}'), ',') || ']'"""


QUOTED = """array_to_string(list_transform({}, lambda t: '"' || replace(t, '"', '""') || '"'), '{}')"""
PLAN = (
    rf"""WITH a AS (SELECT item_id, trim(text) AS raw, list_filter(string_split_regex(lower(trim(text)), '[^\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 2) AS l FROM benchmark),
b AS (SELECT item_id, raw, list_filter(l, lambda x, i: list_position(l, x) = i) AS w FROM a),
c AS (SELECT *, CASE WHEN len(w) > 0 THEN w WHEN length(raw) >= 2 THEN [lower(raw)] ELSE [] END AS every, list_filter(w, lambda x: x NOT IN {NOISE_SQL}) AS paths FROM b),
d AS (SELECT *, list_filter(every, lambda x: x NOT IN {NOISE_SQL}) AS required FROM c),
e AS (SELECT *, CASE WHEN len(required) > 0 THEN required ELSE every END AS chosen FROM d),
f AS (SELECT *, CASE WHEN len(chosen) > 0 THEN array_to_string(chosen, ' ') ELSE raw END AS focus FROM e),
g AS (SELECT *, CASE WHEN lower(focus) <> lower(raw) THEN '"' || replace(lower(focus), '"', '""') || '"' ELSE '' END AS phrase, CASE WHEN len(required) >= 2 THEN """
    + QUOTED.format("required", " AND ")
    + " ELSE '' END AS both_, "
    + QUOTED.format("chosen", " OR ")
    + " AS any_, "
    + QUOTED.format("paths", " OR ")
    + " AS path_ FROM f) SELECT item_id, focus, "
    + _subs("[{'t': raw, 'w': '0.0'}, {'t': focus, 'w': '0.12'}, {'t': array_to_string(paths, ' '), 'w': '0.08'}]", 3)
    + " AS semantic, "
    + _subs("[{'t': phrase, 'w': '0.25'}, {'t': both_, 'w': '0.15'}, {'t': any_, 'w': '0.0'}, {'t': path_, 'w': '0.1'}]", 4)
    + " AS lexical FROM g"
)


@query(PLAN)
def query_plans(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", N.query_plan(F.col("text")).alias("p")).select("item_id", "p.focus", F.to_json("p.semantic").alias("semantic"), F.to_json("p.lexical").alias("lexical"))


@query("WITH q AS (SELECT conv_id, turn, lower(trim(text)) AS q FROM conversations) SELECT conv_id, turn, starts_with(q, 'open ') OR starts_with(q, 'launch ') OR starts_with(q, '/open ') OR contains(q, ' open ') OR contains(q, ' launch ') AS opens FROM q")
def open_intent(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", N.opens(F.col("text")).alias("opens"))


@query(f"WITH r(root) AS (VALUES ('/corpus'), ('/corpus/src1'), ('/corpus/src1/en'), ('/other')), p AS (SELECT {PATH} AS absolute_path FROM documents) SELECT absolute_path, arg_max(root, length(root)) AS root FROM p LEFT JOIN r ON starts_with(absolute_path, root || '/') GROUP BY 1")
def source_roots(spark, sf):
    p = F.col("absolute_path")
    return corpus(spark, sf).select(p, C.source_root(p, ROOTS).alias("root"))


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'own' WHEN d.doc_id % 5 = 0 THEN 'low' END AS record FROM documents d")
def alias_lookup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("D"), "doc_id").alias("path"))
    stored = d.where("doc_id % 3 = 0").select("path", F.lit("own").alias("record")).unionByName(d.where("doc_id % 5 = 0").select(F.lower("path").alias("path"), F.lit("low").alias("record")))
    return S.alias_lookup(d.withColumn("aliases", F.array("path", F.lower("path"), "path")), stored, "path", "aliases", "record").select(F.substr("path", F.lit(2)).cast("long").alias("doc_id"), "record")


@query("WITH k AS (SELECT text, min(doc_id) AS source_doc FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, source_doc FROM documents LEFT JOIN k USING (text)")
def text_cache(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.md5("text").alias("fp"))
    cache = d.where("doc_id % 2 = 0").groupBy("fp", "text").agg(F.min("doc_id").alias("source_doc"))
    return index.reuse(d, cache, ["fp", "text"], "source_doc").select("doc_id", "source_doc")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 4 <> 0 THEN s_nationkey ELSE -1 END AS bound FROM supplier")
def reference_repair(spark, sf):
    return S.resolve_reference(table(spark, sf, "supplier"), "s_nationkey", table(spark, sf, "nation").where("n_nationkey % 4 <> 0"), "n_nationkey", "-1").select("s_suppkey", F.col("bound").cast("int").alias("bound"))


@query("""WITH s AS (SELECT conv_id, max(turn) AS u FROM conversations GROUP BY 1), r AS (SELECT conv_id, u + conv_id % 4 - 1 AS u FROM s WHERE conv_id % 5 <> 0), c AS (SELECT * FROM s WHERE conv_id % 3 <> 0 AND (conv_id % 2 = 1 OR conv_id IN (SELECT conv_id FROM r)))
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, CASE WHEN c.u IS NULL OR r.u > c.u THEN r.u ELSE c.u END AS updated FROM c FULL JOIN r ON c.conv_id = r.conv_id ORDER BY 2 DESC, 1 LIMIT 16""")
def session_merge(spark, sf):
    s = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"))
    kept = s.where("conv_id % 5 <> 0").withColumn("updated", F.expr("updated + conv_id % 4 - 1"))
    now = s.where("conv_id % 3 <> 0")
    lost = now.where("conv_id % 2 = 0").join(kept, "conv_id", "left_anti").select("conv_id")
    both = now.join(lost, "conv_id", "left_anti").withColumn("own", F.lit(1)).unionByName(kept.withColumn("own", F.lit(0)))
    return both.groupBy("conv_id").agg(F.max("updated").alias("updated")).orderBy(F.desc("updated"), "conv_id").limit(16)


@query("SELECT l_orderkey, count(*) AS n_hits, count(DISTINCT l_suppkey) AS n_files, array_to_string(list_slice(list_sort(list(DISTINCT l_suppkey)), 1, 3), ', ') AS first_files FROM lineitem GROUP BY 1")
def citation_counts(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey")))
    few = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("l_suppkey"))))
    return g.groupBy("l_orderkey").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_files"), F.array_join(F.transform(few, lambda x: x.cast("string")), ", ").alias("first_files"))


@query(f"WITH p AS (SELECT source, min(string_split({PATH}, '/')) AS a, max(string_split({PATH}, '/')) AS b FROM documents GROUP BY 1) SELECT source, array_to_string(a[1:len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))], '/') AS prefix FROM p")
def common_headings(spark, sf):
    p = corpus(spark, sf).select("source", F.split("absolute_path", "/").alias("p"))
    return S.group_prefix(p, "source", "p").select("source", F.array_join("prefix", "/").alias("prefix"))


@query("WITH n AS (SELECT user_id, count_if(event_type = 'view') > 0 AS s, count_if(event_type = 'click') > 0 AS r, count_if(event_type = 'purchase') > 0 AS o FROM events GROUP BY 1) SELECT user_id, CASE WHEN s AND r THEN 'searching and reading' WHEN s AND o THEN 'searching and opening' WHEN s THEN 'searching' WHEN r AND o THEN 'reading and opening' WHEN r THEN 'reading' WHEN o THEN 'opening' ELSE 'running tools' END AS label FROM n")
def tool_progress(spark, sf):
    n = [F.count_if(F.col("event_type") == t) for t in ("view", "click", "purchase")]
    return table(spark, sf, "events").groupBy("user_id").agg(C.progress_label(*n).alias("label"))


@query(f"SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes, CAST(sum(strlen('doc-' || doc_id || '.md')) AS BIGINT) AS name_bytes, CAST(sum(strlen({PATH})) AS BIGINT) AS path_bytes FROM documents GROUP BY 1")
def byte_sizes(spark, sf):
    size = lambda c, n: F.sum(F.octet_length(c)).alias(n)
    return corpus(spark, sf).groupBy("lang").agg(size(F.col("text"), "text_bytes"), size(T.file_name(F.col("absolute_path")), "name_bytes"), size(F.col("absolute_path"), "path_bytes"))


@query("SELECT conv_id, max(turn) AS updated FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16")
def session_list(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated")).orderBy(F.desc("updated"), "conv_id").limit(16)


@query("WITH w AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id FROM w ORDER BY user_id = 1 DESC, last DESC, user_id LIMIT 4")
def lru_cache(spark, sf):
    w = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return w.orderBy(F.desc(F.col("user_id") == 1), F.desc("last"), "user_id").limit(4).select("user_id")


@query(f"WITH p AS (SELECT {PATH} AS path FROM documents UNION SELECT '/corpus/' || source || '/de' FROM documents WHERE lang = 'de') SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(p.path, q.path || '/'))")
def nested_paths(spark, sf):
    c = corpus(spark, sf)
    return S.outermost(c.select(F.col("absolute_path").alias("path")).unionByName(c.where("lang = 'de'").select(F.concat(F.lit("/corpus/"), "source", F.lit("/de")).alias("path"))))


@query("WITH v AS (SELECT p_partkey, [p_size, p_partkey % 5, 0, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END] AS a, [25, p_partkey % 7, 0, 1] AS b FROM part) SELECT p_partkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS sign FROM v")
def version_order(spark, sf):
    a = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 5).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "0-rc.1").otherwise("0"))
    b = F.concat(F.lit("v25."), F.col("p_partkey") % 7, F.lit(".0+build"))
    return table(spark, sf, "part").select("p_partkey", C.compare_versions(a, b).alias("sign"))


@query(f"SELECT {PATH} AS path FROM documents WHERE starts_with({PATH}, '/corpus/src1/') UNION SELECT {PATH} FROM documents WHERE doc_id = 3 ORDER BY 1")
def path_union(spark, sf):
    c = corpus(spark, sf).select("doc_id", F.col("absolute_path").alias("path"))
    return c.where(F.startswith("path", F.lit("/corpus/src1/"))).select("path").union(c.where("doc_id = 3").select("path")).distinct().orderBy("path")


CHUNKS = "c AS (SELECT doc_id // 2 AS path, 'v' || doc_id % 2 AS version, CASE WHEN doc_id % 2 = 0 THEN 'active' ELSE 'staged' END AS chunk_state FROM documents)"


def _chunks(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id div 2 path", "concat('v', doc_id % 2) version", "case when doc_id % 2 = 0 then 'active' else 'staged' end chunk_state")


@query(f"WITH {CHUNKS} SELECT path, version, CASE WHEN path % 3 = 0 THEN 'active' ELSE chunk_state END AS chunk_state FROM c WHERE path % 3 <> 0 OR version = 'v1'")
def chunk_activation(spark, sf):
    c = _chunks(spark, sf)
    return S.activate(c, c.where("path % 3 = 0").select("path").distinct().withColumn("version", F.lit("v1")))


@query("SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS active_version, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'new' END AS pending_version, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN n_chars ELSE 0 END AS chunk_count FROM documents")
def finalize_records(spark, sf):
    d = table(spark, sf, "documents")
    r = d.select(F.col("doc_id").alias("path"), F.lit("old").alias("active_version"), F.when(F.col("doc_id") % 2 == 0, "new").alias("pending_version"), F.lit(0).cast("long").alias("chunk_count"))
    return S.finalize(r, d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("n")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'moved' ELSE s_name END AS s_name FROM supplier")
def projection_refresh(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return S.refresh(s, s.where("s_suppkey % 2 = 0").withColumn("s_name", F.lit("moved")), "s_suppkey", "s_name")


@query("WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1), l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 <> 1) SELECT (SELECT count(*) FROM o) AS n_files, (SELECT bit_xor(o_orderkey) FROM o) AS file_xor, (SELECT count(*) FROM l) AS n_chunks, (SELECT bit_xor(l_orderkey) FROM l) AS chunk_xor")
def cascade_delete(spark, sf):
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    f, c = S.cascade([files, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))], files.where("k % 4 = 1"), "k")
    n = [d.agg(F.count(F.lit(1)).alias(f"n_{name}s"), F.expr("bit_xor(k)").alias(f"{name}_xor")) for d, name in ((f, "file"), (c, "chunk"))]
    return n[0].join(n[1], F.lit(True))


FLAGS = ["artifacts", "schema_ok", "files_ok", "same_target", "chunk_table", "file_rows", "active_files", "active_chunks", "usable", "recoverable", "dirty"]


@query("WITH x AS (SELECT event_id, event_id * 40503 % 2048 AS state FROM events), f AS (SELECT event_id, " + ", ".join(f"(state >> {i}) & 1 = 1 AS {x}" for i, x in enumerate(FLAGS)) + """ FROM x)
SELECT event_id, CASE WHEN (artifacts AND NOT schema_ok) OR NOT files_ok OR NOT same_target OR (artifacts AND NOT chunk_table) THEN 'reset' WHEN chunk_table AND NOT file_rows THEN 'clear_index' WHEN file_rows AND NOT chunk_table THEN 'reset' WHEN active_files AND NOT active_chunks THEN 'reset'
WHEN active_chunks AND NOT usable AND recoverable THEN 'rebuild' WHEN active_chunks AND NOT usable THEN 'reset' WHEN dirty THEN 'clear_marker' ELSE 'keep' END AS decision FROM f""")
def store_reset(spark, sf):
    """What to do with the store that each event reports on, its findings in the bits of a number."""
    e = table(spark, sf, "events").select("event_id", (F.col("event_id").cast("long") * 40503 % 2048).alias("state"))
    return e.select("event_id", S.reset_decision(*[F.getbit("state", F.lit(i)) == 1 for i in range(len(FLAGS))]).alias("decision"))


@query("""WITH t(target) AS (VALUES ('pid:12'), ('PID: 99999999'), ('customer#000000005'), (' Building '), ('nope')), p AS (SELECT c_custkey AS pid, lower(c_name) AS a, lower(c_mktsegment) AS b FROM customer),
m AS (SELECT target, pid FROM t LEFT JOIN p ON CASE WHEN starts_with(lower(trim(target)), 'pid:') THEN pid = CAST(trim(substr(trim(target), 5)) AS BIGINT) ELSE lower(trim(target)) IN (a, b) END)
SELECT target, CASE count(pid) WHEN 0 THEN 'not_found' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN count(pid) = 1 THEN min(pid) END AS pid FROM m GROUP BY 1""")
def kill_target(spark, sf):
    t = spark.createDataFrame([(x,) for x in ("pid:12", "PID: 99999999", "customer#000000005", " Building ", "nope")], "target string")
    t = t.select("target", F.regexp_extract(F.trim("target"), r"^(?:pid|PID):\s*(\d+)$", 1).alias("d"))
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.lower("c_name").alias("a"), F.lower("c_mktsegment").alias("b"))
    # keys of a record: its id and its names; an equal join with the few targets
    keys = p.select("pid", F.explode(F.array_distinct(F.array(F.concat(F.lit("pid:"), "pid"), "a", "b"))).alias("k"))
    want = t.select("target", F.when(F.col("d") != "", F.concat(F.lit("pid:"), F.col("d").cast("long"))).otherwise(F.lower(F.trim("target"))).alias("k"))
    m = keys.join(F.broadcast(want), "k").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("pid"))
    n = F.coalesce("n", F.lit(0))
    return t.join(m, "target", "left").select("target", F.when(n == 0, "not_found").when(n == 1, "unique").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("pid")).alias("pid"))


@query(r"SELECT item_id, CASE WHEN item_id % 4 <> 3 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END AS payload FROM benchmark")
def command_payload(spark, sf):
    m, t = F.col("item_id") % 4, F.col("text")
    typed = F.when(m == 0, F.concat(F.lit("/tr "), t)).when(m == 1, F.concat(F.lit("  /translate\n"), t)).when(m == 2, F.concat(F.lit("/transl "), t)).otherwise(F.concat(F.lit("say "), t))
    return table(spark, sf, "benchmark").select("item_id", C.command_payload(typed, ALIASES).alias("payload"))


@query(r"SELECT item_id, '/translate' AS alias, regexp_replace(text, '^\s+|\s+$', '', 'g') AS payload FROM benchmark")
def slash_commands(spark, sf):
    t = F.concat(F.when(F.col("item_id") % 2 == 0, "/translate ").otherwise(" /TRANS\t"), "text")
    return table(spark, sf, "benchmark").select("item_id", C.slash_parser(ALIASES)(t).alias("p")).select("item_id", "p.alias", "p.payload")


@query()
def preview_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.preview_summary("text").alias("preview"))


@query("SELECT item_id, trim(text) AS content FROM benchmark")
def translation_answer(spark, sf):
    t = F.concat(F.lit("Analysis: the input. Final translation: "), "text")
    return table(spark, sf, "benchmark").select("item_id", B.translation_answer(t).alias("x")).select("item_id", "x.content")


@query("SELECT conv_id, turn, nullif(text, '') AS content, 'stop' AS finish_reason FROM conversations")
def event_stream_fold(spark, sf):
    t, half = F.col("text"), (F.length("text") / 2).cast("int")
    chunk = lambda c, end: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(c.alias("content")).alias("delta"), end.alias("finish_reason"))).alias("choices"))), F.lit("\r\n\r\n"))
    body = F.concat(chunk(F.substr(t, F.lit(1), half), F.lit(None).cast("string")), chunk(F.substr(t, half + 1), F.lit("stop")), F.lit("data: [DONE]\n\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", B.fold_body(body).alias("a")).select("conv_id", "turn", "a.content", "a.finish_reason")


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> ''), '|') AS segments FROM documents")
def query_segments(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.segments(F.col("text")), "|").alias("segments"))


@query("SELECT p_partkey, 'data:image/png;base64,' || to_base64(encode(p_name)) AS url FROM part")
def data_urls(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.data_url(T.image_mime(F.lit("/a/x.PNG")), F.encode("p_name", "UTF-8")).alias("url"))


@query("SELECT doc_id, '/corpus > /corpus/' || source || ' > /corpus/' || source || '/' || lang AS crumbs, '/corpus/' || source AS up FROM documents")
def path_crumbs(spark, sf):
    p = T.parent(F.col("absolute_path"))
    return corpus(spark, sf).select("doc_id", F.array_join(C.breadcrumbs(p), " > ").alias("crumbs"), C.normal_path(F.concat(p, F.lit("/./x/../.."))).alias("up"))


@query("SELECT event_id, event_type <> 'view' AND user_id % 4 <> 0 AND NOT (event_id % 3 = 0 AND event_id % 5 < 2) AND user_id % 7 <> 1 AS notify FROM events")
def notification_gate(spark, sf):
    """Whether an event tells its user: one kind never does, some users have turned it off, some refuse it, some hear only when away."""
    u, i = F.col("user_id"), F.col("event_id")
    gate = C.may_notify(u % 4 != 0, F.col("event_type") != "view", i % 3 == 0, i % 5 < 2, F.when(u % 7 == 1, "denied").otherwise("granted"))
    return table(spark, sf, "events").select("event_id", gate.alias("notify"))


@query("WITH x AS (SELECT s_suppkey, ['responses', 'chat', 'embedding'][CAST(s_suppkey % 3 AS INT) + 1] AS k, s_nationkey % 2 = 1 AS c, s_suppkey % 5 < 2 AS m, s_acctbal > 0 AS s FROM supplier) SELECT s_suppkey, k <> 'embedding' AND c AS ai_task, k = 'responses' AND c AND m AS ocr, k = 'embedding' AND c AS embedding, k = 'embedding' AND c AND m AS multimodal_embedding, k = 'responses' AND m AS multimodal, k = 'responses' AND s AS stateful FROM x")
def model_capabilities(spark, sf):
    """Suppliers stand for models of three kinds."""
    k = F.element_at(F.array(*map(F.lit, ("responses", "chat", "embedding"))), (F.col("s_suppkey") % 3).cast("int") + 1)
    x = C.capabilities(k, F.col("s_nationkey") % 2 == 1, F.col("s_suppkey") % 5 < 2, F.col("s_acctbal") > 0)
    return table(spark, sf, "supplier").select("s_suppkey", x.alias("x")).select("s_suppkey", "x.*")


@query("SELECT s_nationkey, s_name AS id, 'digest:hex:' || md5(s_name) AS hint FROM supplier")
def model_listing(spark, sf):
    s = table(spark, sf, "supplier")
    row = F.struct(F.concat(F.lit(" "), "s_name").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.upper(F.md5("s_name"))).alias("digest"), F.struct(F.md5("s_name").alias("sha256")).alias("details"))
    payload = s.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 50)).agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("j"))  # a listing of 50 models at most
    item = payload.select("s_nationkey", F.posexplode(F.from_json("j", "data array<string>").data).alias("at", "m"))
    hint = F.lower(F.trim(F.coalesce(*[F.get_json_object("m", f"$.{p}{k}") for p in ("", "details.", "metadata.") for k in ("digest", "sha256", "checksum", "fingerprint")])))
    hint = F.when(hint.rlike("^[a-z0-9_-]+:[0-9a-f]{16,}$"), F.concat(F.lit("digest:"), hint)).when(hint.rlike("^[0-9a-f]{16,}$"), F.concat(F.lit("digest:hex:"), hint))
    x = item.select("s_nationkey", "at", F.trim(F.get_json_object("m", "$.id")).alias("id"), hint.alias("hint")).where("id <> ''")
    return x.groupBy("s_nationkey", "id").agg(F.min_by("hint", F.when(F.col("hint").isNotNull(), F.col("at"))).alias("hint"))


@query("WITH s AS (SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS slug, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS id FROM s")
def allocated_ids(spark, sf):
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-"), "^-|-$", "")
    n = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", slug.alias("slug")).select("p_partkey", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))).alias("id"))


@query("SELECT conv_id, turn, CASE WHEN text <> '' THEN 'content,' ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'actions,' ELSE '' END || CASE WHEN trim(role) <> '' THEN 'thought,' ELSE '' END AS kinds, nullif(trim(text), '') AS selected FROM conversations")
def answer_blocks(spark, sf):
    parts = F.filter(F.array(F.when(F.col("text") != "", "content"), F.when(F.col("turn") % 2 == 0, "actions"), F.when(F.trim("role") != "", "thought")), lambda x: x.isNotNull())
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit(","))), "").alias("kinds"), F.nullif(F.trim("text"), F.lit("")).alias("selected"))


@query("WITH c AS (SELECT DISTINCT left(p_name, 4) AS prefix FROM part WHERE p_partkey % 10 = 0 UNION SELECT DISTINCT left(p_name, 8) FROM part WHERE p_partkey % 20 = 0), m AS (SELECT p_partkey, max(length(prefix)) AS n FROM part LEFT JOIN c ON starts_with(p_name, prefix) GROUP BY 1) SELECT p_partkey, left(p_name, n) AS prefix FROM part JOIN m USING (p_partkey)")
def prefix_cache(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    cache = p.where("p_partkey % 10 = 0").select(F.substring("p_name", 1, 4).alias("prefix")).unionByName(p.where("p_partkey % 20 = 0").select(F.substring("p_name", 1, 8).alias("prefix")))
    return S.longest_prefix(p, "p_name", cache, "prefix").select("p_partkey", "prefix")


@query("SELECT event_id, CASE WHEN age <= 15000 THEN 'fresh' WHEN age <= 90000 THEN 'stale' ELSE 'expired' END AS state FROM (SELECT event_id, event_id * 100 AS age FROM events)")
def cache_states(spark, sf):
    return table(spark, sf, "events").select("event_id", C.cache_state(F.col("event_id") * 100, 15_000, 75_000).alias("state"))


@query("SELECT lang || '/' || n_chars || '.md' AS rel, min('/corpus/' || source) AS root FROM documents GROUP BY 1 HAVING count(*) = 1")
def unique_relative(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("/", "lang", F.concat(F.col("n_chars"), F.lit(".md"))).alias("rel"), F.concat(F.lit("/corpus/"), "source").alias("root"))
    return d.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("root")).where("n = 1").drop("n")


@query("""WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS r FROM events),
f AS (SELECT user_id, r, ms, ms AS first FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, e.ms, CASE WHEN e.ms - f.first >= 3600000 THEN e.ms ELSE f.first END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, count(*) AS n_events, first AS first_ms, max(ms) AS last_ms FROM f GROUP BY user_id, first""")
def deadline_batches(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return Z.deadline_batches(e, "user_id", "ms", "event_id", 3_600_000)


@query("""WITH RECURSIVE e AS (SELECT user_id AS device, (epoch_us(ts) // 1000) AS at_ms, event_type AS text, CASE WHEN event_id % 2 = 0 THEN event_id END AS counter, event_id % 7 = 0 AS own FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY at_ms, counter NULLS FIRST) AS r FROM e),
f AS (SELECT DISTINCT device, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS counter, CAST(NULL AS VARCHAR) AS last, CAST(NULL AS VARCHAR) AS mute, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS at_ms, CAST(NULL AS VARCHAR) AS shown FROM o
  UNION ALL SELECT device, r, CASE WHEN own OR dup THEN was ELSE counter END, CASE WHEN own OR dup THEN last WHEN blank THEN NULL ELSE text END, CASE WHEN own THEN text WHEN act AND (at_ms > until OR mute = text) THEN NULL ELSE mute END, CASE WHEN own THEN at_ms + 2000 ELSE until END, at_ms,
    CASE WHEN act AND NOT coalesce(mute = text AND at_ms <= until, false) THEN text END
  FROM (SELECT *, NOT own AND NOT dup AND NOT blank AND NOT coalesce(counter IS NULL AND text = last, false) AS act FROM (SELECT o.*, f.counter AS was, f.last, f.mute, f.until, NOT o.own AND coalesce(o.counter = f.counter, false) AS dup, trim(o.text) = '' AS blank FROM f JOIN o ON o.device = f.device AND o.r = f.r + 1)))
SELECT device, at_ms, shown AS text FROM f WHERE shown IS NOT NULL""")
def clipboard_polls(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("device"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("counter"), (F.col("event_id") % 7 == 0).alias("own"))
    return Z.clipboard_polls(e)


@query("""WITH RECURSIVE e AS (SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'ready' WHEN 'click' THEN 'prompt' WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'exit' END AS kind, props AS detail, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS seq, 'starting' AS status, CAST(NULL AS VARCHAR) AS last_error, false AS refused FROM e
  UNION ALL SELECT e.session_id, e.r, e.seq, CASE WHEN status = 'exited' THEN 'exited' WHEN kind = 'ready' AND status = 'starting' THEN 'idle' WHEN kind = 'prompt' AND status IN ('idle', 'error') THEN 'running' WHEN kind = 'finished' THEN 'idle' WHEN kind = 'failed' THEN 'error' WHEN kind = 'exit' THEN 'exited' ELSE status END,
    CASE WHEN status = 'exited' THEN last_error WHEN kind = 'prompt' AND status IN ('idle', 'error') THEN NULL WHEN kind = 'finished' THEN NULL WHEN kind = 'failed' THEN detail ELSE last_error END, status = 'exited' OR (kind = 'prompt' AND status NOT IN ('idle', 'error'))
  FROM f JOIN e ON e.session_id = f.session_id AND e.r = f.r + 1)
SELECT session_id, seq, status, status = 'error' AS attention, last_error, refused FROM f WHERE r > 0""")
def session_states(spark, sf):
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("view", "ready"), ("click", "prompt"), ("purchase", "finished"), ("error", "failed"), ("signup", "exit")) for x in p]), F.col("event_type"))
    return Z.session_states(table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("detail")))


@query(r"""WITH d AS (SELECT conv_id, turn, text, CASE turn WHEN 0 THEN 'Thinking process: ' || text WHEN 1 THEN ' Final Translation: ** ' || text ELSE text || chr(10) END AS delta FROM conversations),
r AS (SELECT conv_id, turn, string_agg(CASE WHEN turn = 1 THEN text WHEN turn > 1 THEN delta ELSE '' END, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn) AS raw, max(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, min(turn) OVER (PARTITION BY conv_id) AS first FROM d),
v AS (SELECT conv_id, turn, CASE WHEN upto >= 1 AND first = 0 THEN regexp_replace(raw, '^\s+|\s+$', '', 'g') ELSE '' END AS shown FROM r),
p AS (SELECT conv_id, turn, shown, coalesce(lag(shown) OVER (PARTITION BY conv_id ORDER BY turn), '') AS had FROM v)
SELECT conv_id AS id, CAST(turn AS BIGINT) AS seq, substr(shown, length(had) + 1) AS delta FROM p WHERE length(shown) > length(had)""")
def visible_translation(spark, sf):
    """Conversations that begin with reasoning and go on with a labelled translation: what each turn adds to what a reader sees."""
    t = F.col("text")
    delta = F.when(F.col("turn") == 0, F.concat(F.lit("Thinking process: "), t)).when(F.col("turn") == 1, F.concat(F.lit(" Final Translation: ** "), t)).otherwise(F.concat(t, F.lit("\n")))
    return Z.visible_deltas(table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("seq"), delta.alias("delta")))


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(range(len(ls))) AS r, greatest(length(unnest(ls)), 1) AS n FROM l),
f AS (SELECT doc_id, r, 4 AS size, 0 AS clean, 1 AS items, n AS chars, CAST(0 AS BIGINT) AS batch FROM e WHERE r = 0
  UNION ALL SELECT doc_id, r, CASE WHEN full_ AND up AND clean = 2 THEN least(32, size + greatest(1, size // 4)) ELSE size END, CASE WHEN full_ AND up THEN (clean + 1) % 3 ELSE clean END, CASE WHEN full_ THEN 1 ELSE items + 1 END, CASE WHEN full_ THEN n ELSE chars + n END, batch + CASE WHEN full_ THEN 1 ELSE 0 END
  FROM (SELECT e.doc_id, e.r, e.n, f.size, f.clean, f.items, f.chars, f.batch, f.items >= f.size AS up, f.items >= f.size OR f.chars >= 4800 OR f.chars + e.n > 4800 AS full_ FROM f JOIN e ON e.doc_id = f.doc_id AND e.r = f.r + 1))
SELECT doc_id, CAST(r AS INT) AS line_no, batch FROM f""")
def embedding_batches(spark, sf):
    # chunks of every file, in order: its lines stand for them
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return Z.embedding_batches(lines.select("doc_id", "line_no", F.length("line").alias("n_chars")), "doc_id", "line_no", "n_chars")


@query()
def page_chunks(spark, sf):
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10).cast("int")), lambda i: F.slice(lines, i * 10 + 1, F.lit(10)))
    return G.page_chunks(table(spark, sf, "documents").select("doc_id", pages.alias("pages")))

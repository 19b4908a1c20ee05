"""Queries on paths, digests, warnings, completions and tool answers; they join the catalog when imported."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..catalog import PATH, PLAIN_CHUNKS, query
from ..functions import predicates as P, text as T, tools
from ..operators import chunk, index, snapshots
from ..sources.tables import corpus, table

FOLDERS = ["src", "node_modules", "a/.git", "build", "rebuild", "x/target", ".venv", "docs"]
FOLDER_PATH = "'/corpus/' || CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FOLDERS)) + " END || '/f' || event_id || '.md'"


IGNORED = r"regexp_matches(substr(path, 9), '(^|/)(\.git|node_modules|vendor|Pods|target|dist|build|out|\.next|\.nuxt|\.svelte-kit|\.turbo|\.cache|coverage|\.venv|venv)/')"


@query(f"WITH p AS (SELECT event_id, {FOLDER_PATH} AS path FROM events), r AS (SELECT unnest(['/corpus/src', '/corpus/rebuild', '/corpus/doc']) AS root) SELECT event_id, {IGNORED} AS skipped, bool_or(path = root OR starts_with(path, root || '/')) AS contained FROM p, r GROUP BY event_id, path")
def default_ignores(spark, sf):
    p = F.expr(FOLDER_PATH)
    return table(spark, sf, "events").select("event_id", P.skipped(p, F.lit("/corpus")).alias("skipped"), P.within_roots(p, ["/corpus/src/", "/corpus/rebuild", "/corpus/doc"]).alias("contained"))


@query(f"""WITH e AS (SELECT event_id, {FOLDER_PATH} AS path, event_type <> 'error' AS there FROM events)
SELECT event_id, CASE WHEN {IGNORED} THEN NULL WHEN there THEN 'rescan' ELSE 'remove' END AS action, CASE WHEN NOT {IGNORED} THEN path END AS target FROM e""")
def update_targets(spark, sf):
    p, root = F.expr(FOLDER_PATH), F.lit("/corpus")
    u = tools.update_target(root, p, F.col("event_type") != "error", P.skipped(p, root))
    return table(spark, sf, "events").select("event_id", u.alias("u")).select("event_id", "u.action", "u.target")


KEYS = "bit_xor(vec_id) AS key_xor, CAST(sum(vec_id) AS DECIMAL(20, 0)) AS key_sum, bit_xor(h) AS hash_xor, CAST(sum(CAST(h AS HUGEINT)) % 18446744073709551616 AS DECIMAL(20, 0)) AS hash_sum"


@query(f"WITH k AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST('0x' || left(md5(CAST(vec_id AS VARCHAR)), 15) AS BIGINT) AS h FROM embeddings WHERE vec_id % 6 <> 0 AND (vec_id % 2 = 0 OR vec_id % 3 = 1)) SELECT count(*) AS n, {KEYS} FROM k")
def digest_delta(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    now = index.digest(e.where("vec_id % 2 = 0"), "vec_id")
    return index.digest_after(now, e.where("vec_id % 2 = 1 and vec_id % 3 = 1"), e.where("vec_id % 6 = 0"), "vec_id")


@query("""WITH w AS (SELECT lang, doc_id, 'empty line in ' || doc_id AS warning, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents WHERE contains(text, chr(10) || chr(10))),
n AS (SELECT lang, count(*) AS warnings, string_agg(CASE WHEN r <= 5 THEN warning END, '; ' ORDER BY doc_id) AS recent FROM w GROUP BY lang),
p AS (SELECT lang, list(doc_id ORDER BY doc_id) AS ids FROM w GROUP BY lang)
SELECT lang, scanned, coalesce(warnings, 0) AS warnings, coalesce(recent, '') AS recent, CASE WHEN ids IS NULL THEN '' ELSE ' (pages ' || array_to_string(ids[1:3], ', ') || CASE WHEN len(ids) > 3 THEN ', ...' ELSE '' END || ')' END AS pages
FROM (SELECT lang, count(*) AS scanned FROM documents GROUP BY lang) LEFT JOIN n USING (lang) LEFT JOIN p USING (lang)""")
def scan_warnings(spark, sf):
    d = table(spark, sf, "documents").select("lang", "doc_id", F.contains("text", F.lit("\n\n")).alias("bad"))
    bad, by = d.where("bad").select("lang", "doc_id"), Window.partitionBy("lang")
    # each task hands on the few rows of a language that may be among the last or first
    last = bad.withColumn("r", F.row_number().over(by.orderBy(F.desc("doc_id")))).where("r <= 5")
    first = bad.withColumn("r", F.row_number().over(by.orderBy("doc_id"))).where("r <= 4")
    recent = last.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: F.concat(F.lit("empty line in "), i)), "; ").alias("recent"))
    pages = first.groupBy("lang").agg(tools.warning_pages(F.array_sort(F.collect_list("doc_id"))).alias("pages"))
    n = d.groupBy("lang").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("bad").alias("warnings"))
    return n.join(recent, "lang", "left").join(pages, "lang", "left").select("lang", "scanned", "warnings", F.coalesce("recent", F.lit("")).alias("recent"), F.coalesce("pages", F.lit("")).alias("pages"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_partkey % 50 AS y, l_suppkey % 20 AS w, l_linenumber * 3 AS h FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, (x + w / 2 - 25) ** 2 + (y + h / 2 - 25) ** 2 + CASE WHEN 25 BETWEEN x AND x + w AND 25 BETWEEN y AND y + h THEN 0 ELSE 10 END AS s FROM b)
SELECT l_orderkey, arg_min(l_linenumber, {'s': s, 'n': l_linenumber}) AS block, round(min(s), 4) AS score FROM s GROUP BY l_orderkey""")
def nearest_block(spark, sf):
    f = lambda c: F.expr(c).cast("double")
    s = tools.focus_score(f("l_quantity"), f("l_partkey % 50"), f("l_suppkey % 20"), f("l_linenumber * 3"), F.lit(25.0), F.lit(25.0))
    b = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s"))
    return b.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("s", "l_linenumber")).alias("block"), F.round(F.min("s"), 4).alias("score"))


SUFFIXES = ["png", "JPG", "jpeg", "Gif", "webp", "txt"]


@query(rf"""WITH e AS (SELECT p_partkey, lower(regexp_extract('/a.b/x' || coalesce('.' || {SUFFIXES}[CAST(p_partkey % 7 AS INT) + 1], ''), '\.([^./]+)$', 1)) AS ext FROM part)
SELECT p_partkey, CASE WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext IN ('png', 'gif', 'webp', 'bmp') THEN 'image/' || ext ELSE 'application/octet-stream' END AS mime FROM e""")
def image_types(spark, sf):
    name = F.concat(F.lit("/a.b/x"), F.coalesce(F.concat(F.lit("."), F.get(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % 7).cast("int"))), F.lit("")))
    return table(spark, sf, "part").select("p_partkey", T.image_mime(name).alias("mime"))


@query("""WITH t AS (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' /CHO' WHEN 2 THEN upper(left(c_name, 12)) ELSE 'zzz' END AS typed, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS pid FROM customer), l AS (SELECT *, lower(trim(typed)) AS low FROM t)
SELECT c_custkey, CASE WHEN low = '' OR starts_with('/pick', low) THEN '/pick' WHEN starts_with('/choose', low) THEN '/Choose' WHEN starts_with(lower(c_name), low) THEN c_name END AS action, CASE WHEN length(typed) > 0 THEN '/bin/' || c_custkey END AS file, 'pid:' || pid AS kill FROM l""")
def completions(spark, sf):
    m = F.col("c_custkey") % 4
    typed = F.when(m == 0, "").when(m == 1, " /CHO").when(m == 2, F.upper(F.substring("c_name", 1, 12))).otherwise("zzz")
    pid = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", tools.action_completion(typed, F.col("c_name"), F.array(F.lit("/pick"), F.lit("/Choose"))).alias("action"), tools.file_completion(typed, F.concat(F.lit("/bin/"), "c_custkey")).alias("file"), tools.kill_completion(pid).alias("kill"))


@query(r"""SELECT s_suppkey, '{"content":[{"type":"text","text":"no ' || s_name || '"},{"type":"text","text":"{\n  \"error\": \"no ' || s_name || '\"\n}"}],"structuredContent":{"error":"no ' || s_name || '"},"isError":true}' AS failed,
'{"content":[{"type":"text","text":"' || s_name || '"},{"type":"text","text":"{}"}],"structuredContent":{"key":' || s_suppkey || '},"isError":false}' AS answered,
'{"content":[{"type":"text","text":"wait"},{"type":"text","text":"{\n  \"key\": ' || s_suppkey || ',\n  \"name\": \"' || s_name || '\"\n}"}],"structuredContent":{"name":"' || s_name || '","key":' || s_suppkey || '},"isError":false}' AS pending FROM supplier""")
def tool_results(spark, sf):
    name = F.col("s_name")
    return table(spark, sf, "supplier").select("s_suppkey", tools.error_envelope(F.concat(F.lit("no "), name)).alias("failed"), tools.envelope(name, F.to_json(F.struct(F.col("s_suppkey").alias("key"))), F.lit("{}"), False).alias("answered"), tools.pending_envelope(F.lit("wait"), F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")))).alias("pending"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def active_chunks(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "active").otherwise("pending").alias("chunk_state"))
    return snapshots.active(o).select("o_orderkey")


@query(f"""WITH e AS (SELECT DISTINCT event_id % 1500 AS d FROM events), c AS (SELECT doc_id, {PATH} AS absolute_path, text, doc_id * 1000 AS m FROM documents)
SELECT CASE WHEN absolute_path IS NULL THEN '/corpus/none/' || d ELSE absolute_path END AS absolute_path, CASE WHEN absolute_path IS NULL THEN 'noop' WHEN d % 11 = 4 THEN CASE WHEN d % 3 <> 0 THEN 'delete' ELSE 'noop' END WHEN d % 3 <> 0 AND d % 5 <> 1 THEN 'unchanged' WHEN d % 3 <> 0 THEN 'refresh' ELSE 'reindex' END AS plan
FROM e LEFT JOIN c ON d = doc_id""")
def event_plans(spark, sf):
    c = corpus(spark, sf)
    e = table(spark, sf, "events").select((F.col("event_id") % 1500).alias("d"))
    e = e.join(c.select(F.col("doc_id").alias("d"), "absolute_path"), "d", "left").select(F.coalesce("absolute_path", F.concat(F.lit("/corpus/none/"), "d")).alias("absolute_path"))
    stored = c.where("doc_id % 3 <> 0").select("absolute_path", "size_bytes", F.when(F.col("doc_id") % 5 == 1, 0).otherwise(F.col("modified_at_ms")).alias("modified_at_ms"), "content_md5", F.lit("v1").alias("fingerprint"), F.lit(3).alias("chunk_count"))
    found = c.where("doc_id % 11 <> 4").withColumns({"fingerprint": F.lit("v1"), "eligible": F.lit(True), "has_text": F.lit(True)})
    return index.event_plans(e, stored, found, "absolute_path")


@query(PLAIN_CHUNKS + """ SELECT d.doc_id, CAST(1 + d.doc_id % 2 AS INT) AS chunk_index, start, chunk_text, CASE WHEN chunk_text IS NULL THEN 'chunk index ' || 1 + d.doc_id % 2 || ' does not exist' END AS error FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.chunk_index = 1 + d.doc_id % 2""")
def chunk_excerpts(spark, sf):
    """The second or third chunk of every document, and an error for those that have none."""
    d = table(spark, sf, "documents")
    return chunk.excerpts(d, d.select("doc_id", (F.col("doc_id") % 2 + 1).cast("int").alias("chunk_index")))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '@src' WHEN 1 THEN '@' WHEN 2 THEN '@a/b.md' END AS token FROM conversations")
def active_tokens(spark, sf):
    """The file token that is being typed at the end of a text, if one is."""
    m = F.col("turn") % 4
    t = F.when(m == 0, F.concat("text", F.lit(" see @src"))).when(m == 1, "(@").when(m == 2, F.concat("text", F.lit("\n\"@a/b.md"))).otherwise(F.concat("text", F.lit(" me@home and @x done")))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.active_token(t).alias("token"))


@query(f"""WITH l AS (SELECT doc_id, {PATH} AS path, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT path || '#v' || doc_id % 3 || ':' || i || ':0:0:' || i + 1 || ':' || i + 1 AS id, md5(lang || chr(31) || source || chr(0) || line) AS chunk_reuse_key, md5(line) AS text_fingerprint, 'staged' AS chunk_state FROM l""")
def chunk_rows(spark, sf):
    """Lines as chunks under two headings, as rows of their files' versions."""
    d = corpus(spark, sf)
    files = d.select("absolute_path", F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version_id")).distinct()
    none = F.lit(None).cast("int")
    chunks = d.select("absolute_path", F.array("lang", "source").alias("heading_path"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    chunks = chunks.withColumns({"line_start": F.col("chunk_index") + 1, "line_end": F.col("chunk_index") + 1, "page_start": none, "page_end": none})
    return index.chunk_rows(chunks, files).select("id", "chunk_reuse_key", "text_fingerprint", "chunk_state")

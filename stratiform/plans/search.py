"""Queries on the search and read tools and on watched paths; they join the catalog when imported."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..catalog import PATH, query
from ..functions import predicates as P, text as T, tools
from ..operators import embed, index
from ..sources.tables import corpus, table

# Tool calls made from the rows of benchmark, one kind for every remainder of the id.
CALLS = [
    '{"query": " ID "}',
    '{"query": "ID", "topK": 3, "minScore": 0.5}',
    '{"query": "  "}',
    '{"query": 5}',
    '{"query": "ID", "topK": 21}',
    '{"query": "ID", "topK": 2.5}',
    '{"query": "ID", "topK": -1}',
    '{"query": "ID", "minScore": "x"}',
    '{"query": "ID", "minScore": 1.5}',
    '{"query": "ID", "other": 1}',
    "[1]",
]


RAW_CALL = "CASE item_id % 12 " + " ".join(f"WHEN {i} THEN replace('{c}', 'ID', CAST(item_id AS VARCHAR))" for i, c in enumerate(CALLS)) + " END"


@query(f"""WITH r AS (SELECT item_id, {RAW_CALL} AS raw FROM benchmark), v AS (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM r),
o AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN list_filter(json_keys(j), lambda k: k NOT IN ('query', 'topK', 'minScore'))[1] END AS odd, CASE WHEN json_type(j, '$.query') = 'VARCHAR' THEN trim(j->>'$.query') END AS q, json_type(j, '$.topK') AS kt, TRY_CAST(j->>'$.topK' AS BIGINT) AS k, json_type(j, '$.minScore') AS st, TRY_CAST(j->>'$.minScore' AS DOUBLE) AS sc FROM v),
e AS (SELECT *, CASE WHEN raw IS NULL THEN 'tool arguments are required' WHEN json_type(j) IS DISTINCT FROM 'OBJECT' THEN 'tool arguments must be a JSON object' WHEN odd IS NOT NULL THEN 'unknown tool argument: ' || odd WHEN coalesce(q, '') = '' THEN 'query must be a non-empty string'
  WHEN kt IS NOT NULL AND kt <> 'UBIGINT' THEN 'topK must be an integer' WHEN kt IS NOT NULL AND NOT k BETWEEN 1 AND 20 THEN 'topK must be between 1 and 20' WHEN st IS NOT NULL AND st NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'minScore must be a number' WHEN st IS NOT NULL AND NOT sc BETWEEN 0 AND 1 THEN 'minScore must be between 0 and 1' END AS error FROM o)
SELECT item_id, error, CASE WHEN error IS NULL THEN q END AS query, CAST(CASE WHEN error IS NULL THEN coalesce(k, 8) END AS INT) AS top_k, CASE WHEN error IS NULL THEN coalesce(sc, 0.35) END AS min_score FROM e""")
def argument_checks(spark, sf):
    kind, name = F.col("item_id") % 12, F.col("item_id").cast("string")
    raw = None
    for i, c in enumerate(CALLS):
        raw = (F if raw is None else raw).when(kind == i, F.replace(F.lit(c), F.lit("ID"), name))
    return table(spark, sf, "benchmark").select("item_id", tools.search_arguments(raw).alias("a")).select("item_id", "a.*")


@query(r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls, greatest(doc_id % 7 - 1, 1) AS s, greatest(doc_id % 4 - 1, 1) AS n FROM documents WHERE text <> ''),
w AS (SELECT doc_id, s, list_transform(ls[s:s + n - 1], lambda x: regexp_replace(x, '\r$', '')) AS own FROM d)
SELECT doc_id, CAST(s AS INT) AS line_start, CAST(s + len(own) - 1 AS INT) AS line_end, CAST(len(own) AS INT) AS line_count, array_to_string(list_transform(own, lambda x, i: CAST(s + i - 1 AS VARCHAR) || ': ' || x), chr(10)) AS lines FROM w WHERE len(own) > 0""")
def line_windows(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tools.line_window(F.col("text"), F.col("doc_id") % 7 - 1, F.col("doc_id") % 4 - 1).alias("w")).where("w is not null").select("doc_id", "w.*")


@query(f"""WITH h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, {PATH} AS path, CASE doc_id % 3 WHEN 0 THEN 'page ' || doc_id WHEN 1 THEN 'lines ' || doc_id || '-' || (doc_id + 4) ELSE 'chunk ' || doc_id END AS loc, left(text, 40) AS t FROM documents),
x AS (SELECT source, r, chr(10) || '[' || r || '] ' || path || ' (chunk ' || doc_id || ', ' || loc || ', score ' || format('{{:.4f}}', 1 / CAST(r + 1 AS DOUBLE)) || ', distance ' || format('{{:.4f}}', CAST(r AS DOUBLE) / 3) || ')' || chr(10) || t || chr(10) AS h FROM h WHERE r <= 3),
g AS (SELECT source, string_agg(h, '' ORDER BY r) AS hs, count(*) AS n FROM x GROUP BY source)
SELECT source, regexp_replace('Retrieved ' || n || ' hit(s) for query "' || source || ' \\"a\\\\b\\"\\t".' || chr(10) || hs, '^\\s+|\\s+$', '', 'g') AS summary FROM g
UNION ALL SELECT 'none', 'Retrieved 0 hit(s) for query "none \\"a\\\\b\\"\\t".' || chr(10) || 'The RAG index still has pending files, so empty results may be temporary.'""")
def search_summary(spark, sf):
    i, m = F.col("doc_id"), F.col("doc_id") % 3
    place = T.location_label(F.when(m == 0, i), F.when(m == 0, i), F.when(m == 1, i), F.when(m == 1, i + 4), i)
    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    best = corpus(spark, sf).withColumn("r", r).where("r <= 3")
    text = tools.hit_text(F.col("r"), F.col("absolute_path"), i, place, 1 / (F.col("r") + 1).cast("double"), F.col("r").cast("double") / 3, F.substring("text", 1, 40))
    g = best.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))).alias("x")).select("source", F.transform("x", lambda s: s["t"]).alias("hits"))
    g = g.unionByName(spark.createDataFrame([("none", [])], "source string, hits array<string>"))
    return g.select("source", tools.search_summary(F.concat("source", F.lit(' "a\\b"\t')), F.col("hits"), F.lit(True)).alias("summary"))


WATCHED = "'/corpus/' || CASE event_id % 5 WHEN 0 THEN 'a/.gitignore' WHEN 1 THEN '.ignore' WHEN 2 THEN '.git/info/exclude' WHEN 3 THEN 'a/b.md' ELSE '../x/.ignore' END"


@query(f"""WITH p AS (SELECT event_id, {WATCHED} AS p FROM events)
SELECT event_id, CASE WHEN starts_with(p, '/corpus/') AND regexp_extract(p, '([^/]*)$', 1) IN ('.gitignore', '.ignore') THEN regexp_replace(p, '/[^/]*$', '') WHEN p = '/corpus/.git/info/exclude' THEN '/corpus' END AS scope FROM p""")
def rescan_targets(spark, sf):
    return table(spark, sf, "events").select("event_id", tools.rescan_scope(F.lit("/corpus"), F.expr(WATCHED)).alias("scope"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(^|\s)@\S*$') THEN 'file' WHEN trim(text) = '' THEN 'none' WHEN starts_with(text, 'kill ') THEN 'kill' WHEN starts_with(text, '/') OR starts_with(text, 'http') OR contains(text, '{') THEN 'action' WHEN len(regexp_extract_all(text, '[A-Za-z]')) >= 2 OR len(list_filter(regexp_extract_all(text, '\p{L}'), lambda x: strlen(x) > 1)) >= 1 THEN 'app' ELSE 'none' END AS mode FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'kill ' || text WHEN 1 THEN text || ' @src' WHEN 2 THEN '/' || text ELSE text END AS text FROM conversations)")
def query_modes(spark, sf):
    t, m = F.col("text"), F.col("turn") % 4
    t = F.when(m == 0, F.concat(F.lit("kill "), t)).when(m == 1, F.concat(t, F.lit(" @src"))).when(m == 2, F.concat(F.lit("/"), t)).otherwise(t)
    return table(spark, sf, "conversations").select("conv_id", "turn", P.mode(t).alias("mode"))


FAILURES = ["Request timed out", "HTTP 429 from server", "server is Overloaded", "read Timeout", "no route", "Rate limit; try again", "code 503", "429 after timeout"]


@query(f"""WITH m AS (SELECT event_id, lower({FAILURES}[CAST(event_id % 8 AS INT) + 1] || '; ' || event_type) AS m FROM events)
SELECT event_id, CASE WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'timeout' WHEN contains(m, '429') OR contains(m, 'rate limit') THEN 'rate_limit' WHEN contains(m, 'overload') OR contains(m, '503') THEN 'overloaded' ELSE 'other' END AS class FROM m""")
def failure_classes(spark, sf):
    m = F.element_at(F.array(*map(F.lit, FAILURES)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", P.failure_class(F.concat(m, F.lit("; "), "event_type")).alias("class"))


@query("SELECT 100 + row_number() OVER () AS vector_key FROM documents")
def assigned_keys(spark, sf):
    """The keys that rows get: every number after the last one given, each once."""
    return index.assign_keys(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 100).select(F.col("vector_key").cast("long").alias("vector_key"))


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), h AS (SELECT item_id, CAST('0x' || substr(md5(w), 2, 1) AS INT) AS d, count(*) AS n FROM w GROUP BY ALL)
SELECT item_id, CAST(d AS INT) AS dim, CAST(n AS DOUBLE) AS weight FROM h""")
def text_embeddings(spark, sf):
    e = embed.embed(table(spark, sf, "benchmark"), "item_id", "text", embed.hashing_embedder(16))
    return e.select("item_id", F.posexplode("embedding").alias("dim", "weight")).where("weight > 0")


# A call's arguments, by tool and by what is wrong with them, made from the rows of conversations.
TOOLS = ("read_lines", "read_excerpt", "search", "open")
SHAPES = {
    "read_lines": ['{"path": "T", "line_start": N, "line_count": 9}', '{"path": "T", "line_start": 0, "line_count": 9}', '{"path": "T", "line_start": 1, "line_count": 241}', '{"path": "T", "line_count": 1}', '{"path": " ", "line_start": 1, "line_count": 1}', '{"path": "T", "line_start": "1", "line_count": 1}'],
    "read_excerpt": ['{"path": "T", "chunk_index": N}', '{"path": "T", "chunk_index": -1}', '{"path": "T", "chunk_index": 1.5}', '{"chunk_index": 1}', '{"path": "T", "chunk_index": 0, "x": 1}', "[]"],
    "search": ['{"query": "T"}', '{"query": "T", "topK": N}', '{"query": "T", "minScore": 0.25}', '{"query": "T", "minScore": 2}', '{"query": "T", "topK": true}', '{"topK": 3}'],
    "open": ['{"target": "T"}', '{"target": 5}', "{}", '{"target": null}', "not json", '{"target": "T", "b": 1, "a": 2}'],
}
CASES = "CASE turn % 4 " + " ".join(f"WHEN {i} THEN CASE conv_id % 6 " + " ".join(f"WHEN {j} THEN '{x}'" for j, x in enumerate(SHAPES[t])) + " END" for i, t in enumerate(TOOLS)) + " END"


def _argument_sql(name: str, rule: dict, required: bool) -> str:
    """The rule of one argument, for the JSON value j."""
    at, has = f"'$.{name}'", f"json_exists(j, '$.{name}')"
    out = f" WHEN NOT {has} THEN '{name} is required'" if required else ""
    if rule["type"] == "string":
        return out + f" WHEN {has} AND (json_type(j, {at}) <> 'VARCHAR' OR trim(j->>{at}) = '') THEN '{name} must be a non-empty string'"
    kinds = "('UBIGINT', 'BIGINT')" if rule["type"] == "integer" else "('UBIGINT', 'BIGINT', 'DOUBLE')"
    out += f" WHEN {has} AND json_type(j, {at}) NOT IN {kinds} THEN '{name} must be {'an integer' if rule['type'] == 'integer' else 'a number'}' WHEN {has} AND TRY_CAST(j->>{at} AS DOUBLE) < {rule['minimum']} THEN '{name} must be at least {rule['minimum']}'"
    return out + (f" WHEN {has} AND TRY_CAST(j->>{at} AS DOUBLE) > {rule['maximum']} THEN '{name} must be at most {rule['maximum']}'" if "maximum" in rule else "")


def _schema_sql(tool: str) -> str:
    rules = tools.schema(tool)
    names = ", ".join(f"'{n}'" for n in rules["properties"])
    return f"CASE WHEN json_type(j) IS DISTINCT FROM 'OBJECT' THEN 'tool arguments must be a JSON object' WHEN len(list_filter(json_keys(j), lambda k: k NOT IN ({names}))) > 0 THEN 'unknown tool argument: ' || list_filter(json_keys(j), lambda k: k NOT IN ({names}))[1]" + "".join(_argument_sql(n, r, n in rules["required"]) for n, r in rules["properties"].items()) + " END"


@query(f"""WITH r AS (SELECT conv_id, turn, replace(replace({CASES}, 'T', 'file ' || conv_id), 'N', CAST(turn + conv_id AS VARCHAR)) AS raw FROM conversations), v AS (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM r)
SELECT conv_id, turn, CASE turn % 4 """ + " ".join(f"WHEN {i} THEN {_schema_sql(t)}" for i, t in enumerate(TOOLS)) + " END AS error FROM v")
def tool_calls(spark, sf):
    """Calls of four tools held against their schemas."""
    raw = F.replace(F.replace(F.expr(CASES), F.lit("T"), F.concat(F.lit("file "), F.col("conv_id").cast("string"))), F.lit("N"), (F.col("turn") + F.col("conv_id")).cast("string"))
    error = None
    for i, t in enumerate(TOOLS):
        error = (F if error is None else error).when(F.col("turn") % 4 == i, tools.call_error(t, F.col("raw")))
    return table(spark, sf, "conversations").withColumn("raw", raw).select("conv_id", "turn", error.alias("error"))

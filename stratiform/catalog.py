"""All queries of the engine and their SQL counterparts, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import predicates as P, text as T
from .operators import chunk, fuzzy, index, lexical, ranking, retrieve
from .operators import pages as pdf_pages
from .operators.vectors import VectorIndex
from .sources import shared
from .sources.tables import corpus, table
from .streaming import stateful, streams

QUERIES: dict = {}
ORACLES: dict = {}
PATH = "'/corpus/' || source || '/' || lang || '/doc-' || CAST(doc_id AS VARCHAR) || '.md'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# The query's words are frequent words of the corpus.
TERMS = ["the", "thing", "ereat"]
TOKENS = r"regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}\p{Co}\-_./#]+')"
BM25 = rf"""
WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
s AS (SELECT count(*) AS n_rows, avg(len(w)) AS a FROM t),
x AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t),
f AS (SELECT doc_id, l, term, count(*) * 1.5 AS tf FROM x WHERE term IN ('the', 'thing', 'ereat') GROUP BY ALL),
d AS (SELECT term, count(*) AS n FROM f GROUP BY term),
r AS (SELECT doc_id, -sum(greatest(ln((n_rows - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS rank FROM f JOIN d USING (term), s GROUP BY doc_id)
"""


def _postings(spark, folder: str) -> lexical.Postings:
    return lexical.Postings(spark, folder, "doc_id", {"text": 1.5})


def _index(spark, sf) -> lexical.Postings:
    """The stored postings of ``documents``, built when first asked for."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return _postings(spark, shared.built(d, "postings", lambda t, folder: _postings(spark, folder).change(added=t)))


@query(BM25 + "SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY round(rank, 6), doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).top([[t] for t in TERMS], 10).withColumn("rank", F.round("rank", 6))


@query(BM25 + "SELECT doc_id, round(rank, 6) AS rank FROM r")
def bm25_scan(spark, sf):
    """The same ranks of all rows in one pass over the texts, without an index."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return lexical.bm25(d, "doc_id", {"text": 1.5}, TERMS).select("doc_id", F.round("rank", 6).alias("rank"))


@query(rf"WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), x AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS n_rows, count(*) AS n_places, CAST(round(sum(1.5), 1) AS DOUBLE) AS tf FROM x GROUP BY term")
def postings(spark, sf):
    i = _index(spark, sf)
    p = i.read("postings", i.state()["segments"]).select("term", "n", F.expr("aggregate(places, 0L, (n, p) -> n + size(p))").alias("p"), F.expr("aggregate(tf, 0D, (n, x) -> n + x)").alias("tf"))
    return p.groupBy("term").agg(F.sum("n").alias("n_rows"), F.sum("p").alias("n_places"), F.round(F.sum("tf"), 1).alias("tf"))


KNN = "SELECT a.vec_id AS query, b.vec_id, 1 - list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"


@query(f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS ({KNN}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS INT) AS rank FROM d) SELECT query, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10")
def knn_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieve.knn(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).withColumn("distance", F.round("distance", 6))


@query(f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 7 <> 3), d AS ({KNN}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS INT) AS rank FROM d) SELECT query, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10")
def indexed_knn(spark, sf):
    """The same search in a stored index from which every seventh row has been deleted and to which a part was added later."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    stored = lambda folder: VectorIndex(spark, folder, "vec_id", "embedding")

    def build(t, folder):
        i = stored(folder)
        i.change(added=t.where("vec_id % 3 <> 1"))
        i.change(added=t.where("vec_id % 3 = 1"), removed=t.where("vec_id % 7 = 3 and vec_id % 3 <> 1"))
        i.change(removed=t.where("vec_id % 7 = 3"))

    i = stored(shared.built(e, "vector-index", build))
    return i.search(e.where("vec_id % 50 = 0 and vec_id % 7 <> 3"), 10).withColumn("distance", F.round("distance", 6))


@query("SELECT count(*) AS n, bit_xor(vec_id) AS key_xor, CAST(CAST(sum(vec_id) AS HUGEINT) % 18446744073709551616 AS VARCHAR) AS key_sum FROM embeddings")
def vector_digest(spark, sf):
    return index.set_digest(table(spark, sf, "embeddings"), "vec_id")


@query("SELECT doc_id, lower(text) AS low, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 240 THEN left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 240) || '...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS snip, CASE WHEN strlen(trim(text)) > 240 THEN left(trim(text), 240) || '...' ELSE trim(text) END AS preview, trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), chr(10))) AS tidy FROM documents".replace("\\\\", "\\"))
def text_basics(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.lower(t).alias("low"), T.collapse(t).alias("flat"), T.snippet(t).alias("snip"), T.body_preview(t).alias("preview"), T.trim_lines(t).alias("tidy"))


@query(r"SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), lambda p: CASE WHEN left(p, 1) = 'ß' THEN 'SS' ELSE upper(left(p, 1)) END || lower(substr(p, 2))), '') AS title FROM benchmark")
def title_case(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.title_case(F.col("text")).alias("title"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS snake FROM part")
def snake_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.snake_case(F.col("p_name")).alias("snake"))


@query("SELECT doc_id, array_to_string(list_sort(string_split(text, chr(10))), chr(10)) AS sorted, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_lines FROM documents".replace("\\\\", "\\"))
def line_tools(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.sort_lines(t).alias("sorted"), T.word_count(t).alias("n_words"), T.full_lines(t).alias("n_lines"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), f AS (SELECT doc_id, line, min(i) AS i FROM l GROUP BY ALL) SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS lines FROM f GROUP BY doc_id")
def unique_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.unique_lines(F.col("text")).alias("lines"))


@query(r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, length(regexp_replace(text, '\s', '', 'g')) AS v FROM documents)
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR (len(ls) > 0 AND len(list_filter(ls, lambda x: NOT starts_with(x, '#'))) = 0 AND v <= 24) OR (len(ls) >= 2 AND len(list_filter(ls, lambda x: NOT (strlen(x) >= 24 AND regexp_full_match(x, '[A-Za-z0-9+/=]+')))) = 0) AS low FROM l""")
def low_information(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.low_information(F.col("text")).alias("low"))


@query(r"SELECT item_id, len(regexp_extract_all(text, '[A-Za-z]')) >= 2 OR len(list_filter(regexp_extract_all(text, '\p{L}'), lambda x: strlen(x) > 1)) >= 1 AS ready, len(regexp_extract_all(text, '[0-9]')) >= 2 OR len(regexp_extract_all(text, '[A-Za-z]')) >= 2 AS kill, starts_with(text, '/') OR starts_with(text, 'http') OR contains(text, '{') AS action FROM benchmark")
def query_readiness(spark, sf):
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", P.file_ready(t).alias("ready"), P.kill_ready(t).alias("kill"), P.action_intent(t).alias("action"))


SCRIPT_SQL = ", ".join(f"len(regexp_extract_all(t, '[{v}]')) AS {k}" for k, v in P.SCRIPTS.items())
MUCH = {k: f"({k} >= 6 AND {k} * 100 >= total * 12)" for k in (*P.SCRIPTS, "other")}


@query(rf"""WITH d AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN text || repeat(chr(8203), length(text) // 8 + 1) WHEN 1 THEN text || repeat('漢бα', length(text) // 4 + 6) WHEN 2 THEN text || repeat('漢', length(text) // 2) WHEN 3 THEN text || chr(1) WHEN 4 THEN text || repeat('漢क', length(text) // 3 + 6) WHEN 5 THEN left(text, 20) || chr(65532) ELSE left(text, 22) END AS t FROM documents),
n AS (SELECT doc_id, {SCRIPT_SQL}, len(regexp_extract_all(regexp_replace(t, '[{"".join(P.SCRIPTS.values())}]', '', 'g'), '[\p{{L}}\p{{Nl}}]')) AS other, length(regexp_replace(t, '\s', '', 'g')) AS visible, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]')) AS word,
  len(regexp_extract_all(t, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{FFF0}}-\x{{FFFF}}\x{{E000}}-\x{{F8FF}}\x{{0001}}-\x{{0008}}\x{{000E}}-\x{{001F}}\x{{007F}}-\x{{009F}}]')) AS odd FROM d),
s AS (SELECT *, {" + ".join((*P.SCRIPTS, "other"))} AS total FROM n)
SELECT doc_id, cjk, other, CASE WHEN visible < 24 THEN word >= 1 AND odd = 0 ELSE word * 100 >= visible * 45 AND odd * 100 <= visible * 10 AND NOT ({MUCH["cjk"]} AND ({MUCH["other"]} OR {" + ".join(f"CAST({MUCH[k]} AS INT)" for k in ("cyrillic", "arabic", "hebrew", "greek"))} >= 2)) END AS readable FROM s""")
def page_readability(spark, sf):
    """Documents with invisible characters, scripts that decoding faults mix, a control character, or few characters."""
    t, m = F.col("text"), F.col("doc_id") % 7
    times = lambda s, n: F.concat(t, F.expr(f"repeat('{s}', cast({n} as int))"))
    own = F.when(m == 0, times("\u200b", "length(text) div 8 + 1")).when(m == 1, times("漢бα", "length(text) div 4 + 6")).when(m == 2, times("漢", "length(text) div 2")).when(m == 3, F.concat(t, F.lit("\x01"))).when(m == 4, times("漢क", "length(text) div 3 + 6")).when(m == 5, F.concat(F.substring(t, 1, 20), F.lit("\ufffc"))).otherwise(F.substring(t, 1, 22))
    d = table(spark, sf, "documents").select("doc_id", own.alias("t"))
    n = P.script_counts(F.col("t"))
    return d.select("doc_id", n["cjk"].cast("long").alias("cjk"), n["other"].cast("long").alias("other"), P.readable(F.col("t")).alias("readable"))


@query(f"SELECT {PATH} AS absolute_path, 'markdown' AS kind, strlen(text) <= 20971520 AS fits, starts_with(source, 'src1') AND length(source) <= 5 AS skipped, regexp_matches({PATH}, '^/corpus/[^/]*/en(/|$)') AS english FROM documents")
def classify_files(spark, sf):
    p = F.col("absolute_path")
    return corpus(spark, sf).select(p, P.kind(p).alias("kind"), P.within_limit(p, F.col("size_bytes")).alias("fits"), P.ignored(p, ["/corpus/src1/**", "/corpus/src1?/**"]).alias("skipped"), P.under(p, F.concat(F.lit("/corpus/"), "source", F.lit("/en"))).alias("english"))


@query(f"SELECT {PATH} AS absolute_path, 'doc-' || doc_id || '.md' AS name, '/corpus/' || source || '/' || lang AS parent, '~' || substr({PATH}, 8) AS shown FROM documents")
def path_parts(spark, sf):
    p = F.col("absolute_path")
    return corpus(spark, sf).select(p, T.file_name(p).alias("name"), T.parent(p).alias("parent"), T.display_path(p, "/corpus").alias("shown"))


STORED = f"s AS (SELECT {PATH} AS absolute_path, CASE WHEN doc_id % 5 = 1 THEN 0 ELSE doc_id * 1000 END AS m, CASE WHEN doc_id % 7 = 2 THEN 'old' ELSE md5(text) END AS h FROM documents WHERE doc_id % 3 <> 0)"


def _stored(spark, sf):
    c = corpus(spark, sf).where("doc_id % 3 <> 0")
    return c.select("absolute_path", "size_bytes", F.when(F.col("doc_id") % 5 == 1, 0).otherwise(F.col("modified_at_ms")).alias("modified_at_ms"), F.when(F.col("doc_id") % 7 == 2, "old").otherwise(F.col("content_md5")).alias("content_md5"), F.lit("v1").alias("fingerprint"), F.lit(3).alias("chunk_count"))


@query(f"WITH {STORED}, c AS (SELECT {PATH} AS absolute_path, text, lang, doc_id * 1000 AS m, md5(text) AS h FROM documents WHERE doc_id % 11 <> 4) SELECT coalesce(c.absolute_path, s.absolute_path) AS absolute_path, CASE WHEN c.absolute_path IS NULL THEN 'delete' WHEN lang = 'es' THEN CASE WHEN s.absolute_path IS NOT NULL THEN 'delete' ELSE 'skip' END WHEN c.m = s.m THEN 'unchanged' WHEN c.h = s.h THEN 'refresh' ELSE 'reindex' END AS plan FROM c FULL JOIN s ON c.absolute_path = s.absolute_path")
def change_detection(spark, sf):
    now = corpus(spark, sf).where("doc_id % 11 <> 4").withColumns({"fingerprint": F.lit("v1"), "eligible": F.col("lang") != "es", "has_text": F.trim("text") != ""})
    return index.change_plan(now, _stored(spark, sf), "absolute_path")


@query(f"""WITH {STORED}, c AS (SELECT doc_id, {PATH} AS absolute_path, lang, doc_id * 1000 AS m, md5(text) AS h FROM documents),
j AS (SELECT c.*, s.absolute_path IS NOT NULL AS known, c.m = s.m AS fast, c.h = s.h AS alike, doc_id % 13 = 5 AS moved, doc_id % 17 = 3 AS waits FROM c LEFT JOIN s ON c.absolute_path = s.absolute_path),
p AS (SELECT *, CASE WHEN lang = 'es' THEN CASE WHEN known THEN 'delete' ELSE 'skip' END WHEN fast THEN 'unchanged' WHEN alike THEN 'refresh' ELSE 'reindex' END AS plan FROM j)
SELECT absolute_path, plan, plan = 'refresh' OR (plan = 'unchanged' AND (moved OR waits)) AS refresh_record, plan IN ('unchanged', 'refresh') AND waits AS clear_pending, plan IN ('unchanged', 'refresh') AND moved AS refresh_projection FROM p""")
def change_steps(spark, sf):
    """The ladder with files that moved to another root and files of which a version waits."""
    now = corpus(spark, sf).withColumns({"fingerprint": F.lit("v1"), "eligible": F.col("lang") != "es", "has_text": F.lit(True), "source_root": F.lit("/corpus"), "relative_path": F.concat("lang", F.lit("/"), "doc_id")})
    old = now.select("absolute_path", F.when(F.col("doc_id") % 13 == 5, "/elsewhere").otherwise("/corpus").alias("source_root"), "relative_path", (F.col("doc_id") % 17 == 3).alias("pending"))
    return index.change_steps(now, _stored(spark, sf).join(old, "absolute_path"), "absolute_path")


@query(f"SELECT {PATH} AS absolute_path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0")
def stale_paths(spark, sf):
    return index.stale(_stored(spark, sf), corpus(spark, sf).where("doc_id % 4 <> 0"), "absolute_path").select("absolute_path")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return index.upsert(o, o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("WITH k AS (SELECT md5(text) AS fp, min(doc_id) AS source_doc FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, source_doc FROM documents LEFT JOIN k ON md5(text) = fp")
def vector_reuse(spark, sf):
    c = corpus(spark, sf).withColumn("fp", F.col("content_md5"))
    cache = c.where("doc_id % 2 = 0").groupBy("fp").agg(F.min("doc_id").alias("source_doc"))
    return index.reuse(c, cache, ["fp"], "source_doc").select("doc_id", "source_doc")


@query("WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS o, count(*) OVER () - 1 AS l FROM embeddings) SELECT vec_id, CAST(o AS BIGINT) AS \"offset\" FROM r WHERE o IN (0, l // 3, l * 2 // 3, l)")
def probe_keys(spark, sf):
    return index.probes(table(spark, sf, "embeddings").select("vec_id"), "vec_id")


@query("SELECT count(*) AS scanned, count_if(quality = 1) AS indexed, count_if(quality = 0) AS skipped, CASE WHEN count_if(quality = 1) = 0 THEN 'none' WHEN count_if(quality = 1) = count(*) THEN 'all' ELSE 'partial' END AS coverage FROM labels")
def scan_rollup(spark, sf):
    n = F.count_if(F.col("quality") == 1)
    return table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("scanned"), n.alias("indexed"), F.count_if(F.col("quality") == 0).alias("skipped"), F.when(n == 0, "none").when(n == F.count(F.lit(1)), "all").otherwise("partial").alias("coverage"))


# One search: its raw text, the informative part, the lexical sub-queries (phrases, all or any, weight) and, as no embedder
# is public here, stored vectors in place of the semantic sub-queries' (vec_id, weight).
RAW, FOCUS, REQUIRED, HITS = "where is the thing ereat", "thing ereat", ["thing", "ereat"], 8
LEXICAL = [([["thing", "ereat"]], False, 0.25), ([["thing"], ["ereat"]], True, 0.15), ([["thing"], ["ereat"]], False, 0.0)]
SEMANTIC = [(0, 0.0), (50, 0.12)]
HYBRID = rf"""
WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
s AS (SELECT count(*) AS n_rows, avg(len(w)) AS a FROM t),
p AS (SELECT doc_id, len(w) AS l, 'thing' AS ph, len(list_filter(w, lambda x: x = 'thing')) * 1.5 AS tf FROM t
  UNION ALL SELECT doc_id, len(w), 'ereat', len(list_filter(w, lambda x: x = 'ereat')) * 1.5 FROM t
  UNION ALL SELECT doc_id, len(w), 'both', len(list_filter(w, lambda x, i: x = 'thing' AND w[i + 1] = 'ereat')) * 1.5 FROM t),
f AS (SELECT * FROM p WHERE tf > 0),
d AS (SELECT ph, count(*) AS n FROM f GROUP BY ph),
g AS (SELECT doc_id, ph, greatest(ln((n_rows - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a)) AS g FROM f JOIN d USING (ph), s),
sub AS (SELECT doc_id, sum(g) AS g, 0.25 AS weight FROM g WHERE ph = 'both' GROUP BY doc_id
  UNION ALL SELECT doc_id, sum(g), 0.15 FROM g WHERE ph <> 'both' GROUP BY doc_id HAVING count(*) = 2
  UNION ALL SELECT doc_id, sum(g), 0.0 FROM g WHERE ph <> 'both' GROUP BY doc_id),
cut AS (SELECT doc_id, g / (1 + g) + weight AS s FROM sub QUALIFY row_number() OVER (PARTITION BY weight ORDER BY g DESC, doc_id) <= 21),
lex AS (SELECT doc_id, CAST(max(s) AS DOUBLE) AS s FROM cut GROUP BY doc_id),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), kd AS ({KNN.replace('a.vec_id % 50 = 0', 'a.vec_id IN (0, 50)')}),
near AS (SELECT vec_id AS doc_id, distance AS d, CASE WHEN query = 50 THEN 0.12 ELSE 0 END AS w FROM kd QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 32),
vec AS (SELECT doc_id, min(d) AS d, max(1 / (1 + greatest(d, 0))) AS s, max(w) AS w FROM near GROUP BY doc_id),
m AS (SELECT coalesce(lex.doc_id, vec.doc_id) AS doc_id, CASE WHEN lex.doc_id IS NULL THEN vec.s WHEN vec.doc_id IS NULL THEN lex.s ELSE least(1, greatest(vec.s, lex.s) + 0.15 * least(vec.s, lex.s)) END AS score,
  coalesce(vec.d, greatest(least(1 - lex.s, 1), 0)) AS distance, CAST(greatest(coalesce(vec.w, 0), CASE WHEN lex.s IS NULL THEN 0 ELSE least(lex.s, 0.2) END) AS DOUBLE) AS boost, vec.doc_id IS NOT NULL AS has_vector FROM lex FULL JOIN vec ON lex.doc_id = vec.doc_id)"""


def _hybrid(spark, sf):
    e, total = table(spark, sf, "embeddings"), retrieve.candidate_limit(HITS)
    weight = F.when(F.col("query") == SEMANTIC[1][0], SEMANTIC[1][1]).otherwise(SEMANTIC[0][1])
    near = retrieve.knn(e, e.where(F.col("vec_id").isin([v for v, _ in SEMANTIC])), "vec_id", "embedding", retrieve.limit_of_each(total, len(SEMANTIC)))
    near = near.select(F.col("vec_id").alias("doc_id"), retrieve.distance_score(F.col("distance")).alias("score"), "distance", weight.alias("boost"))
    index, share = _index(spark, sf), retrieve.limit_of_each(total, len(LEXICAL))
    hits = [index.top(phrases, share, every).select("doc_id", (retrieve.rank_score(F.col("rank")) + w).alias("score")) for phrases, every, w in LEXICAL]
    words = retrieve.best_of(hits, "doc_id").select("doc_id", "score", retrieve.pseudo_distance(F.col("score")).alias("distance"), F.least("score", F.lit(0.2)).alias("boost"))
    return retrieve.merge(near, words, "doc_id")


@query("SELECT p_partkey, CAST(greatest(8 * least(greatest(p_size - 10, 1), 20), 24) AS INT) AS candidates, CAST(greatest(greatest(8 * least(greatest(p_size - 10, 1), 20), 24) // 3, 12) AS INT) AS each FROM part")
def candidate_limits(spark, sf):
    """Limits of searches whose number of hits is a part's size, less ten."""
    return table(spark, sf, "part").select("p_partkey", retrieve.limits(F.col("p_size") - 10, 3).alias("x")).select("p_partkey", "x.*")


@query(HYBRID + " SELECT doc_id, round(score, 6) AS score, round(distance, 6) AS distance, round(boost, 6) AS boost, has_vector FROM m")
def hybrid_merge(spark, sf):
    return _hybrid(spark, sf).select("doc_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"), F.round("boost", 6).alias("boost"), "has_vector")


RERANK = HYBRID + rf""", h AS (SELECT m.*, text, lower({PATH}) AS p, lower(trim(string_split(text, chr(10))[1])) AS hd, lower(lang) AS an, lower({PATH} || ' ' || trim(string_split(text, chr(10))[1]) || ' ' || text) AS hay FROM m JOIN documents USING (doc_id)),
c AS (SELECT *, CAST(contains(hay, 'thing') AS INT) + CAST(contains(hay, 'ereat') AS INT) AS matched, matched / 2 AS cov, contains(hay, 'thing ereat') AS exact,
  CAST(contains(p, 'thing') AS INT) + CAST(contains(p, 'ereat') AS INT) AS mp, CAST(contains(hd, 'thing') AS INT) + CAST(contains(hd, 'ereat') AS INT) AS mh, CAST(contains(an, 'thing') AS INT) + CAST(contains(an, 'ereat') AS INT) AS ma FROM h),
k AS (SELECT *, mp + mh + ma > 0 AS anchored, score + 0.45 * (CASE WHEN exact THEN 1.0 ELSE 0.0 END + CASE WHEN contains(hay, 'where is the thing ereat') THEN 0.3 ELSE 0.0 END + 1.2 * cov)
  + 0.2 * (CASE WHEN contains(p, 'thing ereat') THEN 0.8 ELSE 0.0 END + CASE WHEN contains(hd, 'thing ereat') THEN 0.6 ELSE 0.0 END + CASE WHEN contains(an, 'thing ereat') THEN 0.3 ELSE 0.0 END + 0.35 * mp / 2 + 0.25 * mh / 2 + 0.1 * ma / 2)
  + 0.25 * boost + 0.15 * cov AS combined FROM c)"""


def _ranked(spark, sf):
    """Documents stand for chunks: the first line is their heading, the language their anchor label."""
    d = corpus(spark, sf).select("doc_id", "absolute_path", "text", "source", "lang")
    heading = F.array(F.trim(F.get(F.split("text", "\n"), 0)))
    return retrieve.rerank(_hybrid(spark, sf).join(d, "doc_id"), F.col("text"), F.col("absolute_path"), heading, F.col("lang"), RAW, FOCUS, REQUIRED)


@query(RERANK + " SELECT doc_id, round(cov, 6) AS coverage, matched, exact, anchored, round(combined, 6) AS combined FROM k")
def rerank_hits(spark, sf):
    return _ranked(spark, sf).select("doc_id", F.round("coverage", 6).alias("coverage"), "matched", "exact", "anchored", F.round("combined", 6).alias("combined"))


@query(RERANK + r""", o AS (SELECT k.*, source, row_number() OVER (ORDER BY combined DESC, distance, doc_id) AS r FROM k JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
b AS (SELECT score AS bs, combined AS bc, cov AS bv, matched AS bm, has_vector AS bh, distance AS bd FROM o WHERE r = 1),
j AS (SELECT o.*, b.*, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, length(regexp_replace(text, '\s', '', 'g')) AS vis FROM o, b),
n AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR (len(ls) > 0 AND len(list_filter(ls, lambda x: NOT starts_with(x, '#'))) = 0 AND vis <= 24) OR (len(ls) >= 2 AND len(list_filter(ls, lambda x: NOT (strlen(x) >= 24 AND regexp_full_match(x, '[A-Za-z0-9+/=]+')))) = 0) AS low FROM j),
y AS (SELECT * FROM n WHERE score >= greatest(0.35, CASE WHEN bs >= 0.8 THEN 0.6 WHEN bs >= 0.65 THEN 0.5 WHEN bs >= 0.5 THEN 0.4 ELSE 0.3 END) AND combined >= 0.7 * bc
  AND (NOT (bv >= 0.8 AND bm >= 2 AND bh) OR NOT has_vector OR distance <= bd + 0.12) AND NOT low
  AND (exact OR cov >= CASE WHEN bv >= 0.8 THEN 0.75 WHEN bv >= 0.6 THEN 0.5 ELSE 0 END)
  AND (NOT (bv >= 0.6 AND bm >= 2) OR exact OR anchored OR matched >= 1) AND (NOT (bv >= 0.8 AND bm >= 2) OR anchored OR matched >= 2)),
pp AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r) AS round, min(r) OVER (PARTITION BY source) AS f FROM y),
z AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY round, f) AS INT) AS place FROM pp WHERE round <= 2) SELECT * FROM z WHERE place <= 8""")
def prune_diversify(spark, sf):
    return retrieve.prune(_ranked(spark, sf), "doc_id", "source", 0.35, HITS).select("doc_id", "place")


def fuzzy_sql(text: str, pattern: str) -> str:
    """The subsequence score of ``ranking.fuzzy`` for a lower-case pattern; null without a match."""
    step = f"""list_reduce(list_prepend({{'c': '', 's': 0, 'l': -2, 'a': 0}}, list_transform(string_split('{pattern}', ''), lambda x: {{'c': x, 's': 0, 'l': 0, 'a': 0}})), lambda acc, x:
  list_transform([instr(substr(lower({text}), acc.a + 1), x.c)], lambda k: list_transform([acc.a + CAST(k AS INT) - 1], lambda i: CASE WHEN acc.a < 0 OR k = 0 THEN {{'c': '', 's': 0, 'l': 0, 'a': -1}} ELSE
    {{'c': '', 's': acc.s + 16 + CASE WHEN i = acc.l + 1 THEN 12 ELSE -least(3, i - acc.a) END + CASE WHEN i = 0 OR NOT regexp_matches(substr({text}, i, 1), '[\\p{{L}}\\p{{N}}]') OR (regexp_matches(substr({text}, i + 1, 1), '\\p{{Lu}}') AND regexp_matches(substr({text}, i, 1), '\\p{{Ll}}')) THEN 8 ELSE 0 END + CASE WHEN i = 0 THEN 4 ELSE 0 END, 'l': i, 'a': i + 1}} END)[1])[1])"""
    return f"list_transform([{step}], lambda r: CASE WHEN r.a >= 0 THEN r.s END)[1]"


# A small action catalog for matching.
ACTIONS = [("Translate Text", ["/translate", "/tr"], ["language", "translate"], 40), ("Pretty JSON", ["/json"], ["format", "json"], 35), ("Kill Process", ["/kill"], ["process", "stop"], 30), ("Upper Case", ["/upper"], ["case", "text"], 20), ("Open Target", ["/open"], ["url", "path"], 25)]
ASKED = ["case", "/json {}", "tr", "process", "zzz", "http://x", "", "/tr", "a {", "language translate"]
TYPED = "CASE WHEN turn % 3 < 2 THEN [" + ", ".join(f"'{x}'" for x in ASKED) + "][CAST((conv_id + turn) % 10 AS INT) + 1] ELSE lower(left(text, 2)) END"


@query(f"""WITH a(title, aliases, keywords, priority) AS (VALUES {", ".join(f"('{t}', {al}, {k}, {p})" for t, al, k, p in ACTIONS)}), q AS (SELECT DISTINCT conv_id, turn, trim({TYPED}) AS q FROM conversations), w AS (SELECT *, CASE WHEN starts_with(q, '/') THEN string_split(q, ' ')[1] ELSE q END AS w FROM q),
s AS (SELECT conv_id, turn, q, title, priority, CASE WHEN starts_with(lower(title), w) THEN 90 WHEN contains(lower(title), w) THEN 55 ELSE 0 END + CASE WHEN contains(array_to_string(aliases, ' '), w) THEN 36 ELSE 0 END + CASE WHEN contains(array_to_string(keywords, ' '), w) THEN 28 ELSE 0 END
  + CASE WHEN starts_with(w, '/') AND list_contains(aliases, w) THEN 42 ELSE 0 END + CASE WHEN title = 'Open Target' AND starts_with(q, 'http') THEN 60 ELSE 0 END + CASE WHEN title = 'Pretty JSON' AND contains(q, '{{') THEN 44 ELSE 0 END AS h FROM w, a),
g AS (SELECT conv_id, turn, q, title, CASE WHEN q = '' THEN priority WHEN h > 0 THEN priority + h + CASE WHEN contains(q, ' ') THEN 10 ELSE 0 END END AS g FROM s)
SELECT conv_id, turn, q, title, CAST(g AS INT) AS score, CAST(row_number() OVER (PARTITION BY conv_id, turn, q ORDER BY g DESC, title) AS INT) AS place FROM g WHERE g IS NOT NULL""")
def action_match(spark, sf):
    """Actions for what the turns of conversations type, ranked for each; the catalog of actions is small and fixed."""
    a = spark.createDataFrame(ACTIONS, "title string, aliases array<string>, keywords array<string>, priority int")
    q, t = F.col("q"), F.col("title")
    typed = F.when(F.col("turn") % 3 < 2, F.get(F.array(*map(F.lit, ASKED)), ((F.col("conv_id") + F.col("turn")) % 10).cast("int"))).otherwise(F.lower(F.substring("text", 1, 2)))
    asked = table(spark, sf, "conversations").select("conv_id", "turn", F.trim(typed).alias("q")).distinct()
    score = ranking.action_score(q, t, F.col("aliases"), F.col("keywords"), F.col("priority"), t == "Open Target", (t == "Pretty JSON") & F.contains(q, F.lit("{")), F.contains(q, F.lit(" ")))
    s = asked.join(F.broadcast(a), F.lit(True)).withColumn("score", score)
    w = Window.partitionBy("conv_id", "turn", "q").orderBy(F.desc("score"), "title")
    return s.where("score is not null").select("conv_id", "turn", "q", "title", F.col("score").cast("int").alias("score"), F.row_number().over(w).alias("place"))


WANTED = ["customer#0000000", "12", "9", "bldg", "cr9"]


@query("WITH q(q) AS (VALUES " + ", ".join(f"('{x}')" for x in WANTED) + "), c AS (SELECT q, c_custkey, c_name, unnest([{'v': c_name, 'b': 180}, {'v': c_mktsegment, 'b': 160}, {'v': 'run' || c_custkey, 'b': 120}]) AS n FROM q, customer), "
       "f AS (SELECT q, c_custkey, c_name, n.b AS b, lower(n.v) AS v, CASE q " + " ".join(f"WHEN '{x}' THEN {fuzzy_sql('n.v', x)}" for x in WANTED) + " END AS f FROM c), "
       """m AS (SELECT q, c_custkey, c_name, max(CASE WHEN v = q THEN b + 260 WHEN starts_with(v, q) THEN b + 180 WHEN contains(v, q) THEN b + 110 ELSE b + f END) AS best FROM f GROUP BY q, c_custkey, c_name),
s AS (SELECT q, c_custkey, c_name, CASE WHEN starts_with(CAST(c_custkey AS VARCHAR), q) THEN 420 - length(CAST(c_custkey AS VARCHAR)) ELSE best END AS score FROM m)
SELECT q, c_custkey, CAST(score AS INT) AS score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, c_name, c_custkey) <= 20""")
def process_rank(spark, sf):
    q = spark.createDataFrame([(x,) for x in WANTED], "q string")
    c = table(spark, sf, "customer").join(F.broadcast(q), F.lit(True))
    s = c.withColumn("score", ranking.process_score(F.col("q"), F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit("run"), F.col("c_custkey").cast("string"))))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "c_name", "c_custkey")
    return s.where("score is not null").withColumn("r", F.row_number().over(w)).where("r <= 20").select("q", "c_custkey", F.col("score").cast("int").alias("score"))


APP_PATH = "CASE p_size % 4 WHEN 0 THEN '/System/Applications/' WHEN 1 THEN '/Applications/' WHEN 2 THEN '/Users/x/Applications/' ELSE '/opt/' END || p_brand"


@query(f"""WITH a AS (SELECT p_partkey, lower(p_name) AS n, {APP_PATH} AS path, {fuzzy_sql('lower(p_name)', 'ri')} AS f1, {fuzzy_sql('lower(p_type)', 'ri')} AS f2, CASE p_size % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS pr FROM part)
SELECT p_partkey, CAST(greatest(f1, f2 + 80) + CASE WHEN starts_with(n, 'ri') THEN 220 WHEN contains(n, 'ri') THEN 140 ELSE 0 END + CASE WHEN contains(lower(path), 'ri') THEN 36 ELSE 0 END + 12 * pr AS INT) AS score FROM a WHERE f1 IS NOT NULL OR f2 IS NOT NULL ORDER BY score DESC, pr DESC, length(path), path, p_partkey LIMIT 20""")
def app_rank(spark, sf):
    m = F.col("p_size") % 4
    path = F.concat(F.when(m == 0, "/System/Applications/").when(m == 1, "/Applications/").when(m == 2, "/Users/x/Applications/").otherwise("/opt/"), "p_brand")
    a = table(spark, sf, "part").withColumn("path", path)
    s = ranking.app_score(F.lit("ri"), F.col("p_name"), F.array("p_type"), F.col("path"), ranking.directory_priority(F.col("path")))
    return a.withColumn("score", s).where("score is not null").orderBy(F.desc("score"), F.desc(ranking.directory_priority(F.col("path"))), F.length("path"), "path", "p_partkey").limit(20).select("p_partkey", F.col("score").cast("int").alias("score"))


@query(f"SELECT p_partkey, p_name, CAST({fuzzy_sql('p_name', 'rdg')} AS INT) AS score FROM part WHERE {fuzzy_sql('p_name', 'rdg')} IS NOT NULL ORDER BY score DESC, p_name, p_partkey LIMIT 20")
def fuzzy_files(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    signed = spark.read.parquet(shared.built(rows, "part-signatures", lambda t, folder: fuzzy.signed(t, ["p_name"]).write.parquet(f"{folder}/rows")) + "/rows")
    return fuzzy.top(signed, "rdg", [("p_name", 0)], ["p_name", "p_partkey"]).select("p_partkey", "p_name", "score")


@query(f"WITH f AS (SELECT {PATH} AS path, 'doc-' || doc_id || '.md' AS name FROM documents) SELECT path, CAST(greatest({fuzzy_sql('path', 'od7')}, {fuzzy_sql('name', 'od7')} + 100) AS INT) AS score FROM f WHERE {fuzzy_sql('path', 'od7')} IS NOT NULL ORDER BY score DESC, path LIMIT 20")
def file_rank(spark, sf):
    files = lambda t: t.select(F.col("absolute_path").alias("path"), T.file_name(F.col("absolute_path")).alias("name"))
    signed = spark.read.parquet(shared.built(corpus(spark, sf), "file-signatures", lambda t, folder: fuzzy.signed(files(t), ["path", "name"]).write.parquet(f"{folder}/rows")) + "/rows")
    return fuzzy.top(signed, "od7", [("path", 0), ("name", 100)], ["path"]).select("path", "score")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY user_id, s""")
def session_debounce(spark, sf):
    return streams.debounce(table(spark, sf, "events"), "user_id", "ts", "1 hour")


# Events of a watched folder, some of folders themselves.
@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'access' WHEN 'click' THEN 'create' WHEN 'error' THEN 'other' WHEN 'signup' THEN 'rename' ELSE 'remove' END AS kind, user_id % 3 <> 0 AS there, event_id % 7 = 0 AS folder, event_id % 11 AS odd FROM events),
k AS (SELECT event_id, CASE odd WHEN 0 THEN 'metadata' WHEN 1 THEN NULL WHEN 2 THEN 'modify' ELSE kind END AS kind, there, folder FROM e)
SELECT event_id, CASE WHEN kind IN ('access', 'metadata') THEN 'ignore' WHEN kind IS NULL OR NOT there THEN 'rescan' WHEN folder THEN CASE kind WHEN 'rename' THEN 'rescan' WHEN 'create' THEN 'walk' ELSE 'ignore' END WHEN kind = 'remove' THEN 'delete' ELSE 'path' END AS plan FROM k""")
def event_filter(spark, sf):
    kinds = F.create_map(*[F.lit(x) for p in (("view", "access"), ("click", "create"), ("error", "other"), ("signup", "rename"), ("purchase", "remove")) for x in p])
    odd = F.col("event_id") % 11
    kind = F.when(odd == 0, "metadata").when(odd == 1, None).when(odd == 2, "modify").otherwise(kinds[F.col("event_type")])
    paths = F.when(F.col("user_id") % 3 != 0, F.array(F.lit("/corpus/a.md"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select("event_id", P.event_plan(kind, paths, F.col("event_id") % 7 == 0).alias("plan"))


@query("SELECT user_id, arg_max(event_id, {'t': ts, 'a': -event_id}) AS event_id, arg_max(event_type, {'t': ts, 'a': -event_id}) AS event_type FROM events GROUP BY user_id")
def lww_snapshot(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return streams.last_writer(e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT user_id, 'e' || (event_id % 9) AS entry, max(ts) AS seen, max(CASE WHEN event_type = 'purchase' THEN ts END) AS pinned_at FROM events GROUP BY 1, 2)
SELECT user_id, entry, pinned_at IS NOT NULL AS pinned, CAST(row_number() OVER (PARTITION BY user_id, pinned_at IS NOT NULL ORDER BY coalesce(pinned_at, seen) DESC, seen DESC, entry) AS INT) AS place FROM e QUALIFY place <= CASE WHEN pinned_at IS NOT NULL THEN 5 ELSE 3 END""")
def clipboard_snapshot(spark, sf):
    e = table(spark, sf, "events").withColumn("entry_text", F.concat(F.lit("e"), (F.col("event_id") % 9).cast("string")))
    return streams.clipboard(e, "user_id", "entry_text", "ts", F.when(F.col("event_type") == "purchase", F.col("ts")), keep=3).select("user_id", "entry", "pinned", "place")


@query("SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS INT) AS place FROM events GROUP BY 1, 2 QUALIFY place <= 3")
def recent_roots(spark, sf):
    return streams.recent(table(spark, sf, "events"), "user_id", "event_type", "ts", 3).select("user_id", "event_type", "place")


@query("""WITH t AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS n FROM conversations WHERE text <> ''), b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM t)
SELECT conv_id, CAST(block AS INT) AS block, role, string_agg(text, chr(10) ORDER BY turn, text) AS content FROM b GROUP BY ALL""")
def transcript_fold(spark, sf):
    return stateful.transcript_blocks(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


@query("SELECT event_id, user_id FROM (SELECT *, CAST(value AS BIGINT) % 4 AS g, max(CAST(value AS BIGINT) % 4) OVER (PARTITION BY user_id) AS m FROM (SELECT event_id, user_id, floor(value) AS value FROM events)) WHERE g = m")
def generation_guard(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.floor("value").cast("long") % 4).alias("g"))
    return streams.newest_generation(e, "user_id", "g").select("event_id", "user_id")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents) SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(length(line) AS INT) AS n_chars, trim(line) <> '' AND coalesce(lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY line_no), '') = '' AS paragraph_start FROM l")
def line_layout(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    x = F.transform("ls", lambda s, i: F.struct(i.alias("line_no"), F.length(s).alias("n_chars"), ((F.trim(s) != "") & F.when(i == 0, True).otherwise(F.trim(F.get("ls", i - 1)) == "")).alias("paragraph_start")))
    return lines.select("doc_id", F.explode(x).alias("x")).select("doc_id", "x.*")


PLAIN_CHUNKS = r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
r AS (SELECT doc_id, CAST(-1 AS BIGINT) AS p, CAST(-1 AS BIGINT) AS stop FROM d UNION ALL
  SELECT doc_id, p, CASE WHEN hi < n AND cut > p + 600 THEN cut ELSE hi END FROM (SELECT *, greatest(
      CASE WHEN contains(w, chr(10) || chr(10)) THEN p + 601 + length(w) - strpos(reverse(w), chr(10) || chr(10)) ELSE 0 END,
      CASE WHEN contains(w, chr(10)) THEN p + 601 + length(w) - strpos(reverse(w), chr(10)) ELSE 0 END,
      CASE WHEN contains(w, ' ') THEN p + 601 + length(w) - strpos(reverse(w), ' ') ELSE 0 END) AS cut
    FROM (SELECT doc_id, n, p, least(n, p + 1200) AS hi, substr(text, p + 601, least(n, p + 1200) - p - 600) AS w FROM (
      SELECT r.doc_id, d.text, d.n, CASE WHEN r.stop < 0 THEN 0 WHEN r.stop < d.n THEN greatest(r.p + 1, r.stop - 200) ELSE r.stop END AS p FROM r JOIN d USING (doc_id)) WHERE p < n))),
c AS (SELECT doc_id, p, substr(text, p + 1, stop - p) AS t FROM r JOIN d USING (doc_id) WHERE stop > 0),
k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INT) AS chunk_index, CAST(p AS INT) AS start, t AS chunk_text FROM c WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> '')"""


@query(PLAIN_CHUNKS + " SELECT * FROM k")
def chunk_plain(spark, sf):
    return chunk.chunk_plain(table(spark, sf, "documents"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '^[A-Za-z]:[\\/]') THEN 'path' WHEN regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'url' ELSE 'unknown' END AS kind FROM pages")
def target_kind(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.target(F.col("url")).alias("kind"))


@query(r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS name, len(regexp_extract_all(html, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) AS n_links FROM pages".replace("len(", "CAST(len(").replace(", 1)) AS n_links", ", 1)) AS INT) AS n_links"))
def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_name(F.col("url")).alias("name"), F.size(T.wiki_links(F.col("html"))).alias("n_links"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE turn % 3 WHEN 0 THEN 'it is ' || role WHEN 1 THEN '' ELSE role || chr(10) || 'more' END AS thought, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM conversations")
def reasoning_split(spark, sf):
    """Turns with one thought before the answer, without one, and with two inside it."""
    m, t = F.col("turn") % 3, F.col("text")
    two = F.concat(F.substring(t, 1, 5), F.lit("<think>"), "role", F.lit("</think>"), F.substr(t, F.lit(6)), F.lit("<think> more\n</think>"))
    c = table(spark, sf, "conversations").withColumn("t", F.when(m == 0, F.concat(F.lit("<think> it is "), "role", F.lit(" </think> "), t)).when(m == 1, F.concat(F.lit(" "), t)).otherwise(two))
    a, b = T.reasoning(F.col("t"))
    return c.select("conv_id", "turn", F.coalesce(a, F.lit("")).alias("thought"), b.alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN 'no ' || event_type END AS message FROM events")
def error_text(spark, sf):
    """Messages of error payloads: direct, nested, in lists, under other names, and a payload without one."""
    said, m = F.concat(F.lit(" no "), "event_type"), F.col("event_id") % 5
    direct = F.struct(F.struct(said.alias("message")).alias("error"))
    deep = F.struct(F.struct(F.lit("").alias("message"), F.array(F.struct(F.struct(said.alias("title")).alias("detail"))).alias("details")).alias("error"))
    j = F.when(m == 0, F.to_json(direct)).when(m == 1, F.to_json(deep)).when(m == 2, F.to_json(F.struct(said.alias("detail")))).when(m == 3, F.to_json(F.array(F.struct(said.alias("error"))))).otherwise(F.to_json(F.struct(said.alias("note"))))
    return table(spark, sf, "events").select("event_id", T.error_message(j).alias("message"))


@query("SELECT p_partkey, p_name AS back FROM part")
def base64_codec(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.base64_auto(F.base64(F.encode("p_name", "UTF-8"))).alias("back"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem), k AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS f FROM h GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_suppkey) AS INT) AS number FROM k""")
def citations(spark, sf):
    k = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("f"))
    return k.select("l_orderkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("f", "l_suppkey")).alias("number"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'page ' || doc_id WHEN 1 THEN 'pages ' || doc_id || '-' || doc_id + 2 WHEN 2 THEN 'lines ' || doc_id || '-' || doc_id + 4 WHEN 3 THEN 'lines ' || doc_id || '-' || doc_id + 4 || ', paragraph ' || doc_id - 1 ELSE 'chunk ' || doc_id END AS place FROM documents""")
def location_labels(spark, sf):
    """Pages and lines with both ends, lines with and without a paragraph, and rows of which one end only is known."""
    i, m = F.col("doc_id"), F.col("doc_id") % 5
    p0, p1 = F.when(m.isin(0, 1, 4), i), F.when(m == 0, i).when(m == 1, i + 2)
    return table(spark, sf, "documents").select("doc_id", T.location_label(p0, p1, F.when(m.isin(2, 3), i), F.when(m.isin(2, 3), i + 4), i, F.when(m == 3, i - 1)).alias("place"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) SELECT doc_id, CAST(i + 1 AS INT) AS line_no, line FROM l WHERE i BETWEEN 1 AND 3")
def read_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("i between 1 and 3").select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


PAGED = """WITH l AS (SELECT doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line, i, i // 3 AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
p AS (SELECT doc_id, page, list_concat(list_concat([CASE WHEN page % 4 < 3 THEN 'Report' ELSE '' END], list(line ORDER BY i)), ['p ' || page % 2]) AS ls FROM l GROUP BY doc_id, page)"""


@query(PAGED + """, f AS (SELECT *, list_filter(ls, lambda x: x <> '') AS own, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
h AS (SELECT *, own[1] AS head, own[-1] AS foot, count(*) OVER (PARTITION BY doc_id, own[1]) AS heads, count(*) OVER (PARTITION BY doc_id, own[-1]) AS feet FROM f),
c AS (SELECT *, n >= 3 AND ls[1] = head AND 2 * heads >= n AS a, n >= 3 AND ls[-1] = foot AND 2 * feet >= n AS b FROM h)
SELECT doc_id, CAST(page + 1 AS INT) AS page, array_to_string(ls[CASE WHEN a THEN 2 ELSE 1 END : len(ls) - CASE WHEN b THEN 1 ELSE 0 END], chr(10)) AS body FROM c""".strip())
def repeated_edge_lines(spark, sf):
    """Pages of three lines with a header on most and footers in turn; headers and footers that half of a document's pages share go."""
    ls = F.split("text", "\n")
    at = F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / 3).cast("int"))
    pages = F.transform(at, lambda i: F.concat(F.array(F.when(i % 4 < 3, "Report").otherwise("")), F.slice(ls, i * 3 + 1, F.lit(3)), F.array(F.concat(F.lit("p "), (i % 2).cast("string")))))
    cleaned = pdf_pages.clean_pages(table(spark, sf, "documents").select("doc_id", pages.alias("pages")))
    return cleaned.select("doc_id", "page", F.array_join("lines", "\n").alias("body"))


@query("""SELECT l_orderkey, coalesce(string_agg(CASE WHEN l_linenumber % 3 <> 0 THEN 'ref ' || l_partkey END, chr(10) ORDER BY l_linenumber, 'ref ' || l_partkey), '') AS names, round(avg(CASE WHEN l_quantity > 10 THEN l_quantity END), 4) AS mean_positive, arg_min(l_linenumber, {'d': abs(l_quantity - 25), 'k': l_linenumber}) AS nearest FROM lineitem GROUP BY 1""")
def ordered_text(spark, sf):
    """The blocks of each order as one text: blank ones dropped, their mean and the one nearest to a point."""
    blocks = table(spark, sf, "lineitem").withColumn("block", F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(F.concat(F.lit(" ref "), F.col("l_partkey").cast("string"))))
    n = F.col("l_quantity")
    return blocks.groupBy("l_orderkey").agg(T.ordered_text("l_linenumber", "block").alias("names"), F.round(F.avg(F.when(n > 10, n)), 4).alias("mean_positive"), F.min_by("l_linenumber", F.struct(F.abs(n - 25).alias("d"), "l_linenumber")).alias("nearest"))

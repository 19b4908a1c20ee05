"""Queries on folder trees: rule files and joins of many prefixes; they join the catalog when imported."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..catalog import PATH, query
from ..operators import chunk, ignore, outline, paths
from ..sources.tables import corpus, table

# Rule files of the corpus. Those in src3 and src4 speak against those of the root.
RULES = [
    ("/corpus/.gitignore", "# drafts\ndoc-1*.md\n/src2/\n**/es/doc-?7.md\nfr\n"),
    ("/corpus/src3/.gitignore", "!doc-1*.md\nde/\n!de/doc-20.md\n"),
    ("/corpus/src4/.ignore", "doc-[3-5]*.md\n!en/doc-4*.md"),
    ("/corpus/.ignore", "!/src5/fr\n"),
    ("/corpus/.git/info/exclude", "doc-9*.md\n!doc-1*.md\n"),
]


@query(f"""WITH f AS (SELECT DISTINCT {PATH} AS path, source AS s, lang AS l, 'doc-' || doc_id || '.md' AS n FROM documents),
d AS (SELECT *, s = 'src2' OR (l = 'fr' AND s <> 'src5') OR (s = 'src3' AND l = 'de') AS folder_out,
  CASE WHEN s = 'src4' AND l = 'en' AND n LIKE 'doc-4%' THEN false WHEN s = 'src4' AND regexp_matches(n, '^doc-[3-5]') THEN true
    WHEN s = 'src3' AND n LIKE 'doc-1%' THEN false WHEN l = 'es' AND regexp_matches(n, '^doc-.7\\.md$') THEN true WHEN n LIKE 'doc-1%' THEN true
    WHEN n LIKE 'doc-9%' THEN true ELSE false END AS file_out FROM f)
SELECT path FROM d WHERE NOT folder_out AND NOT file_out""")
def ignored_tree(spark, sf):
    """Files that nested rule files let in: order, letting in again, anchors, classes, folders, kinds."""
    given = spark.createDataFrame(RULES, "path string, text string")
    return ignore.kept(corpus(spark, sf).select(F.col("absolute_path").alias("path")).distinct(), ignore.rules(given), "/corpus")


PREFIXES = f"q AS (SELECT '/corpus/' || source AS q FROM documents UNION SELECT '/corpus/' || source || '/' || lang || '/' FROM documents UNION SELECT {PATH} FROM documents WHERE doc_id % 3 = 0 UNION SELECT '/corpus/src_' UNION SELECT '/corpus/%' UNION SELECT '/corpus/src1/e')"


def _prefixes(spark, sf):
    c = corpus(spark, sf)
    own = [c.select(F.concat(F.lit("/corpus/"), "source").alias("q")), c.select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/")).alias("q")), c.where("doc_id % 3 = 0").select(F.col("absolute_path").alias("q")), spark.createDataFrame([("/corpus/src_",), ("/corpus/%",), ("/corpus/src1/e",)], "q string")]
    return own[0].unionByName(own[1]).unionByName(own[2]).unionByName(own[3]).distinct()


@query(f"WITH {PREFIXES}, d AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id, q AS prefix FROM d JOIN q ON path = rtrim(q, '/') OR starts_with(path, rtrim(q, '/') || '/')")
def prefix_descendants(spark, sf):
    """Every document with each of the many prefixes above it; signs that are wildcards elsewhere stand for themselves."""
    return paths.covered(corpus(spark, sf).select("doc_id", "absolute_path"), "absolute_path", _prefixes(spark, sf), "q").select("doc_id", "prefix")


@query(f"WITH {PREFIXES}, d AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id, arg_max(q, length(q)) AS prefix FROM d JOIN q ON starts_with(path, rtrim(q, '/') || '/') GROUP BY doc_id")
def nearest_roots(spark, sf):
    """The deepest folder of many that holds each document."""
    roots = _prefixes(spark, sf).where(~F.endswith("q", F.lit(".md")))
    return paths.nearest(corpus(spark, sf), "doc_id", "absolute_path", roots, "q")


@query(f"WITH d AS (SELECT doc_id, {PATH} AS path, source, lang FROM documents), g AS (SELECT '/corpus/' || source || '/' || lang AS q FROM documents GROUP BY source, lang HAVING min(doc_id) % 2 = 0) SELECT 'documents' AS name, doc_id FROM d WHERE '/corpus/' || source || '/' || lang NOT IN (SELECT q FROM g) UNION ALL SELECT 'labels', l.doc_id FROM labels l JOIN d USING (doc_id) WHERE '/corpus/' || source || '/' || lang NOT IN (SELECT q FROM g)")
def prefix_delete(spark, sf):
    """Half of the folders are deleted from two tables that name paths."""
    d = corpus(spark, sf).select("doc_id", "absolute_path", "source", "lang")
    gone = d.groupBy("source", "lang").agg(F.min("doc_id").alias("m")).where("m % 2 = 0").select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang").alias("q"))
    labels = table(spark, sf, "labels").join(d.select("doc_id", "absolute_path"), "doc_id")
    left = paths.without([d, labels], "absolute_path", gone, "q")
    return left[0].select(F.lit("documents").alias("name"), "doc_id").unionByName(left[1].select(F.lit("labels").alias("name"), "doc_id"))


OUTLINE = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
t AS (SELECT doc_id, i, CASE WHEN i % 17 = 3 THEN '## ' || line WHEN i % 23 = 5 THEN '```' WHEN i % 19 = 7 THEN '---' WHEN i % 29 = 4 THEN '# top' WHEN i % 13 = 6 THEN '- ' || line ELSE line END AS line FROM l),
s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM t),
c AS (SELECT *, regexp_extract(line, '^\s{0,3}(`{3,}|~{3,})', 1) AS fence, regexp_extract(s, '^(#{1,6})\s*(\S.*)$', 1) AS hashes, regexp_extract(s, '^(#{1,6})\s*(\S.*)$', 2) AS title,
  CASE WHEN regexp_full_match(lead(s) OVER w, '={3,}') THEN 1 WHEN regexp_full_match(lead(s) OVER w, '-{3,}') THEN 2 ELSE 0 END AS under, regexp_matches(line, '^\s*(?:[-*+] |\d+[.)] )') AS item,
  CASE WHEN regexp_full_match(s, '`+') THEN '`' WHEN regexp_full_match(s, '~+') THEN '~' ELSE '' END AS solid, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS i, 'n' AS mode, '' AS fc, 0 AS fl, false AS begins, false AS inside, CAST([] AS VARCHAR[]) AS stack FROM c
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN r.mode = 'f' THEN CASE WHEN c.solid = r.fc AND length(c.s) >= r.fl THEN 'n' ELSE 'f' END WHEN r.mode = 'u' OR c.s = '' THEN 'n' WHEN c.fence <> '' THEN 'f' WHEN c.hashes <> '' THEN 'n' WHEN c.under > 0 THEN 'u' ELSE 'p' END,
    CASE WHEN r.mode = 'f' THEN r.fc ELSE left(c.fence, 1) END, CASE WHEN r.mode = 'f' THEN r.fl ELSE CAST(length(c.fence) AS INT) END,
    r.mode NOT IN ('f', 'u') AND c.s <> '' AND (c.fence <> '' OR c.hashes <> '' OR c.under > 0 OR r.mode <> 'p' OR c.item), r.mode IN ('f', 'u') OR c.s <> '',
    CASE WHEN r.mode IN ('f', 'u') OR c.s = '' OR c.fence <> '' THEN r.stack WHEN c.hashes <> '' THEN list_append(r.stack[1:length(c.hashes) - 1], c.title) WHEN c.under > 0 THEN list_append(r.stack[1:c.under - 1], c.s) ELSE r.stack END
  FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1),
o AS (SELECT doc_id, i, CAST(start AS BIGINT) AS start, length(line) AS n, begins, inside, stack FROM r JOIN c USING (doc_id, i))"""


@query(OUTLINE + " SELECT doc_id, i AS line_no, start, CAST(n AS INT) AS n_chars, begins, inside, array_to_string(stack, ' > ') AS headings FROM o")
def line_outline(spark, sf):
    """Every line of the documents, to which headings, fences, rules and items are added, with its offset, block and headings."""
    o = outline.line_outline(_decorated(spark, sf), segment_lines=8)
    return o.select("doc_id", "line_no", "start", "n_chars", "begins", "inside", F.array_join("heading_path", " > ").alias("headings"))


def _decorated(spark, sf):
    line = lambda s, i: F.when(i % 17 == 3, F.concat(F.lit("## "), s)).when(i % 23 == 5, "```").when(i % 19 == 7, "---").when(i % 29 == 4, "# top").when(i % 13 == 6, F.concat(F.lit("- "), s)).otherwise(s)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


# What the recursive reading of lines makes of documents as they are, and the chunks of its blocks.
PLAIN = re.sub(r"t AS \(SELECT doc_id, i, CASE .*? END AS line FROM l\)", "t AS (SELECT doc_id, i, line FROM l)", OUTLINE, flags=re.S)
MARKDOWN_CHUNKS = r""",
z AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM t GROUP BY doc_id),
g AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS b FROM o),
b AS (SELECT doc_id, b, min(i) AS l0, max(i) + 1 AS l1, min(start) AS s0, max(start + n) AS e0, arg_min(stack, i) AS path FROM g WHERE inside GROUP BY doc_id, b),
j AS (SELECT x.doc_id, x.b AS i, min(y.b) AS j FROM b x JOIN b y ON y.doc_id = x.doc_id AND y.b >= x.b LEFT JOIN b z ON z.doc_id = y.doc_id AND z.b = y.b + 1
  WHERE z.b IS NULL OR NOT (y.e0 - x.s0 < 350 AND z.e0 - z.s0 <= 550 AND z.path = x.path AND z.e0 - x.s0 <= 550) OR x.e0 - x.s0 > 550 GROUP BY ALL),
k AS (SELECT j.doc_id, i, j, CASE WHEN any_value(n.path) = any_value(x.path) AND any_value(x.e0 - x.s0) <= 550 THEN coalesce(max(CASE WHEN m.b = i + 1 OR y.e0 - m.s0 >= 80 THEN m.b END), j + 1) ELSE j + 1 END AS nxt
  FROM j JOIN b x ON x.doc_id = j.doc_id AND x.b = i JOIN b y ON y.doc_id = j.doc_id AND y.b = j LEFT JOIN b n ON n.doc_id = j.doc_id AND n.b = j + 1 LEFT JOIN b m ON m.doc_id = j.doc_id AND m.b > i AND m.b <= j GROUP BY j.doc_id, i, j),
w AS (SELECT doc_id, i, j, nxt FROM k WHERE i = 0 UNION ALL SELECT k.doc_id, k.i, k.j, k.nxt FROM w JOIN k ON k.doc_id = w.doc_id AND k.i = w.nxt),
c2 AS (SELECT w.doc_id, w.i, x.l0, y.l1, x.path, substr(d.text, x.s0 + 1, y.e0 - x.s0) AS t, x.e0 - x.s0 > 550 AS large FROM w JOIN b x ON x.doc_id = w.doc_id AND x.b = w.i JOIN b y ON y.doc_id = w.doc_id AND y.b = w.j JOIN z d ON d.doc_id = w.doc_id),
p AS (SELECT doc_id, i, l0, l1, path, unnest(CASE WHEN large THEN range(0, length(t), 550) ELSE [0] END) AS at_, t, large FROM c2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, at_) - 1 AS INT) AS chunk_index, CAST(l0 AS INT) AS line_start, CAST(l1 AS INT) AS line_end, array_to_string(path, ' > ') AS headings, CASE WHEN large THEN substr(t, at_ + 1, 550) ELSE t END AS chunk_text FROM p"""


@query(PLAIN + MARKDOWN_CHUNKS)
def chunk_markdown(spark, sf):
    """Chunks of every document with their lines and headings."""
    return chunk.chunk_markdown(table(spark, sf, "documents")).withColumn("heading_path", F.array_join("heading_path", " > ")).withColumnRenamed("heading_path", "headings")


@query(OUTLINE + MARKDOWN_CHUNKS)
def chunk_headed(spark, sf):
    """The same of documents to which headings, fences, rules and items are added."""
    return chunk.chunk_markdown(_decorated(spark, sf)).withColumn("heading_path", F.array_join("heading_path", " > ")).withColumnRenamed("heading_path", "headings")

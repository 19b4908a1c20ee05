"""Queries on stored indexes after changes, and on bodies that come in chunks; they join the catalog when imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import BM25, PATH, TERMS, _postings, query
from ..sources import shared
from ..sources.tables import corpus, table
from ..streaming import stateful
from ..streaming.upkeep import Corpus

CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN text || ' thing thing' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 5)"


def _changed_postings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")

    def build(t, folder):
        i = _postings(spark, folder)
        for n in range(3):
            i.change(added=t.where(f"doc_id % 3 = {n}"))
        i.change(added=t.where("doc_id % 7 = 3").withColumn("text", F.concat("text", F.lit(" thing thing"))), removed=t.where("doc_id % 22 = 5"))
        i.compact(3)
        i.change(removed=t.where("doc_id % 11 = 5"))

    return _postings(spark, shared.built(d, "changed-postings", build))


@query(BM25.replace("FROM documents", f"FROM {CHANGED}") + "SELECT doc_id, round(rank, 6) AS rank FROM r")
def changed_postings(spark, sf):
    """Ranks from postings that were added in parts, partly replaced, merged and partly deleted."""
    return _changed_postings(spark, sf).search([[t] for t in TERMS]).withColumn("rank", F.round("rank", 6))


@query(BM25.replace("FROM documents", f"FROM {CHANGED}") + "SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY r.rank, doc_id LIMIT 25")
def changed_postings_topk(spark, sf):
    """The best 25 of them, from the lots that can hold them."""
    return _changed_postings(spark, sf).top([[t] for t in TERMS], 25).withColumn("rank", F.round("rank", 6))


def _lines(files):
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text")).where(F.trim("chunk_text") != "")


@query(f"""WITH d AS (SELECT {PATH} AS path, CASE WHEN doc_id % 5 = 2 THEN replace(text, 'e', 'oe') || chr(10) || 'end' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3 AND lang <> 'es'),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line FROM d)
SELECT path, count(*) AS n_chunks, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) AS n_indexed FROM l WHERE trim(line, ' ') <> '' GROUP BY path""")
def followed_corpus(spark, sf):
    """Chunks of a corpus after a first batch of all paths, a second one of changes and deletes, and the second once more."""

    def files(paths, changed):
        d = corpus(spark, sf)
        if changed:
            d = d.where("doc_id % 7 <> 3").withColumn("text", F.when(F.col("doc_id") % 5 == 2, F.concat(F.replace("text", F.lit("e"), F.lit("oe")), F.lit("\nend"))).otherwise(F.col("text")))
        d = d.select(F.col("absolute_path").alias("path"), "text", F.octet_length("text").cast("long").alias("size_bytes"), F.col("modified_at_ms") + F.when(F.lit(changed), F.col("doc_id") % 2).otherwise(0), F.md5("text").alias("content_md5"), F.lit("v1").alias("fingerprint"), (F.col("lang") != "es").alias("eligible"), (F.trim("text") != "").alias("has_text"))
        return d.toDF("path", "text", "size_bytes", "modified_at_ms", "content_md5", "fingerprint", "eligible", "has_text").join(paths.hint("shuffle_hash"), "path", "left_semi")

    def build(t, folder):
        c = Corpus(spark, folder, _lines)
        paths = t.select(F.col("absolute_path").alias("path"))
        c.apply(paths, lambda p: files(p, False), ("query", 0))
        for _ in range(2):
            c.apply(paths, lambda p: files(p, True), ("query", 1))

    c = Corpus(spark, shared.built(corpus(spark, sf).select("absolute_path"), "corpus", build), _lines)
    indexed = c.postings.documents(c.postings.state()["segments"]).select(F.col("key").alias("chunk_key"), F.lit(1).alias("indexed"))
    lengths = lambda rows: rows.select("path", "log", "chunk_key", F.length("chunk_text").alias("n"))
    return c.chunks(own=lengths).join(indexed, "chunk_key", "left").groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_chars"), F.count("indexed").alias("n_indexed"))


@query("SELECT conv_id || '/' || turn || '/' || md5(text) AS body, nullif(text, '') AS content, text AS arguments, 'find' AS name, 'stop' AS finish_reason FROM conversations WHERE text IS NOT NULL")
def chunked_bodies(spark, sf):
    """Answers of event streams cut every 61 bytes, inside characters, lines and open tool arguments."""
    t, half = F.col("text"), (F.length("text") / 2).cast("int")
    frame = lambda delta, end: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"), end.alias("finish_reason"))).alias("choices"))), F.lit("\r\n\r\n"))
    none = F.lit(None).cast("string")
    call = lambda text, first: F.struct(F.array(F.struct(F.lit(0).alias("index"), F.lit("c1" if first else None).cast("string").alias("id"), F.struct(F.lit("find" if first else None).cast("string").alias("name"), text.alias("arguments")).alias("function"))).alias("tool_calls"))
    parts = [frame(call(F.substr(t, F.lit(1), half), True), none), frame(F.struct(t.alias("content")), none), frame(call(F.substr(t, half + 1), False), F.lit("stop")), F.lit("data: [DONE]\n\n")]
    c = table(spark, sf, "conversations").where("text is not null").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("/"), F.md5("text")).alias("body"), F.encode(F.concat(*parts), "UTF-8").alias("bytes"))
    n = F.ceil(F.octet_length("bytes") / 61).cast("int")
    cut = c.select("body", "bytes", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    chunks = cut.select("body", "seq", F.substring("bytes", F.col("seq") * 61 + 1, F.lit(61)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("last"))
    return stateful.chunked_answers(chunks).select("body", "content", F.get_json_object("tool_calls", "$[0].arguments").alias("arguments"), F.get_json_object("tool_calls", "$[0].name").alias("name"), "finish_reason")

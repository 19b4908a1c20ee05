"""Benchmark contamination by a prefix-filtered containment join, all in DataFrame functions.

Every item gives windows of ``size`` consecutive words. The tokens of a window are
ordered by their count in the corpus. Containment of the whole window makes one token
of the shortest prefix, its rarest token, necessary: document words are joined with
these tokens only. The token's place in the window then fixes where the window would
begin; the bounds of the document rule out places before its first or after its last
word, and the words there are compared with the window's.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, Store, bounded, session, text_key, text_or_empty, within

def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words_of(c: str) -> Column:
    """The words of a text. Only the first and the last part of a split can be empty."""
    parts = F.split(ascii_lower(text_or_empty(c)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    blank = lambda x: F.when(x == "", 1).otherwise(0)
    first = blank(F.get(parts, 0))
    n = F.size(parts) - first - blank(F.get(parts, F.size(parts) - 1))
    return F.slice(parts, first + 1, F.greatest(n, F.lit(0)))


def windows(items: DataFrame, size: int) -> DataFrame:
    """The distinct windows of all items: win (words joined), n (their number), items (sorted ids)."""
    w = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words_of("text").alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    w = w.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("win"))
    return w.groupBy("win", "n").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, store: Store, size: int = 13, share: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document row: words, hit words, items with an occurring window, the windows' places, and the verdict.

    ``items`` are their ids; ``spans`` are distinct places, from word a to before word b,
    counted from 0.

    A document is contaminated if ``n_hit > 0 and share * n_hit >= n_words``. Null texts
    have no words. Items with a null id are left out, as they can't be named; repeated
    items and windows count once; repeated documents get the same row each. Very long
    texts are read whole. Without documents there are no rows, without items no hits;
    other columns are not read.
    """
    win = store.put(windows(items, size), "windows")
    own = win.select("win", F.posexplode(F.split("win", " ")).alias("at", "word"))
    vocabulary = store.put(own.select("word").distinct(), "vocabulary")
    # texts are split once; counting and looking read the words
    d = store.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), words_of("text").alias("words")), "words")
    # rarity: counts over all documents, summed before the shuffle
    counts = d.select(F.explode("words").alias("word")).join(bounded(vocabulary, broadcast_rows), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = store.put(counts, "counts")
    # a window with a word that the corpus lacks can't occur
    ranked = own.join(counts, "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "word")).alias("p"))
    prefix = store.put(win.join(ranked.where("p.n > 0"), "win").select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "n", "win", "items"), "prefixes")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("size"))
    place = [F.size("words").alias("size"), F.posexplode("words").alias("pos", "word")]
    if within(prefix, broadcast_rows):
        placed = d.select("doc_id", "key", "words", *place).join(F.broadcast(prefix), "word").where(fits)
    else:
        # single words are shuffled; a document's words come back only where a window may begin
        spots = d.select("doc_id", "key", *place).join(prefix, "word").where(fits)
        spots = spots.select(F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), "pos", "at", "n", "win", "items", "size")
        placed = d.join(spots, d.doc_id.eqNullSafe(spots.p_id) & (d.key == spots.p_key)).drop("p_id", "p_key")
    found = placed.where(F.array_join(F.slice("words", F.when(fits, start + 1).otherwise(1), F.col("n")), " ") == F.col("win"))
    found = found.select("doc_id", "key", F.struct(start.alias("a"), (start + F.col("n")).alias("b")).alias("span"), "items")
    hits = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.b - F.greatest(s.a, acc.upto))).alias("n"), F.greatest(acc.upto, s.b).alias("upto")),
        lambda acc: acc.n,
    )
    hits = hits.select(F.col("doc_id").alias("h_id"), F.col("key").alias("h_key"), covered.cast("long").alias("n_hit"), F.array_sort("items").alias("items"), "spans")
    hits = store.put(hits, "hits")
    sizes = d.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    out = sizes.join(hits, sizes.doc_id.eqNullSafe(hits.h_id) & (sizes.key == hits.h_key), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, store: Store) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever these are called. Repeated rows share their fate."""
    bad = contamination(docs, items, store).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    bad = store.put(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad.bad_id) & (text_key("text") == bad.bad_key), "left_anti")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the items of ``benchmark``; see ``contamination``."""
    session(spark)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    found = contamination(docs, items, Store(spark))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b0 AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
b1 AS (SELECT item_id, w, least(len(w), 13) AS n FROM b0 WHERE len(w) > 0),
b2 AS (SELECT item_id, n, w, unnest(range(len(w) - n + 1)) AS i FROM b1),
b AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS win FROM b2),
sizes AS (SELECT DISTINCT n FROM b),
d1 AS (SELECT r, n, w, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM d0, sizes),
m AS (SELECT r, d.i, d.n, item_id FROM (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS win FROM d1) d JOIN b ON b.win = d.win AND b.n = d.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d0 LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

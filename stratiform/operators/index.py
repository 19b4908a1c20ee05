"""Index maintenance: change detection, stale paths, upserts, activation and set digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOD = "18446744073709551616"


def change_plan(scanned: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, plan): skip, unchanged, refresh, reindex or delete, as the ladder of tests in order decides.

    Both sides have size_bytes, modified_at_ms, content_md5 and fingerprint; ``scanned`` also
    has eligible and has_text, ``stored`` has chunk_count.
    """
    return _laddered(scanned, stored, key).select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), "plan")


def change_steps(scanned: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The plan of each key and what else is to be done: (key, plan, refresh_record, clear_pending, refresh_projection).

    Besides what ``change_plan`` asks for, both sides have source_root and relative_path, and
    ``stored`` has pending, whether a version waits that was never finished. A file that moved to
    another root keeps its chunks, whose projected paths are refreshed; a waiting version of an unchanged file goes.
    """
    j = _laddered(scanned, stored, key)
    kept = F.col("plan").isin("unchanged", "refresh")
    moved = ~(F.col("s.source_root").eqNullSafe(F.col("t.source_root")) & F.col("s.relative_path").eqNullSafe(F.col("t.relative_path")))
    pending = F.coalesce(F.col("t.pending"), F.lit(False))
    steps = {"refresh_record": kept & ((F.col("plan") == "refresh") | moved | pending), "clear_pending": kept & pending, "refresh_projection": kept & moved}
    return j.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), "plan", *[c.alias(n) for n, c in steps.items()])


def _laddered(scanned: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    s, t = scanned.alias("s"), stored.alias("t")
    same = F.col("s.fingerprint") == F.col("t.fingerprint")
    plan = (
        F.when(F.col(f"s.{key}").isNull(), "delete")
        .when(~F.col("s.eligible"), F.when(F.col(f"t.{key}").isNotNull(), "delete").otherwise("skip"))
        .when(same & (F.col("s.size_bytes") == F.col("t.size_bytes")) & (F.col("s.modified_at_ms") == F.col("t.modified_at_ms")), "unchanged")
        .when(same & (F.col("s.content_md5") == F.col("t.content_md5")), "refresh")
        .when(~F.col("s.has_text"), F.when(F.col("t.chunk_count") > 0, "skip").otherwise("skip_marker"))
        .otherwise("reindex")
    )
    return s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full").withColumn("plan", plan)


def stale(stored: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    return stored.join(visited.select(key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key; a new snapshot, not a change in place."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def reuse(chunks: DataFrame, cache: DataFrame, on: list[str], vector: str) -> DataFrame:
    return chunks.join(cache.select(*on, vector), on, "left")


# What parts headings, and headings from the text, in a reuse key.
HEADING_SEPARATOR, TEXT_SEPARATOR = "\x1f", "\0"


def reuse_key(text: Column, headings: Column) -> Column:
    """Chunks of the same text under the same headings share it, and with it their vectors."""
    return F.md5(F.encode(F.concat(F.array_join(headings, HEADING_SEPARATOR), F.lit(TEXT_SEPARATOR), text), "UTF-8"))


def chunk_rows(chunks: DataFrame, files: DataFrame, path: str = "absolute_path") -> DataFrame:
    """Rows of staged chunks with the columns of their file's pending version.

    ``chunks`` has the path, chunk_index, page_start, page_end, line_start, line_end, heading_path and text,
    and what else is to be kept; ``files`` has the path, version_id and what else a chunk takes from its file. An
    id names the version, the place in it and the pages and lines (0 where there are none).
    """
    place = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).cast("string") for c in ("page_start", "page_end", "line_start", "line_end")]
    name = F.concat(F.col(path), F.lit("#"), F.concat_ws(":", F.col("version_id"), F.col("chunk_index").cast("string"), *place))
    return chunks.join(files, path).withColumns({"id": name, "chunk_state": F.lit("staged"), "chunk_reuse_key": reuse_key(F.col("text"), F.col("heading_path")), "text_fingerprint": F.md5(F.encode("text", "UTF-8"))})


def wrapping_sum(c: Column) -> Column:
    """Sum modulo 2**64 of longs taken as unsigned."""
    u = F.pmod(c.cast("decimal(38,0)"), F.lit(MOD).cast("decimal(38,0)"))
    return F.pmod(F.sum(u), F.lit(MOD).cast("decimal(38,0)"))


def set_digest(keys: DataFrame, key: str) -> DataFrame:
    return keys.agg(F.count(F.lit(1)).alias("n"), F.expr(f"bit_xor({key})").alias("key_xor"), wrapping_sum(F.col(key)).cast("string").alias("key_sum"))


def key_hash(key: Column) -> Column:
    """60 bits that depend on a key in a fixed way."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")


def digest(keys: DataFrame, key: str) -> DataFrame:
    """One row: number, xor and wrapping sum of the keys and of their hashes."""
    k = keys.select(F.col(key).cast("bigint").alias("k"), key_hash(F.col(key)).alias("h"))
    return k.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.expr("bit_xor(k)"), F.lit(0).cast("bigint")).alias("key_xor"), F.coalesce(wrapping_sum(F.col("k")), F.lit(0)).cast("decimal(20,0)").alias("key_sum"), F.coalesce(F.expr("bit_xor(h)"), F.lit(0).cast("bigint")).alias("hash_xor"), F.coalesce(wrapping_sum(F.col("h")), F.lit(0)).cast("decimal(20,0)").alias("hash_sum"))


def digest_after(now: DataFrame, added: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A digest after keys have come and gone, from the digests of these alone: no key of the index is read again."""
    a, r = digest(added, key), digest(removed, key)
    both = now.alias("d").join(a.alias("a"), F.lit(True)).join(r.alias("r"), F.lit(True))
    c = lambda t, n: F.col(f"{t}.{n}")
    xor = lambda n: c("d", n).bitwiseXOR(c("a", n)).bitwiseXOR(c("r", n)).alias(n)
    wrap = lambda n: F.pmod((c("d", n) + c("a", n) - c("r", n)).cast("decimal(38,0)"), F.lit(MOD).cast("decimal(38,0)")).cast("decimal(20,0)").alias(n)
    return both.select((c("d", "n") + c("a", "n") - c("r", "n")).alias("n"), xor("key_xor"), wrap("key_sum"), xor("hash_xor"), wrap("hash_sum"))


def event_plans(events: DataFrame, stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, plan) of one batch of watcher events (key): each changed path once, by what is stored and what lies there now."""
    changed = events.select(key).where(F.col(key).isNotNull()).distinct()
    plans = change_plan(found.join(changed, key, "left_semi"), stored.join(changed, key, "left_semi"), key)
    return changed.join(plans, key, "left").select(key, F.coalesce("plan", F.lit("noop")).alias("plan"))


def assign_keys(rows: DataFrame, order: list[str], start: int, most: int = 100_000) -> DataFrame:
    """Generated keys in a stable order, after ``start``: rows are dealt to buckets of ``most`` or so, whose sizes say where each begins."""
    buckets = max(64, rows.count() // most)
    w = Window.partitionBy("b").orderBy(*order)
    b = rows.withColumn("b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    n = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    # one row a bucket
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return b.join(F.broadcast(before.select("b", "before")), "b").withColumn("vector_key", F.row_number().over(w) + F.col("before") + start).drop("b", "before")


def probes(keys: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """Keys at the offsets 0, a third, two thirds and the last of a numeric key's order.

    Counts of equally wide buckets say where the offsets are; only the rows of those few
    buckets are ordered.
    """
    ends = keys.agg(F.min(key).alias("low"), F.max(key).alias("high"))
    width = (F.col("high") - F.col("low")).cast("double") / buckets
    b = keys.join(F.broadcast(ends), F.lit(True)).withColumn("b", F.when(width > 0, F.least(F.floor((F.col(key) - F.col("low")) / width), F.lit(buckets - 1))).otherwise(0)).select(key, "b")
    n = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    # at most ``buckets`` rows
    w = Window.orderBy("b")
    n = n.withColumns({"upto": F.sum("n").over(w), "last": F.sum("n").over(Window.partitionBy(F.lit(0))) - 1}).withColumn("before", F.col("upto") - F.col("n"))
    at = n.select("b", "before", "upto", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(F.col("last") / 3), F.floor(F.col("last") * 2 / 3), F.col("last")))).alias("offset"))
    at = at.where((F.col("offset") >= F.col("before")) & (F.col("offset") < F.col("upto"))).groupBy("b", "before").agg(F.collect_set("offset").alias("offsets"))
    own = b.join(F.broadcast(at), "b").withColumn("o", F.row_number().over(Window.partitionBy("b").orderBy(key)) - 1 + F.col("before"))
    return own.where(F.array_contains("offsets", F.col("o"))).select(key, F.col("o").cast("long").alias("offset"))

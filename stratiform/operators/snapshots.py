"""Versions of the index: snapshots of tables, state switches, and what to do with a store that does not add up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Snapshots:
    """A table as folders of versions. An empty marker file names each version once it is whole,
    so that readers see the old or the new one. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def marks(self) -> list[str]:
        folder = self.path(f"{self.root}/_versions")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def current(self) -> DataFrame | None:
        m = self.marks()
        return self.spark.read.parquet(f"{self.root}/{m[-1]}") if m else None

    def commit(self, df: DataFrame) -> DataFrame:
        m = self.marks()
        name = f"{int(m[-1].split('-')[0]) + 1 if m else 1:010d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        self.fs.createNewFile(self.path(f"{self.root}/_versions/{name}"))
        return self.spark.read.parquet(f"{self.root}/{name}")

    def prune(self, keep: int = 2) -> None:
        marks = self.marks()
        for name in marks[: max(0, len(marks) - keep)]:
            self.fs.delete(self.path(f"{self.root}/_versions/{name}"), False)
            self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def reset(self) -> None:
        """All versions go, marked or left behind by a writer that stopped."""
        self.fs.delete(self.path(self.root), True)


def active(chunks: DataFrame) -> DataFrame:
    """What readers see: rows of active versions only."""
    return chunks.where(F.col("chunk_state") == "active")


def activate(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """``done`` (path, version): that version's staged rows become active, the path's other active rows go."""
    d = done.select("path", F.col("version").alias("new_version"))
    own = F.col("version") == F.col("new_version")
    gone = F.col("new_version").isNotNull() & ~own & (F.col("chunk_state") == "active")
    return chunks.join(d, "path", "left").where(~F.coalesce(gone, F.lit(False))).withColumn("chunk_state", F.when(own, "active").otherwise(F.col("chunk_state"))).select(*chunks.columns)


def finalize(records: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` (path, n): the pending version becomes the active one, with its chunk count."""
    on = F.col("n").isNotNull() & F.col("pending_version").isNotNull()
    new = {"active_version": F.when(on, F.col("pending_version")).otherwise(F.col("active_version")), "chunk_count": F.when(on, F.col("n")).otherwise(F.col("chunk_count")), "pending_version": F.when(~on, F.col("pending_version"))}
    return records.join(counts, "path", "left").withColumns(new).select(*records.columns)


def refresh(records: DataFrame, changed: DataFrame, key: str, column: str) -> DataFrame:
    """One projected column takes the value of ``changed`` where there is one."""
    return records.join(changed.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).select(*records.columns)


def cascade(tables: list[DataFrame], keys: DataFrame, key: str) -> list[DataFrame]:
    """Every table without the rows of the deleted keys."""
    return [t.join(keys.select(key), key, "left_anti") for t in tables]


def reset_decision(artifacts: Column, schema_ok: Column, files_ok: Column, same_target: Column, chunk_table: Column, file_rows: Column, active_files: Column, active_chunks: Column, usable: Column, recoverable: Column, dirty: Column) -> Column:
    """What to do with a store, from its findings, the gravest first."""
    return (
        F.when((artifacts & ~schema_ok) | ~files_ok | ~same_target, "reset")
        .when(artifacts & ~chunk_table, "reset")
        .when(chunk_table & ~file_rows, "clear_index")
        .when(file_rows & ~chunk_table, "reset")
        .when(active_files & ~active_chunks, "reset")
        .when(active_chunks & ~usable, F.when(recoverable, "rebuild").otherwise("reset"))
        .when(dirty, "clear_marker")
        .otherwise("keep")
    )


def start_mode(before: dict | None, after: dict) -> str:
    """Whether changed roots, ignore globs (both as sets) or the embedding target ask for a new index."""
    same = before is None or (all(set(before[k]) == set(after[k]) for k in ("roots", "globs")) and before["target"] == after["target"])
    return "reuse" if same else "rebuild"


def alias_lookup(scanned: DataFrame, stored: DataFrame, key: str, aliases: str, record: str) -> DataFrame:
    """(key, record): the stored record under the first of a row's aliases that has one, else null."""
    a = scanned.select(key, F.posexplode(F.array_distinct(aliases)).alias("_at", "_alias"))
    found = a.join(stored.select(F.col(key).alias("_alias"), F.col(record)), "_alias", "left")
    return found.groupBy(key).agg(F.min_by(record, F.when(F.col(record).isNotNull(), F.col("_at"))).alias(record))


def resolve_reference(rows: DataFrame, ref: str, bindings: DataFrame, key: str, default: str) -> DataFrame:
    """Rows with ``bound``: their reference if a binding has it, else the default."""
    known = bindings.select(F.col(key).alias("_known")).distinct()
    return rows.join(known, F.col(ref) == F.col("_known"), "left").withColumn("bound", F.coalesce("_known", F.lit(default))).drop("_known")


def outermost(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths without those under another one: an equal join on ancestors, not on prefixes."""
    p = paths.select(path).where(F.col(path).isNotNull()).distinct()
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nested = p.where(F.size(parts) > 1).select(path, F.explode(above).alias("_above")).join(p.select(F.col(path).alias("_above")), "_above").select(path)
    return p.join(nested, path, "left_anti")


def common_prefix(a: Column, b: Column) -> Column:
    """The longest beginning that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    apart = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i)))
    return F.slice(a, F.lit(1), F.get(apart, F.lit(0)))


def group_prefix(rows: DataFrame, by: str, path: str) -> DataFrame:
    """The prefix that all arrays of a group share is that of the least and the greatest, which combine before a shuffle."""
    return rows.groupBy(by).agg(F.min(path).alias("_a"), F.max(path).alias("_b")).select(by, common_prefix(F.col("_a"), F.col("_b")).alias("prefix"))


def longest_prefix(rows: DataFrame, text: str, cache: DataFrame, prefix: str) -> DataFrame:
    """Rows with the longest cached prefix of their text, or null: an equal join on the text's beginnings.

    Each distinct text is taken once, and only its beginnings of lengths that cached prefixes have. The join is a
    semi join, so that only the cached prefixes may be broadcast, not the beginnings, whose size Spark guesses too small.
    """
    known = cache.select(prefix).where(F.col(prefix).isNotNull()).distinct()
    lengths = known.agg(F.collect_set(F.length(prefix)).alias("_lengths"))  # one row
    own = F.filter("_lengths", lambda n: n <= F.length(text))
    texts = rows.select(text).where(F.col(text).isNotNull()).distinct().join(F.broadcast(lengths), F.lit(True))
    starts = texts.select(text, F.explode(F.transform(own, lambda n: F.substr(F.col(text), F.lit(1), n))).alias(prefix))
    best = starts.join(known, prefix, "left_semi").groupBy(text).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(best, text, "left").select(*rows.columns, prefix)

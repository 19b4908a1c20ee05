"""Joins of many path prefixes with many paths, as equal joins on folders on the way to a path.

A prefix is a folder or file; it covers itself and what lies below it. Names are compared
as they are: no character is a wildcard and a mere common beginning of names does not count. Only
the ancestors at depths that some prefix has are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Counted prefixes up to which they are sent to all tasks.
FEW = 200_000


def plain(path: Column) -> Column:
    """Without slashes at the end; the root is empty."""
    return F.regexp_replace(path, "/+$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def way(path: Column) -> Column:
    """All folders on the way to a plain path, from the top, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def covered(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each row with every one of the distinct prefixes that covers its path, as a column ``prefix``."""
    p = prefixes.where(F.col(prefix).isNotNull()).select(F.col(prefix).alias("_prefix"), plain(F.col(prefix)).alias("_on")).distinct()
    known = p.agg(F.collect_set(depth(F.col("_on"))).alias("depths"), F.count(F.lit(1)).alias("n")).first()  # as many depths as paths have
    if known["n"] <= FEW:
        p = F.broadcast(p)
    parts = F.split(plain(F.col(path)), "/")
    ancestors = [F.when(F.size(parts) >= d, F.array_join(F.slice(parts, 1, d), "/")) for d in sorted(known["depths"])]
    on = F.explode(F.array_compact(F.array(*ancestors))) if ancestors else F.lit(None).cast("string")
    found = rows.withColumn("_on", on).join(p, "_on").drop("_on")
    return found.withColumnRenamed("_prefix", "prefix")


def nearest(rows: DataFrame, key: str, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(key, prefix): the longest prefix that covers the path; rows without one are left out."""
    return covered(rows.select(key, path), path, prefixes, prefix).groupBy(key).agg(F.max_by("prefix", F.struct(F.length("prefix"), F.col("prefix"))).alias("prefix"))


def within(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows that some prefix covers, each once."""
    return rows.join(covered(rows.select(path).distinct(), path, prefixes, prefix).select(path), path, "left_semi")


def without(tables: list[DataFrame], path: str, prefixes: DataFrame, prefix: str) -> list[DataFrame]:
    """Every table without the rows that a prefix covers: a delete of folders from all tables that name their paths."""
    return [t.join(covered(t.select(path).distinct(), path, prefixes, prefix).select(path), path, "left_anti") for t in tables]

"""Aggregations over event tables; the first two also work on streams. Ordered folds and their streaming twins are in ``stateful``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def debounce(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """A batch stays open while events come within the gap. Works on batch and streaming frames alike."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")


def last_writer(rows: DataFrame, key: list[str], ts: str, arrival: str) -> DataFrame:
    """Newest row of each key; of equal times the one that came first stays."""
    r = F.struct(F.col(ts).alias("t"), (-F.col(arrival)).alias("a"), F.struct(*[c for c in rows.columns if c not in key]).alias("row"))
    return rows.withColumn("r", r).groupBy(*key).agg(F.max("r").alias("r")).select(*key, "r.row.*")


def clipboard(events: DataFrame, key: str, text: str, ts: str, pinned_at: Column, keep: int = 10, pins: int = 5) -> DataFrame:
    """Entries by exact text: pinned ones by the time of pinning, then of sight (to ``pins``), and the ones seen last (to ``keep``)."""
    e = events.where(F.trim(text) != "").groupBy(key, F.col(text).alias("entry")).agg(F.max(ts).alias("seen"), F.max(pinned_at).alias("pinned_at"))
    e = e.withColumn("pinned", F.col("pinned_at").isNotNull())
    w = Window.partitionBy(key, "pinned").orderBy(F.desc(F.coalesce("pinned_at", "seen")), F.desc("seen"), "entry")
    return e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.when(F.col("pinned"), pins).otherwise(keep))


def recent(rows: DataFrame, key: str, item: str, ts: str, keep: int) -> DataFrame:
    m = rows.groupBy(key, item).agg(F.max(ts).alias("last"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("last"), item))).where(F.col("place") <= keep)


def newest_generation(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of stale producers are dropped."""
    top = rows.groupBy(key).agg(F.max(generation).alias("top"))
    return rows.join(top, key).where(F.col(generation) == F.col("top")).drop("top")

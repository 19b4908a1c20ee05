"""Ranked lookup over catalogs: actions, processes, applications and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType


def saturate(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(65535)).cast("int")


def action_score(q: Column, title: Column, aliases: Column, keywords: Column, priority: Column, target: Column | None = None, payload: Column | None = None, multiline: Column | None = None) -> Column:
    """Additive score; null if nothing of the action matches, the priority alone for an empty query.

    Of a slash command only the first word is compared. ``target``: the action opens
    addresses; ``payload``: the query holds what the action works on; ``multiline``: the
    input has several lines.
    """
    no = F.lit(False)
    low = F.lower(F.trim(q))
    word = F.when(F.startswith(low, F.lit("/")), F.get(F.split(low, r"\s+"), 0)).otherwise(low)
    t, names, keys = F.lower(title), F.lower(F.array_join(aliases, " ")), F.lower(F.array_join(keywords, " "))
    add = lambda c, n: F.when(F.coalesce(c, no), n).otherwise(0)
    hit = F.when(F.startswith(t, word), 90).when(F.contains(t, word), 55).otherwise(0)
    hit = hit + add(F.contains(names, word), 36) + add(F.contains(keys, word), 28)
    hit = hit + add(F.startswith(word, F.lit("/")) & F.array_contains(aliases, word), 42)
    hit = hit + add(F.startswith(low, F.lit("http")) & (no if target is None else target), 60) + add(no if payload is None else payload, 44)
    return F.when(low == "", priority).when(hit > 0, priority + hit + add(no if multiline is None else multiline, 10))


def process_score(q: Column, pid: Column, display: Column, process: Column, executable: Column) -> Column:
    """A leading pid; else the best of the display, process and executable names, each equal, leading, contained or a subsequence."""
    low, p = F.lower(q), pid.cast("string")

    def named(name: Column, base: int) -> Column:
        n = F.lower(name)
        return F.when(n == low, base + 260).when(F.startswith(n, low), base + 180).when(F.contains(n, low), base + 110).otherwise(base + fuzzy_score(low, name))

    best = F.greatest(named(display, 180), named(process, 160), F.when(executable != "", named(executable, 120)))
    return F.when(low != "", F.when(F.startswith(p, low), 420 - F.length(p)).otherwise(best))


def directory_priority(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/System/Applications/")), 0).when(F.startswith(path, F.lit("/Applications/")), 1).when(F.contains(path, F.lit("/Applications/")), 2).otherwise(1)


def app_score(q: Column, name: Column, aliases: Column, path: Column, priority: Column) -> Column:
    """The better of the name's and (80 more) the best alias's subsequence score, with additions for whole matches; null without either."""
    low, n = F.lower(q), F.lower(name)
    by_alias = fuzzy_best(low, F.transform(aliases, F.lower))
    base = F.greatest(fuzzy_score(low, n), by_alias + 80)
    return base + F.when(F.startswith(n, low), 220).when(F.contains(n, low), 140).otherwise(0) + F.when(F.contains(F.lower(path), low), 36).otherwise(0) + 12 * priority


def file_score(q: Column, path: Column) -> Column:
    """The better of the path's and (100 more) the file name's subsequence score; null without either."""
    return F.greatest(fuzzy_score(q, path), fuzzy_score(q, F.regexp_extract(path, r"([^/]*)$", 1)) + 100)


def fuzzy(pattern: str, text: str) -> int:
    """Subsequence score with bonuses for runs, word starts and the head; -1 without a match."""
    if not any(c.isupper() for c in pattern):
        text_m, p = text.lower(), pattern
        text = text if len(text) == len(text_m) else text_m  # some letters become two
    else:
        text_m, p = text, pattern
    score, last, at = 0, -2, 0
    for c in p:
        i = text_m.find(c, at)
        if i < 0:
            return -1
        start = i == 0 or not text[i - 1].isalnum() or (text[i].isupper() and text[i - 1].islower())
        score += 16 + (12 if i == last + 1 else -min(3, i - at)) + (8 if start else 0) + (4 if i == 0 else 0)
        last, at = i, i + 1
    return score


@F.pandas_udf(IntegerType())
def fuzzy_score(pattern: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or t is None or (s := fuzzy(p, t)) < 0 else s for p, t in zip(pattern, text, strict=True)], dtype="Int32")


@F.pandas_udf(IntegerType())
def fuzzy_best(pattern: pd.Series, texts: pd.Series) -> pd.Series:
    best = (max((fuzzy(p, t) for t in ts if t is not None), default=-1) if p is not None and ts is not None else -1 for p, ts in zip(pattern, texts, strict=True))
    return pd.Series([None if b < 0 else b for b in best], dtype="Int32")

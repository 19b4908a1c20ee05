"""Best subsequence matches without scoring every row.

A signature of a text holds a mask of its letters, its distinct neighbouring letters, the
letters that begin words and its first letter, all in lower case. They bound what a pattern can score: a
letter that is missing rules a row out, a run gains only where its two letters stand side by side,
a word's start only for letters that begin one. Rows are verified best bound first: those of the
greatest bounds, and then the rows whose bounds reach the kth score found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import fuzzy_score


def bit(c: Column) -> Column:
    return (F.ascii(c) % 63).cast("int")


def signature(text: Column) -> Column:
    """What ``bound`` asks for, made of built-in functions."""
    own = F.filter(F.split(text, ""), lambda c: c != "")
    low = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    mask = F.aggregate(F.array_distinct(F.transform(low, lambda c: bit(c))), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.pow(F.lit(2.0), b).cast("long")))
    pairs = F.array_distinct(F.transform(low, lambda c, i: F.concat(c, F.coalesce(F.get(low, i + 1), F.lit("")))))
    before = lambda i: F.coalesce(F.get(own, i - 1), F.lit(""))
    # more letters may count as starts than do, never fewer
    start = lambda c, i: (i == 0) | ~before(i).rlike(r"[\p{L}\p{Nd}]") | (c.rlike(r"\p{IsUppercase}") & before(i).rlike(r"\p{IsLowercase}"))
    starts = F.array_distinct(F.flatten(F.transform(own, lambda c, i: F.when(start(c, i), F.split(F.lower(c), "")).otherwise(F.array().cast("array<string>")))))
    plain = F.size(own) == F.size(low)  # else letters of the two do not stand at the same places
    return F.struct(mask.alias("mask"), pairs.alias("pairs"), F.when(plain, starts).alias("starts"), F.when(plain, F.get(low, 0)).alias("head"))


def bound(sign: Column, pattern: str) -> Column:
    """No text of this signature scores more for the pattern; null if none can match."""
    low = pattern.lower()
    if not low:
        return F.lit(0)
    need = reduce(lambda m, c: m | 1 << (ord(c) % 63), low, 0)
    gain = F.lit(0)
    for j, c in enumerate(low):
        begins = F.coalesce(F.array_contains(sign["starts"], c), F.lit(True))
        gain = gain + 16 + F.when(begins, 8).otherwise(0)
        if j:
            gain = gain + F.when(F.array_contains(sign["pairs"], low[j - 1] + c), 12).otherwise(-1)
        else:
            gain = gain + F.when(F.coalesce(sign["head"] == c, F.lit(True)), 4).otherwise(-1)
    return F.when(sign["mask"].bitwiseAND(F.lit(need)) == need, gain)


def signed(rows: DataFrame, texts: list[str]) -> DataFrame:
    """Rows with a signature ``sign_i`` of each text, to be stored and searched often."""
    return rows.withColumns({f"sign_{i}": signature(F.col(t)) for i, t in enumerate(texts)})


def score(pattern: str, texts: list[tuple[str, int]]) -> Column:
    own = [fuzzy_score(F.lit(pattern), F.col(t)) + more for t, more in texts]
    return own[0] if len(own) == 1 else F.greatest(*own)


def bounded(rows: DataFrame, pattern: str, texts: list[tuple[str, int]]) -> DataFrame:
    """Rows that may match, with their ``bound``: the best over the texts, each with what it adds."""
    own = [bound(F.col(f"sign_{i}"), pattern) + more for i, (_, more) in enumerate(texts)]
    return rows.withColumn("bound", own[0] if len(own) == 1 else F.greatest(*own)).where("bound is not null")


def top(rows: DataFrame, pattern: str, texts: list[tuple[str, int]], order: list[str], k: int = 20, first: int = 256) -> DataFrame:
    """The ``k`` best rows of ``signed`` rows, with their ``score``; ties by ``order``."""
    own = bounded(rows, pattern, texts)
    return own.where(F.col("bound") >= kth(own, pattern, texts, k, first)).withColumn("score", score(pattern, texts)).where("score is not null").orderBy(F.desc("score"), *order).limit(k).drop("bound", *[f"sign_{i}" for i in range(len(texts))])


def kth(own: DataFrame, pattern: str, texts: list[tuple[str, int]], k: int, first: int) -> int:
    """A score that ``k`` rows reach, from the ``first`` rows of greatest bounds; below all scores if they hold fewer matches."""
    seen = own.orderBy(F.desc("bound")).limit(max(first, k)).withColumn("score", score(pattern, texts)).where("score is not null")
    best = seen.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).first()
    return int(best["kth"]) if best["n"] == k else -(2**31)

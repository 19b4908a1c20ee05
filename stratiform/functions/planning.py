"""Terms of a query and its plan of weighted sub-queries, as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# Words that say nothing about what a query looks for.
ENGLISH_NOISE = ("a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "to", "for", "of", "in", "on", "at", "by", "with", "from", "about", "into", "show", "where", "which", "what", "when", "why", "how", "find", "locate", "look", "need", "want", "tell", "me", "documented", "explain")
CHINESE_NOISE = ("请", "帮我", "一下", "哪里", "在哪", "什么", "为什么", "怎么", "如何", "哪个", "解释", "给我", "找", "看看")
SEMANTIC, LEXICAL = 3, 4  # most sub-queries of each kind
SUB = "array<struct<text:string,weight:double>>"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words(q: Column) -> Column:
    """Distinct words of two or more characters, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(q), r"[^\p{IsAlphabetic}\p{N}_-]+"), lambda w: F.length(w) >= 2))


def terms(q: Column) -> Column:
    """Words, or the whole query if it has none."""
    w, whole = words(q), F.lower(q)
    return F.when(F.size(w) > 0, w).when(F.length(whole) >= 2, F.array(whole)).otherwise(F.array().cast("array<string>"))


def informative(ts: Column) -> Column:
    return F.filter(ts, lambda t: ~t.isin(*ENGLISH_NOISE, *CHINESE_NOISE))


def path_terms(q: Column) -> Column:
    """Marks that join path segments part words too, so these are the query's own informative words."""
    return informative(words(q))


def match_all(ts: Column, operator: str) -> Column:
    """Quoted terms under AND or OR; quotes inside are doubled."""
    return F.array_join(F.transform(ts, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), f" {operator} ")


def _sub(text: Column, weight: float) -> Column:
    return F.struct(F.trim(text).alias("text"), F.lit(weight).alias("weight"))


def _distinct(entries: Column, most: int) -> Column:
    """The first ``most`` that are neither blank nor, but for ASCII case, a repeat."""
    known = lambda acc, e: F.exists(acc, lambda k: ascii_lower(k.text) == ascii_lower(e.text))
    kept = F.aggregate(F.filter(entries, lambda e: e.text != ""), F.array().cast(SUB), lambda acc, e: F.when(known(acc, e), acc).otherwise(F.concat(acc, F.array(e).cast(SUB))))
    return F.slice(kept, 1, most)


def query_plan(q: Column) -> Column:
    """Struct of the focus query and the semantic and lexical sub-queries with their weights."""
    raw = F.trim(q)
    every = terms(raw)
    required = informative(every)
    chosen = F.when(F.size(required) > 0, required).otherwise(every)
    focus = F.when(F.size(chosen) > 0, F.array_join(chosen, " ")).otherwise(raw)
    phrase = F.when(F.lower(focus) != F.lower(raw), match_all(F.array(F.lower(focus)), "OR")).otherwise("")
    both = F.when(F.size(required) >= 2, match_all(required, "AND")).otherwise("")
    semantic = F.array(_sub(raw, 0.0), _sub(focus, 0.12), _sub(F.array_join(path_terms(raw), " "), 0.08))
    lexical = F.array(_sub(phrase, 0.25), _sub(both, 0.15), _sub(match_all(chosen, "OR"), 0.0), _sub(match_all(path_terms(raw), "OR"), 0.1))
    return F.struct(focus.alias("focus"), _distinct(semantic, SEMANTIC).alias("semantic"), _distinct(lexical, LEXICAL).alias("lexical"))


def opens(question: Column) -> Column:
    """Whether a question asks to open something."""
    q = ascii_lower(F.trim(question))
    starts = [F.startswith(q, F.lit(x)) for x in ("open ", "launch ", "/open ")]
    holds = [F.contains(q, F.lit(x)) for x in (" open ", " launch ", "打开", "开启")]
    out = F.lit(False)
    for c in starts + holds:
        out = out | c
    return out

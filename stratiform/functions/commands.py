"""Commands, versions, paths and short summaries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .planning import ascii_lower


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def command_payload(text: Column, aliases: list[str]) -> Column:
    """What follows a command: a whole alias and white space first, else the longest beginning
    (two characters or more, any case) of an alias that leaves something. Null without either."""
    t = F.regexp_replace(text, r"^\s+", "")
    rest = lambda n: strip(F.substr(t, F.lit(n + 1)))
    cases = [(F.startswith(t, F.lit(a)) & F.substr(t, F.lit(len(a) + 1), F.lit(1)).rlike(r"^(\s|$)"), F.nullif(rest(len(a)), F.lit(""))) for a in aliases]
    cases += [((ascii_lower(F.substr(t, F.lit(1), F.lit(n))) == a[:n].lower()) & (rest(n) != ""), rest(n)) for a in aliases for n in range(len(a), 1, -1)]
    out = F.when(*cases[0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out


SLASH = re.compile(r"\s*(/\S*)\s*", re.S)


def slash(text: str, aliases: list[str]) -> tuple[str, str, str] | None:
    """(alias, command as typed, payload) of a text that begins with a slash command, or None.

    An alias fits if it or the typed command begins with the other. Failing that, a typed
    command may run into its payload after two or more characters of an alias.
    """
    m = SLASH.match(text)
    if not m:
        return None
    typed, rest = m[1].lower(), text[m.end() :].strip()
    spaced = m.end(1) < len(text)
    for alias in aliases:
        a = alias.lower()
        if a.startswith(typed) or typed.startswith(a):
            if spaced or not typed.startswith(a):
                return alias, typed, rest
            return alias, a, m[1][len(a) :].strip()
    whole = text.lstrip()
    for alias in aliases:
        for n in range(min(len(typed) - 1, len(alias)), 1, -1):
            if typed.startswith(alias[:n].lower()) and (payload := whole[n:].strip()):
                return alias, alias[:n].lower(), payload
    return None


def slash_parser(aliases: list[str]):
    @F.pandas_udf("struct<alias:string,command:string,payload:string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        got = [(slash(x, aliases) if x is not None else None) or (None, None, None) for x in texts]
        return pd.DataFrame(got, columns=["alias", "command", "payload"], dtype=object)

    return parse


def preview(text: str | None, segments: int = 2, most: int = 140) -> str | None:
    """The first lines outside fences and headings, without list marks, cut to ``most`` characters."""
    found, fenced, size = [], False, 0
    for line in map(str.strip, (text or "").splitlines()):
        if line.startswith("```"):
            fenced = not fenced
        elif line and not fenced and not line.startswith("#"):
            bare = re.sub(r"^[#>`*+|-]*\s*", "", line)
            if clean := " ".join(re.sub(r"^[0-9]+[.)] ", "", bare).split()):
                found.append(clean)
                size += len(clean) + (len(found) > 1)
                if len(found) == segments or size >= most:
                    break
    out = " ".join(found)
    return out[: most - 3].rstrip() + "..." if len(out) > most else out or None


@F.pandas_udf(StringType())
def preview_summary(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: preview(x), na_action="ignore")


VERSION = r"^\s*v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"


def version_key(v: Column) -> Column:
    """Orders versions as plain values: releases after their previews, numbers before names. Null if it is none."""
    part = lambda i: F.regexp_extract(v, VERSION, i)
    number = lambda x: x.rlike(r"^\d+$")
    names = F.transform(F.filter(F.split(part(4), r"\."), lambda x: x != ""), lambda x: F.struct(F.when(number(x), 0).otherwise(1).alias("named"), F.when(number(x), x.cast("decimal(38,0)")).otherwise(0).alias("n"), F.when(number(x), "").otherwise(x).alias("s")))
    return F.when(v.rlike(VERSION), F.struct(*[part(i).cast("long").alias(f"v{i}") for i in (1, 2, 3)], (part(4) == "").cast("int").alias("release"), names.alias("names")))


def compare_versions(a: Column, b: Column) -> Column:
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def normal_path(path: Column) -> Column:
    """Without ``.`` and with ``..`` resolved by the text alone; what climbs above a relative start stays."""
    root = F.when(F.startswith(path, F.lit("/")), "/").otherwise("")
    none = F.array().cast("array<string>")
    top = lambda acc: F.element_at(acc, -1)
    climbs = lambda acc: (F.size(acc) == 0) | (F.when(F.size(acc) > 0, top(acc)) == "..")
    push = lambda acc, s: F.concat(acc, F.array(s))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s != "..", push(acc, s)).when(climbs(acc), push(acc, s)).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    out = F.concat(root, F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))
    return F.when(out == "", ".").otherwise(out)


def breadcrumbs(path: Column) -> Column:
    """Every folder on the way to a path, from the top, and the path itself."""
    s = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(s, lambda x, i: F.concat(F.lit("/"), F.array_join(F.slice(s, F.lit(1), i + 1), "/")))


def source_root(path: Column, roots: list[str]) -> Column:
    """The deepest of the configured roots that holds the path."""
    deep = sorted(roots, key=lambda r: (-r.count("/"), r))
    return F.coalesce(*[F.when((path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/")), r) for r in deep])


def segments(text: Column) -> Column:
    """Lines without white space at their end, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def cache_state(age_ms: Column, ttl_ms: int, grace_ms: int = 0) -> Column:
    """fresh, stale (served while it is made anew) or expired."""
    return F.when(age_ms <= ttl_ms, "fresh").when(age_ms <= ttl_ms + grace_ms, "stale").otherwise("expired")


def may_notify(enabled: Column, trigger: Column, only_background: Column, foreground: Column, permission: Column) -> Column:
    return enabled & trigger & ~(only_background & foreground) & (permission == "granted")


def capabilities(kind: Column, configured: Column, multimodal: Column, stateful: Column) -> Column:
    """What a model of a kind (responses, chat or embedding) can do."""
    responses, embedding = kind == "responses", kind == "embedding"
    return F.struct(
        ((responses | (kind == "chat")) & configured).alias("ai_task"),
        (responses & configured & multimodal).alias("ocr"),
        (embedding & configured).alias("embedding"),
        (embedding & configured & multimodal).alias("multimodal_embedding"),
        (responses & multimodal).alias("multimodal"),
        (responses & stateful).alias("stateful"),
    )


def progress_label(search: Column, read: Column, opened: Column) -> Column:
    """What a round of tool calls does, from its counts by tool."""
    s, r, o = search > 0, read > 0, opened > 0
    return F.when(s & r, "searching and reading").when(s & o, "searching and opening").when(s, "searching").when(r & o, "reading and opening").when(r, "reading").when(o, "opening").otherwise("running tools")

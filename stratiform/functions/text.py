"""Text transforms as Column expressions; nothing here leaves the JVM but the marked UDFs."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .bodies import error_of


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def snippet(c: Column, most: int = 240) -> Column:
    s = collapse(c)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def body_preview(c: Column, most: int = 240) -> Column:
    """The length test counts bytes, the cut characters."""
    s = F.trim(c)
    return F.when(F.octet_length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def trim_lines(c: Column) -> Column:
    return F.trim(F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), "\n"))


def sort_lines(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "\n")), "\n")


def unique_lines(c: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(c, "\n")), "\n")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")


def full_lines(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")).cast("long")


def title_case(c: Column) -> Column:
    """A word starts at any letter or digit after one that is neither."""
    parts = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def snake_case(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", ""))


def camel_case(c: Column) -> Column:
    words = F.filter(F.split(snake_case(c), "_"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), "")


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def parent(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)[/\\][^/\\]*$", 1)


def display_path(c: Column, home: str) -> Column:
    return F.when(c == home, "~").when(F.startswith(c, F.lit(home + "/")), F.concat(F.lit("~"), F.substr(c, F.lit(len(home) + 1)))).otherwise(c)


def base64_auto(c: Column) -> Column:
    """Decode what is valid Base64 of valid UTF-8, else encode."""
    s = F.regexp_replace(F.translate(F.trim(c), "-_", "+/"), r"\s+", "")
    shape = s.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(F.regexp_replace(s, "=", "")) % 4 != 1)
    raw = F.try_to_binary(F.rpad(F.regexp_replace(s, "=", ""), (F.ceil(F.length(F.regexp_replace(s, "=", "")) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    ok = shape & raw.isNotNull() & F.is_valid_utf8(raw.cast("string"))
    return F.when(ok, raw.cast("string")).otherwise(F.base64(F.encode(c, "UTF-8")))


def active_token(c: Column) -> Column:
    """The ``@token`` that ends a text, at its start or after white space or an opening mark."""
    return F.nullif(F.regexp_extract(c, r"(?:^|[\s(\[{'\"])(@\S*)$", 1), F.lit(""))


def wiki_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def reasoning(c: Column) -> tuple[Column, Column]:
    """(reasoning, answer) of a text with <think> parts."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)<think>(.*?)</think>"), 1)
    return strip(F.array_join(F.transform(parts, lambda x: strip(x)), "\n")), strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def ordered_text(order: str, text: str) -> Column:
    """Aggregate: the texts of a group (a page's blocks, some dozens) in order, each stripped, a line each; blank ones are left out."""
    rows = F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), strip(F.col(text)).alias("t")))), lambda x: x["t"] != "")
    return F.array_join(F.transform(rows, lambda x: x["t"]), "\n")


@F.pandas_udf(StringType())
def error_message(s: pd.Series) -> pd.Series:
    """The first message of an error payload (JSON text), however deeply it is nested; null if there is none."""

    def one(x):
        try:
            return error_of(json.loads(x))
        except (TypeError, ValueError):
            return None

    return s.map(one)


def location_label(p0: Column, p1: Column, l0: Column, l1: Column, chunk: Column, paragraph: Column | None = None) -> Column:
    """Where a hit stands: its pages, else its lines and the line its paragraph begins at, else its chunk. Pages and lines need both ends."""
    begins = F.lit("") if paragraph is None else F.when(paragraph.isNull(), "").otherwise(F.format_string(", paragraph %d", paragraph))
    return (
        F.when(p0.isNotNull() & p1.isNotNull(), F.when(p0 == p1, F.format_string("page %d", p0)).otherwise(F.format_string("pages %d-%d", p0, p1)))
        .when(l0.isNotNull() & l1.isNotNull(), F.concat(F.format_string("lines %d-%d", l0, l1), begins))
        .otherwise(F.format_string("chunk %d", chunk))
    )


def quoted(c: Column) -> Column:
    """A text between double quotes, with escapes for quotes, backslashes and control characters."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    for n in [*range(1, 9), 11, 12, *range(14, 32), 127]:
        c = F.replace(c, F.lit(chr(n)), F.lit("\\u{%x}" % n))
    return F.concat(F.lit('"'), c, F.lit('"'))


def image_mime(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("png", "gif", "webp", "bmp"), F.concat(F.lit("image/"), ext)).otherwise("application/octet-stream")


@F.pandas_udf(StringType())
def json_pretty(s: pd.Series) -> pd.Series:
    def one(x):
        try:
            return json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return s.map(one)


@F.pandas_udf(StringType())
def slugify(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
        return re.sub(r"-+", "-", re.sub(r"[^a-z0-9/_-]", "-", plain)).strip("-")

    return s.map(one)

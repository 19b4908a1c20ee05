"""What the search and read tools take and answer, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import json_pretty, quoted

# Limits and defaults of the tools.
MOST_LINES, MOST_HITS, HITS, MIN_SCORE = 240, 20, 8, 0.35


def line_window(text: Column, start: Column, count: Column) -> Column:
    """Struct of line_start, line_end, line_count and the numbered lines from ``start`` on; null if there are none.

    A closing line break opens no line and a carriage return before one is not text.
    """
    lines = F.transform(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"), lambda x: F.regexp_replace(x, "\r\\z", ""))
    first = F.greatest(start, F.lit(1)).cast("int")
    n = F.least(F.greatest(count, F.lit(1)), F.lit(MOST_LINES)).cast("int")
    own = F.when(text != "", F.slice(lines, first, n))
    last = (first + F.size(own) - 1).cast("int")
    numbered = F.array_join(F.transform(own, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")
    return F.when(F.size(own) > 0, F.struct(first.alias("line_start"), last.alias("line_end"), F.size(own).alias("line_count"), numbered.alias("lines")))


def search_arguments(raw: Column) -> Column:
    """Struct of error, or query, top_k and min_score, of a tool call's JSON arguments."""
    v = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    keys = F.json_object_keys(raw)
    odd = F.get(F.filter(keys, lambda k: ~k.isin("query", "topK", "minScore")), 0)
    query = F.when(kind("$.query") == "STRING", F.trim(F.try_variant_get(v, "$.query", "string")))
    k, score = F.try_variant_get(v, "$.topK", "bigint"), F.try_variant_get(v, "$.minScore", "double")
    number = lambda path: (kind(path) == "BIGINT") | (kind(path) == "DOUBLE") | kind(path).startswith("DECIMAL")
    has = lambda key: F.array_contains(keys, key)
    error = reduce(
        lambda w, c: w.when(*c),
        [
            (F.schema_of_variant(v).isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit("tool arguments must be a JSON object")),
            (odd.isNotNull(), F.concat(F.lit("unknown tool argument: "), odd)),
            (F.coalesce(query, F.lit("")) == "", F.lit("query must be a non-empty string")),
            (has("topK") & ~((kind("$.topK") == "BIGINT") & (k >= 0)), F.lit("topK must be an integer")),
            (has("topK") & ~k.between(1, MOST_HITS), F.lit(f"topK must be between 1 and {MOST_HITS}")),
            (has("minScore") & ~number("$.minScore"), F.lit("minScore must be a number")),
            (has("minScore") & ~score.between(0, 1), F.lit("minScore must be between 0 and 1")),
        ],
        F.when(raw.isNull(), F.lit("tool arguments are required")),
    )
    ok = error.isNull()
    return F.struct(error.alias("error"), F.when(ok, query).alias("query"), F.when(ok, F.coalesce(k, F.lit(HITS))).cast("int").alias("top_k"), F.when(ok, F.coalesce(score, F.lit(MIN_SCORE))).alias("min_score"))


# Arguments of the tools, by kind, with their least and greatest values, and which may be left out.
ARGUMENTS = {
    "read_lines": {"path": ("string",), "line_start": ("integer", 1), "line_count": ("integer", 1, MOST_LINES)},
    "read_excerpt": {"path": ("string",), "chunk_index": ("integer", 0)},
    "search": {"query": ("string",), "topK": ("integer", 1, MOST_HITS), "minScore": ("number", 0, 1)},
    "open": {"target": ("string",)},
}
OPTIONAL = ("topK", "minScore")


def schema(tool: str) -> dict:
    """The JSON schema of a tool's arguments."""
    own = {n: dict(zip(("type", "minimum", "maximum"), spec, strict=False)) for n, spec in ARGUMENTS[tool].items()}
    return {"type": "object", "additionalProperties": False, "properties": own, "required": [n for n in own if n not in OPTIONAL]}


def call_error(tool: str, raw: Column) -> Column:
    """Why a call's arguments (JSON text) break the tool's schema: the first reason in the order of its arguments, or null."""
    rules, v = schema(tool), F.try_parse_json(raw)
    own, keys = rules["properties"], F.json_object_keys(raw)
    shape = F.schema_of_variant(v)
    odd = F.get(F.filter(keys, lambda k: ~k.isin(*own)), 0)
    error = F.when(raw.isNull(), "tool arguments are required").when(shape.isNull() | ~shape.startswith("OBJECT"), "tool arguments must be a JSON object").when(odd.isNotNull(), F.concat(F.lit("unknown tool argument: "), odd))
    for name, rule in own.items():
        has, kind = F.array_contains(keys, name), F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        if name in rules["required"]:
            error = error.when(~has, f"{name} is required")
        if rule["type"] == "string":
            ok = (kind == "STRING") & (F.trim(F.try_variant_get(v, f"$.{name}", "string")) != "")
            error = error.when(has & ~F.coalesce(ok, F.lit(False)), f"{name} must be a non-empty string")
            continue
        whole = kind == "BIGINT"
        number = whole if rule["type"] == "integer" else whole | (kind == "DOUBLE") | kind.startswith("DECIMAL")
        error = error.when(has & ~F.coalesce(number, F.lit(False)), f"{name} must be {'an integer' if rule['type'] == 'integer' else 'a number'}")
        x = F.try_variant_get(v, f"$.{name}", "double")
        error = error.when(has & (x < rule["minimum"]), f"{name} must be at least {rule['minimum']}")
        if "maximum" in rule:
            error = error.when(has & (x > rule["maximum"]), f"{name} must be at most {rule['maximum']}")
    return error


def hit_text(number: Column, path: Column, chunk: Column, location: Column, score: Column, distance: Column, text: Column) -> Column:
    return F.concat(F.format_string("\n[%d] %s (chunk %d, %s, score %.4f, distance %.4f)\n", number, path, chunk, location, score, distance), text, F.lit("\n"))


def search_summary(query: Column, hits: Column, pending: Column) -> Column:
    """The answer of a search: how many hits, a word on files that wait, and the hits' texts (an array) in order."""
    head = F.concat(F.lit("Retrieved "), F.size(hits).cast("string"), F.lit(" hit(s) for query "), quoted(query), F.lit(".\n"))
    wait = F.when(pending & (F.size(hits) == 0), F.lit("The RAG index still has pending files, so empty results may be temporary.\n")).otherwise("")
    return F.regexp_replace(F.concat(head, wait, F.array_join(hits, "")), r"^\s+|\s+$", "")


def rescan_scope(root: Column, path: Column) -> Column:
    """The folder to read again when a file of ignore rules changes, else null."""
    inside = (path == root) | F.startswith(path, F.concat(root, F.lit("/")))
    name, parent = F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(inside & name.isin(".gitignore", ".ignore"), parent).when(path == F.concat(root, F.lit("/.git/info/exclude")), root)


def update_target(root: Column, path: Column, exists: Column, skip: Column) -> Column:
    """What a changed path asks for: struct of action (rescan or remove) and target, null for paths that are none of ours."""
    scope = rescan_scope(root, path)
    inside = (path == root) | F.startswith(path, F.concat(root, F.lit("/")))
    to = lambda action, target: F.struct(F.lit(action).alias("action"), target.alias("target"))
    return F.when(scope.isNotNull(), to("rescan", scope)).when(inside & ~skip, F.when(exists, to("rescan", path)).otherwise(to("remove", path)))


def action_completion(typed: Column, title: Column, aliases: Column) -> Column:
    """What completes a typed beginning: the first alias (or the title) of an empty one, else the alias or title that begins so."""
    low = F.lower(F.trim(typed))
    alias = F.get(F.filter(aliases, lambda a: F.startswith(F.lower(a), low)), 0)
    return F.when(low == "", F.coalesce(F.get(aliases, 0), title)).otherwise(F.coalesce(alias, F.when(F.startswith(F.lower(title), low), title)))


def file_completion(typed: Column, path: Column) -> Column:
    return F.when(F.length(typed) > 0, path)


def kill_completion(pid: Column) -> Column:
    return F.when(pid.isNotNull(), F.concat(F.lit("pid:"), pid.cast("string")))


def envelope(message: Column, content: Column, pretty: Column, failed: bool) -> Column:
    """A tool's answer as JSON text: a message, the content as readable text, and the content itself (``content`` is JSON text)."""
    quoted = lambda c: F.substr(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    text = lambda c: F.concat(F.lit('{"type":"text","text":'), quoted(c), F.lit("}"))
    return F.concat(F.lit('{"content":['), text(message), F.lit(","), text(pretty), F.lit('],"structuredContent":'), content, F.lit(f',"isError":{str(failed).lower()}}}'))


def pending_envelope(message: Column, content: Column) -> Column:
    """The answer of a tool whose work goes on: a message and the content (JSON text), also as readable text."""
    return envelope(message, content, json_pretty(content), False)


def error_envelope(message: Column) -> Column:
    content = F.to_json(F.struct(message.alias("error")))
    return envelope(message, content, F.concat(F.lit("{\n  "), F.replace(F.substr(content, F.lit(2), F.length(content) - 2), F.lit('"error":'), F.lit('"error": ')), F.lit("\n}")), True)


def warning_pages(pages: Column, most: int = 3) -> Column:
    """The first pages of a warning, and dots if there are more; nothing without pages."""
    shown = F.array_join(F.transform(F.slice(pages, 1, most), lambda p: p.cast("string")), ", ")
    return F.when(F.size(pages) > 0, F.concat(F.lit(" (pages "), shown, F.when(F.size(pages) > most, ", ...").otherwise(""), F.lit(")"))).otherwise("")


def focus_score(x: Column, y: Column, width: Column, height: Column, at_x: Column, at_y: Column) -> Column:
    """How far a block's centre is from a point, squared; ten more if the point is outside."""
    dx, dy = x + width / 2 - at_x, y + height / 2 - at_y
    inside = (at_x >= x) & (at_x <= x + width) & (at_y >= y) & (at_y <= y + height)
    return dx * dx + dy * dy + F.when(inside, 0.0).otherwise(10.0)

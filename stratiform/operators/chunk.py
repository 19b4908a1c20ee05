"""Markdown and plain-text chunkers: pure functions and their DataFrame form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .batches import map_frames

FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
ATX = re.compile(r"(#{1,6})\s*(\S.*)$")
ITEM = re.compile(r"\s*(?:[-*+] |\d+[.)] )")


def blocks(lines: list[str]) -> list[tuple[int, int, tuple]]:
    """(first line, end line, heading path) of fences, headings, list items and paragraphs."""
    out, stack, i, n = [], [], 0, len(lines)

    def setext(j):
        if j + 1 < n and lines[j].strip():
            under = lines[j + 1].strip()
            if len(under) >= 3 and set(under) in ({"="}, {"-"}):
                return 1 if under[0] == "=" else 2
        return 0

    while i < n:
        if not lines[i].strip():
            i += 1
            continue
        start = i
        if m := FENCE.match(lines[i]):
            mark = m[1]
            i += 1
            while i < n and not ((s := lines[i].strip()) and set(s) == {mark[0]} and len(s) >= len(mark)):
                i += 1
            i = min(n, i + 1)
        elif m := ATX.match(lines[i].strip()):
            stack[len(m[1]) - 1 :] = [m[2].strip()]
            i += 1
        elif level := setext(i):
            stack[level - 1 :] = [lines[i].strip()]
            i += 2
        else:
            i += 1
            while i < n and lines[i].strip() and not (FENCE.match(lines[i]) or ATX.match(lines[i].strip()) or setext(i) or ITEM.match(lines[i])):
                i += 1
        out.append((start, i, tuple(stack)))
    return out


def markdown_chunks(text: str, target: int = 350, most: int = 550, overlap: int = 80) -> list[tuple[int, int, tuple, str]]:
    """(first line, end line, heading path, text), lines from 0, end exclusive."""
    lines = text.split("\n")
    b, out, i = blocks(lines), [], 0
    size = lambda x, y: len("\n".join(lines[b[x][0] : b[y][1]]))
    while i < len(b):
        if size(i, i) > most:
            whole = "\n".join(lines[b[i][0] : b[i][1]])
            out += [(b[i][0], b[i][1], b[i][2], whole[k : k + most]) for k in range(0, len(whole), most)]
            i += 1
            continue
        j = i
        while j + 1 < len(b) and size(i, j) < target and size(j + 1, j + 1) <= most and b[j + 1][2] == b[i][2] and size(i, j + 1) <= most:
            j += 1
        out.append((b[i][0], b[j][1], b[i][2], "\n".join(lines[b[i][0] : b[j][1]])))
        nxt = j + 1
        if nxt < len(b) and b[nxt][2] == b[i][2]:
            k = nxt
            while k - 1 > i and b[k - 1][2] == b[i][2] and (k == nxt or size(k, j) < overlap):
                k -= 1
            nxt = max(i + 1, k)
        i = nxt
    return out


def plain_chunks(text: str, capacity: int = 1200, overlap: int = 200) -> list[tuple[int, str]]:
    """(start, text) of windows that end at the last blank line, line or space inside the capacity."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + capacity)
        if end < len(text):
            cut = max(text.rfind(s, at + capacity // 2, end) + len(s) for s in ("\n\n", "\n", " "))
            end = cut if cut > at + capacity // 2 else end
        if text[at:end].strip():
            out.append((at, text[at:end]))
        at = max(at + 1, end - overlap) if end < len(text) else end
    return out


def pieces(cut, docs: DataFrame, key: str, text: str, columns: list[str], schema: str) -> DataFrame:
    """Rows of ``cut(text)`` for every document; they are handed on whenever some megabytes are together, however long the texts."""

    def run(frames):
        for f in frames:
            rows, held = [], 0
            for k, x in zip(f[key], f[text], strict=True):
                for i, row in enumerate(cut(x or "")):
                    rows.append((k, i, *row))
                    held += len(row[-1])
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return map_frames(docs.select(key, text), run, schema)


def chunk_markdown(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    cut = lambda x: ((s, e, list(h), t) for s, e, h, t in markdown_chunks(x))
    return pieces(cut, docs, key, text, [key, "chunk_index", "line_start", "line_end", "heading_path", "chunk_text"], f"{key} bigint, chunk_index int, line_start int, line_end int, heading_path array<string>, chunk_text string")


def chunk_plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return pieces(plain_chunks, docs, key, text, [key, "chunk_index", "start", "chunk_text"], f"{key} bigint, chunk_index int, start int, chunk_text string")


def excerpts(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, start, chunk_text, error): the asked chunks (key, chunk_index) of documents that are cut again.

    Only the asked documents are cut; a chunk that does not exist has an error and no text.
    """
    cut = chunk_plain(docs.join(wanted.select(key).distinct(), key, "left_semi"), key, text)
    missing = F.when(F.col("chunk_text").isNull(), F.format_string("chunk index %d does not exist", "chunk_index"))
    return wanted.select(key, "chunk_index").distinct().join(cut, [key, "chunk_index"], "left").withColumn("error", missing)

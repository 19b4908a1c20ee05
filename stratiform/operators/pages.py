"""Extracted pages: repeated headers and footers, readability, blocks and chunks."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P
from .batches import map_frames

TARGET, SENTENCE, CAPACITY = 700, 280, 1200
ENDS = tuple(".!?;:。！？；：")


def without_edges(pages: list[list[str]]) -> list[list[str]]:
    """Pages without first and last lines that half of them share, where there are three or more.

    Counted are the outermost lines that aren't blank; removed only lines that stand outermost.
    """
    if len(pages) < 3:
        return pages
    full = [[x for x in p if x] for p in pages]
    heads, feet = Counter(p[0] for p in full if p), Counter(p[-1] for p in full if p)
    out = []
    for p in pages:
        a = bool(p and p[0] and 2 * heads[p[0]] >= len(pages))
        p = p[a:]
        b = bool(p and p[-1] and 2 * feet[p[-1]] >= len(pages))
        out.append(p[: len(p) - b])
    return out


def page_blocks(lines: list[str]) -> list[str]:
    """Runs of lines: they end at a blank line, at the target size, or at a sentence's end past the smaller size."""
    out, held, size = [], [], 0
    for line in [*lines, ""]:
        if line:
            held.append(line)
            size += len(line)
        if held and (not line or size >= TARGET or (size >= SENTENCE and line.endswith(ENDS))):
            if text := "\n".join(held).strip():
                out.append(text)
            held, size = [], 0
    return out


def pack_blocks(blocks: list[tuple[int, str]], capacity: int = CAPACITY) -> list[tuple[int, str]]:
    """(page, text): blocks of one page joined while they fit; each counts two characters more."""
    out: list[tuple[int, list[str], int]] = []
    for page, text in blocks:
        cost = len(text) + 2
        if out and out[-1][0] == page and out[-1][2] + cost <= capacity:
            out[-1] = (page, [*out[-1][1], text], out[-1][2] + cost)
        else:
            out.append((page, [text], cost))
    return [(page, "\n\n".join(ts)) for page, ts, _ in out]


def clean_pages(docs: DataFrame, key: str = "doc_id", pages: str = "pages") -> DataFrame:
    """(key, page, lines) of documents with ``pages``, an array of arrays of lines: white space collapsed, repeated headers and footers gone."""

    def clean(frames):
        for f in frames:
            rows = [(k, i + 1, p) for k, ps in zip(f[key], f[pages], strict=True) if ps is not None for i, p in enumerate(without_edges([[" ".join(x.split()) for x in q] for q in ps]))]
            yield pd.DataFrame(rows, columns=[key, "page", "lines"])

    return map_frames(docs.select(key, pages), clean, f"{key} {docs.schema[key].dataType.simpleString()}, page int, lines array<string>")


def page_chunks(docs: DataFrame, key: str = "doc_id", pages: str = "pages") -> DataFrame:
    """(key, page, chunk, text) of documents with ``pages``, an array of arrays of lines. Unreadable pages are left out."""

    def cut(frames):
        for f in frames:
            rows = [(k, int(page), i, t) for k, page, ls in zip(f[key], f["page"], f["lines"], strict=True) for i, (_, t) in enumerate(pack_blocks([(page, b) for b in page_blocks(list(ls))]))]
            yield pd.DataFrame(rows, columns=[key, "page", "chunk", "text"])

    kind = docs.schema[key].dataType.simpleString()
    kept = clean_pages(docs, key, pages).where(P.readable(F.array_join("lines", "\n")))
    return map_frames(kept, cut, f"{key} {kind}, page int, chunk int, text string")

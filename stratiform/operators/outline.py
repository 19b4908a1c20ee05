"""Line structure of Markdown: offsets, where blocks begin, and the heading path of every line.

Lines are read in order, so a long text would be one task's. Here texts are cut into segments
of some thousand lines, and each segment is summed up as what it makes of every state it may be entered in: in
or outside a paragraph, behind a heading's underline, inside a fence, below some headings.
The sums of a text, a few numbers a segment, are chained in order; then every segment is read once more
with the state it is entered in. Both readings are spread over tasks.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..streaming.stateful import fold_sorted
from .batches import map_frames
from .chunk import ATX, FENCE, ITEM

#: State between lines: normal (also inside a paragraph, which only the next line's start depends on), behind a heading whose underline comes next, or a fence (its letter and length).
NORMAL, PARAGRAPH, UNDERLINE = "n", "p", "u"
LEVELS = 6
#: Rows handed on together; segments are far smaller where lines are few.
ROWS = 20_000


def underlined(line: str, following: str | None) -> int:
    """The level of a heading whose underline follows, else 0."""
    under = (following or "").strip()
    return (1 if under[0] == "=" else 2) if line.strip() and len(under) >= 3 and set(under) in ({"="}, {"-"}) else 0


def closes(line: str, state: str) -> bool:
    s = line.strip()
    return bool(s) and set(s) == {state[0]} and len(s) >= int(state[1:])


def read(lines: list[str], state: str, following: str | None):
    """(state after it, begins a block, belongs to one, (level, heading) or None) of each line; ``following`` is the line after the last."""
    for i, line in enumerate(lines):
        after, begins, inside, heading = NORMAL, False, True, None
        nxt = lines[i + 1] if i + 1 < len(lines) else following
        if state[0] in "`~":
            after = NORMAL if closes(line, state) else state
        elif state == UNDERLINE:
            pass
        elif not line.strip():
            inside = False
        elif m := FENCE.match(line):
            after, begins = f"{m[1][0]}{len(m[1])}", True
        elif m := ATX.match(line.strip()):
            begins, heading = True, (len(m[1]), m[2].strip())
        elif level := underlined(line, nxt):
            after, begins, heading = UNDERLINE, True, (level, line.strip())
        else:
            after, begins = PARAGRAPH, state != PARAGRAPH or bool(ITEM.match(line))
        yield after, begins, inside, heading
        state = after


def put(stack: list, heading: tuple) -> list:
    return [*stack[: heading[0] - 1], heading[1]]


def effect(lines: list[str], at: int, state: str, following: str | None) -> list:
    """[state at the end, for each depth of headings at the entry: how many of them stay and what stands below them]."""
    stacks = [list(range(n)) for n in range(LEVELS + 1)]
    for state, _, _, heading in read(lines[at:], state, following):  # noqa: B020
        if heading:
            stacks = [put(s, (heading[0], [heading[1]])) for s in stacks]
    return [state, [[sum(isinstance(x, int) for x in s), [x[0] for x in s if not isinstance(x, int)]] for s in stacks]]


def summary(lines: list[str], following: str | None) -> str:
    """What a segment makes of each state, as JSON. A fence is left at the first line that closes it, so only lines longer than all such before matter."""
    own = {NORMAL: effect(lines, 0, NORMAL, following), UNDERLINE: effect(lines, 1, NORMAL, following)}
    ends: dict[str, list] = {"`": [], "~": []}
    for i, line in enumerate(lines):
        s = line.strip()
        if s[:1] in ends and set(s) == {s[0]} and len(s) >= 3 and len(s) > max((n for n, _ in ends[s[0]]), default=0):
            ends[s[0]].append((len(s), effect(lines, i + 1, NORMAL, following)))
    return json.dumps([own, ends])


def chain(state: str, stack: list[str], sums: str) -> tuple[str, list[str]]:
    """State and headings behind a segment."""
    own, ends = json.loads(sums)
    if state[0] in "`~":
        found = next((e for n, e in ends[state[0]] if n >= int(state[1:])), None)
        if found is None:
            return state, stack
    else:
        found = own[UNDERLINE if state == UNDERLINE else NORMAL]
    after, by_depth = found
    stay, below = by_depth[len(stack)]
    return after, [*stack[:stay], *below]


class Chain:
    def __init__(self):
        self.state, self.stack = NORMAL, []

    def add(self, r):
        out = [(r["id"], r["segment"], self.state, self.stack)]
        self.state, self.stack = chain(self.state, self.stack, r["sums"])
        return out

    def end(self):
        return []


def line_outline(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_lines: int = 4096) -> DataFrame:
    """(key, line_no, start, n_chars, begins, inside, heading_path): every line of every text with its offset in characters.

    ``begins``: a block (fence, heading, list item, paragraph) begins there; ``inside``: the line belongs to
    one. The heading path of a heading's line holds the heading. Keys must be unique; null
    texts have no lines, empty ones have one; an empty table gives no rows; other columns are not read.
    """
    n = segment_lines
    ls = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.split(text, "\n").alias("ls"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / n).cast("int")), lambda s: F.struct(s.alias("segment"), F.slice("ls", s * n + 1, F.lit(n)).alias("lines"), F.get("ls", (s + 1) * n).alias("following")))
    # a text's segments leave the task that has split it
    segments = ls.select("id", F.explode(cut).alias("x")).select("id", "x.*").repartition("id", "segment")

    def sum_up(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "segment": f["segment"], "sums": [summary(list(x), y) for x, y in zip(f["lines"], f["following"], strict=True)], "chars": [sum(len(s) + 1 for s in x) for x in f["lines"]]})

    sums = map_frames(segments, sum_up, "id bigint, segment int, sums string, chars bigint")
    entered = fold_sorted(sums, ["id"], ["segment"], lambda: Offsets(Chain()), "id bigint, segment int, state string, stack array<string>, start bigint")

    def line_rows(frames):
        columns = ["id", "line_no", "start", "n_chars", "begins", "inside", "heading_path"]
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                stack, at = list(r["stack"]), int(r["start"])
                for i, (line, (_, begins, inside, heading)) in enumerate(zip(r["lines"], read(list(r["lines"]), r["state"], r["following"]), strict=True)):
                    stack = put(stack, heading) if heading else stack
                    rows.append((r["id"], int(r["segment"]) * n + i, at, len(line), begins, inside, stack))
                    at += len(line) + 1
                if len(rows) > ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    rows = map_frames(segments.join(entered, ["id", "segment"]), line_rows, "id bigint, line_no bigint, start bigint, n_chars int, begins boolean, inside boolean, heading_path array<string>")
    return rows.withColumnRenamed("id", key)


class Offsets:
    """A fold whose rows also get where each segment begins."""

    def __init__(self, inner: Chain):
        self.inner, self.at = inner, 0

    def add(self, r):
        out = [(*x, self.at) for x in self.inner.add(r)]
        self.at += r["chars"]
        return out

    def end(self):
        return []

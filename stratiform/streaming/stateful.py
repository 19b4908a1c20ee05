"""Operators that walk through each key's rows in order."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import bodies


def fold_sorted(rows: DataFrame, key: list[str], order: list[str], make: Callable, schema: str) -> DataFrame:
    """Each key's rows, in order, through an object of ``make()``: ``add(row)`` and ``end()`` give result rows as tuples.

    Rows stream through sorted partitions, so a key's rows need not fit in memory; what the object holds must.
    A key's rows stay in one task, as their order demands; keys are spread.
    """
    kind = StructType.fromDDL(schema)

    def run(batches):
        arrow = to_arrow_schema(kind)
        now, state, out = None, None, []

        def table(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            for r in b.to_pylist():
                k = tuple(r[c] for c in key)
                if state is None or k != now:
                    if state is not None:
                        out += state.end()
                    now, state = k, make()
                out += state.add(r)
            if out:
                yield table(out)
                out = []
        if state is not None and (out := state.end()):
            yield table(out)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def deadline_batches(events: DataFrame, key: str, ts: str, tie: str, wait_ms: int) -> DataFrame:
    """Batches that close a fixed time after their first event, whatever comes in between. ``ts`` in milliseconds."""

    class Batch:
        def __init__(self):
            self.n, self.first, self.last = 0, 0, 0

        def add(self, r):
            out = self.end() if self.n and r[ts] - self.first >= wait_ms else []
            if not self.n:
                self.k, self.first = r[key], r[ts]
            self.n, self.last = self.n + 1, r[ts]
            return out

        def end(self):
            out = [(self.k, self.n, self.first, self.last)] if self.n else []
            self.n = 0
            return out

    kind = events.schema[key].dataType.simpleString()
    return fold_sorted(events.where(F.col(ts).isNotNull()), [key], [ts, tie], Batch, f"{key} {kind}, n_events long, first_ms long, last_ms long")


def deadline_stream(events: DataFrame, key: str, ts: str, delay: str, wait_ms: int) -> DataFrame:
    """The same on a stream, by event time: a batch also closes when the watermark passes its deadline."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, frames, state: GroupState):
        n, first, last = state.get if state.exists else (0, 0, 0)
        out = []
        if state.hasTimedOut:
            out, n = [(k[0], n, first, last)], 0
            state.remove()
        else:
            for t in sorted(int(x.timestamp() * 1000 + 0.5) for f in frames for x in f[ts]):
                if n and t - first >= wait_ms:
                    out.append((k[0], n, first, last))
                    n = 0
                n, first, last = n + 1, first if n else t, max(last, t) if n else t
            state.update((n, first, last))
            state.setTimeoutTimestamp(max(first + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "n_events", "first_ms", "last_ms"])

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n_events long, first_ms long, last_ms long", "n long, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def fold_stream(rows: DataFrame, key: list[str], order: list[str], ts: str, delay: str, make: Callable, schema: str) -> DataFrame:
    """``fold_sorted`` on a stream: rows wait until the watermark has passed their time, so that each key's come in order.

    The state of a key is its fold and the rows that wait. What a fold gives at its end
    stays in the state, as a stream has none.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [f.name for f in StructType.fromDDL(schema)]
    plain = lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x

    def step(k, frames, state: GroupState):
        fold, held = map(pickle.loads, state.get) if state.exists else (make(), [])
        if not state.hasTimedOut:
            held += [{c: plain(v) for c, v in r.items()} for f in frames for r in f.to_dict("records")]
        passed = state.getCurrentWatermarkMs()
        at = lambda r: r[ts].timestamp() * 1000
        ready = sorted((r for r in held if at(r) <= passed), key=lambda r: tuple((r[c] is not None, r[c]) for c in order))
        held = [r for r in held if at(r) > passed]
        out = [x for r in ready for x in fold.add(r)]
        state.update((pickle.dumps(fold), pickle.dumps(held)))
        if held:
            state.setTimeoutTimestamp(max(int(min(map(at, held))), passed) + 1)
        yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(names)})

    return rows.withWatermark(ts, delay).groupBy(*key).applyInPandasWithState(step, schema, "fold binary, held binary", "append", GroupStateTimeout.EventTimeTimeout)


class ClipboardPoll:
    """Polls (counter, text, at_ms, own): which of them record a text. A blank forgets the last text; an unchanged
    counter, or without counters an unchanged text, is skipped; the engine's own write is skipped once within its time."""

    def __init__(self, ttl_ms: int = 2000):
        self.ttl, self.counter, self.last, self.muted = ttl_ms, None, None, None

    def add(self, r):
        if r["own"]:  # the engine writes a text by itself
            self.muted = (r["text"], r["at_ms"] + self.ttl)
            return []
        if r["counter"] is not None and r["counter"] == self.counter:
            return []
        self.counter = r["counter"]
        if not (r["text"] or "").strip():
            self.last = None
            return []
        if r["counter"] is None and r["text"] == self.last:
            return []
        self.last = r["text"]
        if self.muted and r["at_ms"] > self.muted[1]:
            self.muted = None
        if self.muted and self.muted[0] == r["text"]:
            self.muted = None
            return []
        return [(r["device"], r["at_ms"], r["text"])]

    def end(self):
        return []


POLLED = "device long, at_ms long, text string"


def clipboard_polls(polls: DataFrame) -> DataFrame:
    return fold_sorted(polls, ["device"], ["at_ms", "counter"], ClipboardPoll, POLLED)


def clipboard_stream(polls: DataFrame, ts: str, delay: str) -> DataFrame:
    return fold_stream(polls, ["device"], ["at_ms", "counter"], ts, delay, ClipboardPoll, POLLED)


class Session:
    """Status of a session after each event (session_id, seq, kind, detail)."""

    def __init__(self):
        self.status, self.error = "starting", None

    def add(self, r):
        k, refused = r["kind"], False
        if self.status == "exited":
            refused = True
        elif k == "ready" and self.status == "starting":
            self.status = "idle"
        elif k == "prompt":
            refused = self.status not in ("idle", "error")
            self.status, self.error = (self.status, self.error) if refused else ("running", None)
        elif k == "finished":
            self.status, self.error = "idle", None
        elif k == "failed":
            self.status, self.error = "error", r["detail"]
        elif k == "exit":
            self.status = "exited"
        return [(r["session_id"], r["seq"], self.status, self.status == "error", self.error, refused)]

    def end(self):
        return []


STATES = "session_id long, seq long, status string, attention boolean, last_error string, refused boolean"


def session_states(events: DataFrame) -> DataFrame:
    return fold_sorted(events, ["session_id"], ["seq"], Session, STATES)


def session_stream(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return fold_stream(events, ["session_id"], ["seq"], ts, delay, Session, STATES)


class Visible:
    """Deltas of a translation (id, seq, delta): only what makes the visible text longer is passed on."""

    def __init__(self):
        self.text, self.begin, self.end_ = bodies.Growing(), 0, 0

    def add(self, r):
        if not r["delta"]:
            return []
        self.text.add(r["delta"])
        begin, end = self.text.part()
        raw, had = self.text.raw, self.end_ - self.begin
        longer = end - begin > had and (begin == self.begin or raw.startswith(raw[self.begin : self.end_], begin))
        if longer:
            self.begin, self.end_ = begin, end
            return [(r["id"], r["seq"], raw[begin + had : end])]
        if begin == end:
            self.begin = self.end_ = 0
        return []

    def end(self):
        return []


def visible_deltas(deltas: DataFrame) -> DataFrame:
    return fold_sorted(deltas, ["id"], ["seq"], Visible, "id long, seq long, delta string")


def visible_stream(deltas: DataFrame, ts: str, delay: str) -> DataFrame:
    return fold_stream(deltas, ["id"], ["seq"], ts, delay, Visible, "id long, seq long, delta string")


class Chunks:
    """Chunks (body, seq, chunk, last) of service bodies, cut anywhere: a body's answer is given with its last chunk, or at the end of its rows."""

    def __init__(self):
        self.own, self.open = bodies.Body(), False

    def add(self, r):
        self.key, self.open = r["body"], True
        self.own.feed(r["chunk"] or b"", bool(r["last"]))
        return self.answer() if r["last"] else []

    def answer(self):
        out = [(self.key, *self.own.answer.row())]
        self.own, self.open = bodies.Body(), False
        return out

    def end(self):
        if not self.open:
            return []
        self.own.feed(b"", True)
        return self.answer()


ANSWERS = "body string, content string, reasoning string, tool_calls string, finish_reason string, error string"


def chunked_answers(chunks: DataFrame) -> DataFrame:
    """One answer a body. A body's state is what of it is not whole yet and its answer so far."""
    return fold_sorted(chunks, ["body"], ["seq"], Chunks, ANSWERS)


def chunked_stream(chunks: DataFrame, ts: str, delay: str) -> DataFrame:
    return fold_stream(chunks, ["body"], ["seq"], ts, delay, Chunks, ANSWERS)


class Transcript:
    """Neighbouring turns of one role become one block, given out when the next one begins."""

    def __init__(self):
        self.block, self.role, self.texts = 0, None, []

    def add(self, r):
        if not r["text"]:
            return []
        out = []
        if not self.texts or r["role"] != self.role:
            out = self.end()
            self.block, self.role = self.block + 1, r["role"]
        self.conv = r["conv_id"]
        self.texts.append(r["text"])
        return out

    def end(self):
        out = [(self.conv, self.block, self.role, "\n".join(self.texts))] if self.texts else []
        self.texts = []
        return out


BLOCKS = "conv_id long, block int, role string, content string"


def transcript_blocks(turns: DataFrame) -> DataFrame:
    return fold_sorted(turns, ["conv_id"], ["turn", "text"], Transcript, BLOCKS)


def transcript_stream(turns: DataFrame, ts: str, delay: str) -> DataFrame:
    """Closed blocks; the one that may still grow stays in the state."""
    return fold_stream(turns, ["conv_id"], ["turn", "text"], ts, delay, Transcript, BLOCKS)


class BatchPlanner:
    """Sizes of embedding batches: by characters and items; growing after clean rounds, shrinking after splits."""

    def __init__(self, size: int = 4, most: int = 32, budget: int = 4800, streak: int = 3, rest: int = 2):
        self.size, self.most, self.budget, self.streak, self.rest = size, most, budget, streak, rest
        self.clean, self.cooling = 0, 0

    def full(self, items: int, chars: int, n: int) -> bool:
        """Whether a text of ``n`` characters no longer goes into a batch of ``items``."""
        return items > 0 and (items >= self.size or chars >= self.budget or chars + max(n, 1) > self.budget)

    def done(self, items: int, largest: int | None = None) -> None:
        """After a round of ``items``; ``largest`` is the largest size that worked, if the batch had to be split."""
        if largest is not None:
            self.size, self.clean, self.cooling = min(max(largest, 1), self.most), 0, self.rest
        elif self.cooling:
            self.cooling, self.clean = self.cooling - 1, 0
        elif items >= self.size:
            self.clean += 1
            if self.clean >= self.streak:
                self.clean, self.size = 0, min(self.most, self.size + max(1, self.size // 4))


def embedding_batches(texts: DataFrame, file: str, order: str, n_chars: str) -> DataFrame:
    """(file, order, batch): greedy batches of each file's texts where every round is clean."""

    class Plan:
        def __init__(self):
            self.p, self.batch, self.items, self.chars = BatchPlanner(), 0, 0, 0

        def add(self, r):
            if self.p.full(self.items, self.chars, r[n_chars]):
                self.p.done(self.items)
                self.batch, self.items, self.chars = self.batch + 1, 0, 0
            self.items, self.chars = self.items + 1, self.chars + max(r[n_chars], 1)
            return [(r[file], r[order], self.batch)]

        def end(self):
            return []

    kinds = [texts.schema[c].dataType.simpleString() for c in (file, order)]
    return fold_sorted(texts, [file], [order], Plan, f"{file} {kinds[0]}, {order} {kinds[1]}, batch long")

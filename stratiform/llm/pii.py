"""Personal data: exact base patterns, widened by a skip-chain conditional random field.

The field's nodes are the base spans, runs of digits with separators, and other words
that hold a digit, an at sign or a plus. A node's potential comes from its shape, a chain
potential joins neighbours, and skip potentials join equal or similar nodes, however far
apart: each set of alike nodes shares one group node, so that any two of them are two
links apart. Potentials are estimated by expectation maximisation over all documents:
base spans are known, all other nodes are unlabelled, and loopy message passing gives
their expected labels. The same message passing then makes labels agree in each
document: base spans are fixed, others become spans if their posterior is high.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Store, pieces, session

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
RUN = re.compile(r"\+?\(?[0-9](?:[ ()./_:-]{0,2}[0-9])*+")
ANY = re.compile(r"[0-9@+]")
EDGE = " .,;:!?()[]{}<>\"'#*|"


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind. Linear in the text's length."""
    out, end, seen, at = [], 0, 0, text.find("@")
    while at >= 0:
        # the local part is the run of its characters before the sign, not before the last match or sign
        begin = at
        low = max(end, seen)
        if begin > low:
            tail = text[low:at]
            k = len(tail)
            while k and (tail[k - 1].isascii() and (tail[k - 1].isalnum() or tail[k - 1] in "._%+-")):
                k -= 1
            begin = low + k
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            end = m.end()
        seen = at + 1
        at = text.find("@", max(seen, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if len(m[0]) <= 37 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def bucket(n: int) -> int:
    return sum(n >= b for b in (1, 4, 9, 12, 20))


def shape(core: str) -> int:
    """A node's shape as a number; there are a few hundred."""
    d = digits_of(core)
    n = len(d)
    dots = min(core.count("."), 4)
    letters = any(c.isalpha() for c in core)
    check = 0 if not 12 <= n <= 19 else 1 + luhn(d)
    out = 0
    for v, most in ((bucket(n), 6), ("@" in core, 2), (dots, 5), (core[:1] == "+", 2), (letters, 2), ("-" in core, 2), (check, 3)):
        out = out * most + int(v)
    return out


def nodes(text: str, base):
    """(start, end, core, base label or 0): the base spans, runs of nine or more digits, and other words with a digit, at sign or plus.

    Nothing overlaps a base span, and what is glued to one is left out. Linear in the
    text's length.
    """
    out, end = [], 0
    for s, k, e in base:
        if s >= end:  # spans of different kinds may overlap; the first one stands for both
            out.append((s, e, text[s:e], k + 1))
        end = max(end, e)
    free, at = [], 0
    for s, e in sorted((s, e) for s, _, e in base) + [(len(text), len(text))]:
        if s > at:
            free.append((at, s))
        at = max(at, e)
    for low, high in free:

        def glued(s, e, low=low, high=high):
            return s == low > 0 or e == high < len(text)

        runs = []
        for m in RUN.finditer(text, low, high):
            s, e = m.span()
            around = text[max(0, s - 1) : s] + text[e : e + 1]
            if len(digits_of(m[0])) >= 9 and not glued(s, e) and not any(c.isalnum() or c == "@" for c in around):
                runs.append((s, e))
                out.append((s, e, m[0], 0))
        starts = [s for s, _ in runs]
        for m in WORD.finditer(text, low, high):
            raw = m[0]
            if not ANY.search(raw) or glued(*m.span()):
                continue
            s = m.start() + len(raw) - len(raw.lstrip(EDGE))
            e = m.end() - len(raw) + len(raw.rstrip(EDGE))
            i = bisect_left(starts, e)
            if s < e and not (i and runs[i - 1][1] > s):
                out.append((s, e, text[s:e], 0))
    return sorted(out)


def same(core: str) -> list[str]:
    """Keys of equal nodes: their text, or their digits if there are many."""
    d = digits_of(core)
    return [core.lower(), "#" + d] if len(d) >= 7 else [core.lower()]


def similar(core: str) -> list[str]:
    """Keys of similar nodes: the last nine digits, digits but for one, and the part before an at sign."""
    d = digits_of(core)
    out = ["~" + d[-9:]] if len(d) >= 9 else []
    if 9 <= len(d) <= 19:
        out += [d[:i] + "?" + d[i + 1 :] for i in range(len(d))]
    local, sign, _ = core.partition("@")
    if sign and len(local) >= 3:
        out.append("@" + local.lower())
    return out


CHAIN, SAME, SIMILAR = 1, 2, 3


def graph(found) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """(members of each group, edges): edges (type, i, j) join neighbours, and members with their group, which is node len(found) + its number."""
    edges = [(CHAIN, i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 3]
    groups, known = [], set()
    for what, keys in ((SAME, same), (SIMILAR, similar)):
        by: dict[str, list[int]] = {}
        for i, (_, _, core, _) in enumerate(found):
            for k in keys(core):
                by.setdefault(k, []).append(i)
        for own in by.values():
            if len(own) > 1 and tuple(own) not in known:  # the same members need no second group
                known.add(tuple(own))
                edges += [(what, i, len(found) + len(groups)) for i in own]
                groups.append(own)
    return groups, edges


ONE = 1 << 16  # expected counts are whole multiples of 1 / ONE, so that sums don't depend on their order


def statistics(texts, field=None):
    """Expected counts, in units of 1 / ONE: (0, shape, label), and (type, label, label) on edges.

    Without a field, unlabelled nodes begin as what a base span of their group says: an
    equal one, or similar ones that are half of their group; with one, as their posteriors.
    """
    from collections import Counter

    n: Counter = Counter()
    labels = len(LABELS)
    for t in texts:
        if not t or not ANY.search(t):
            continue
        found = nodes(t, base_spans(t))
        if not found:
            continue
        groups, edges = graph(found)
        if field is None:
            y = [x[3] for x in found]
            equal = len({j for what, _, j in edges if what == SAME})
            for g, own in enumerate(groups):
                known = [found[i][3] for i in own if found[i][3]]
                if known and (g < equal or 2 * len(known) >= len(own)):
                    for i in own:
                        y[i] = y[i] or max(known)
            y += [max(y[i] for i in own) for own in groups]
            p = np.eye(labels)[y]
        else:
            p = field.marginals(found, groups, edges)
        for (_, _, core, _), q in zip(found, p, strict=False):
            s = shape(core)
            for k in np.flatnonzero(q > 1e-4):
                n[0, s, int(k)] += int(q[k] * ONE)
        if edges:
            e = np.array(edges)
            for what in (CHAIN, SAME, SIMILAR):
                own = e[e[:, 0] == what]
                if len(own):
                    both = p[own[:, 1]].T @ p[own[:, 2]]
                    for a, b in zip(*np.nonzero(both > 1e-4), strict=True):
                        n[what, int(a), int(b)] += int(both[a, b] * ONE)
    return n


class Field:
    """Log potentials from counts.

    An edge has the mean of both logarithms of one label's share given the other: labels
    that agree cost next to nothing, however rare they are, and those that differ cost
    the more the rarer that is.
    """

    def __init__(self, counts: dict[tuple[int, int, int], float], smooth: float = 0.5):
        k = len(LABELS)
        self.shapes, pair = {}, np.tile(smooth * np.eye(k), (3, 1, 1))
        for (what, x, y), n in counts.items():
            if what == 0:
                self.shapes.setdefault(x, np.full(k, smooth / k))[y] += n
            else:
                pair[what - 1, x, y] += n
                pair[what - 1, y, x] += n
        self.shapes = {s: np.log(v / v.sum()) for s, v in self.shapes.items()}
        given = pair + smooth / k
        self.pair = np.clip(0.5 * (np.log(given / given.sum(1, keepdims=True)) + np.log(given / given.sum(2, keepdims=True))), -8, 0)
        self.unseen = np.log(np.array([0.9] + [0.1 / (k - 1)] * (k - 1)))

    def marginals(self, found, groups=None, edges=None, rounds: int = 200) -> np.ndarray:
        """Posterior labels of the nodes, then of the groups, by loopy belief propagation.

        It ends when no message changes any more. Alike nodes are two links apart, so that
        this does not depend on the document's length; ``rounds`` only ends messages that
        circle for ever.
        """
        if groups is None:
            groups, edges = graph(found)
        own = np.zeros((len(found) + len(groups), len(LABELS)))
        for i, (_, _, core, y) in enumerate(found):
            if y:
                own[i] = -30.0
                own[i, y] = 0.0
            else:
                own[i] = self.shapes.get(shape(core), self.unseen)
        if not edges:
            return _normal(own)
        what, i, j = np.array(edges, np.int64).T
        pot = self.pair[what - 1]
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        msg = np.zeros((len(src), own.shape[1]))
        for _ in range(rounds):
            belief = _gather(own, dst, msg)
            new = _lse((belief[src] - msg[back])[:, :, None] + pot, 1)
            new -= _lse(new, 1)[:, None]
            if np.abs(new - msg).max() < 1e-4:
                msg = new
                break
            msg = 0.5 * msg + 0.5 * new
        return _normal(_gather(own, dst, msg))


def _gather(own, dst, msg):
    return own + np.stack([np.bincount(dst, m, len(own)) for m in msg.T], 1)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _normal(x):
    return np.exp(x - _lse(x, 1)[:, None])


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(text: str, field: Field, least: float = 0.9):
    """(base spans, all spans) of one text."""
    if not text or not ANY.search(text):
        return [], []
    base = base_spans(text)
    found = nodes(text, base)
    if all(y for _, _, _, y in found):
        return base, base
    p = field.marginals(found)
    more = [(s, int(q[1:].argmax()), e) for (s, e, _, y), q in zip(found, p, strict=False) if not y and q[1:].max() >= least]
    return base, sorted(base + more)


def train(docs: DataFrame, store: Store, rounds: int = 2) -> Field:
    """A first count over all documents, then ``rounds`` of expectation maximisation over all of them.

    Shapes and labels are few, so the table of counts has a fixed bound.
    """
    texts, field = docs.select(F.col("text").cast("string").alias("text")), None
    for _ in range(1 + rounds):

        def run(batches, field=field):
            for b in pieces(batches):
                n = statistics(b.column(0).to_pylist(), field)
                if n:
                    cols = list(zip(*((*k, v) for k, v in n.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["what", "x", "y", "n"])

        counts = texts.mapInArrow(run, "what bigint, x bigint, y bigint, n bigint")
        counts = store.put(counts.groupBy("what", "x", "y").agg(F.sum("n").alias("n")), "field-counts")
        field = Field({(r.what, r.x, r.y): r.n / ONE for r in counts.collect()})
        store.drop(counts)
    return field


def spans(docs: DataFrame, store: Store) -> DataFrame:
    """doc_id, counts of base spans, the base spans' digest and all spans of every whole text.

    Null and empty texts have none; null ids and repeated rows stay as they are, and
    repeated rows count as often in training. A span of the field never overlaps a base
    span. Very long texts are read whole, in time that grows with their length. An empty
    table gives no rows; other columns are not read.
    """
    field = train(docs, store)

    def run(batches):
        for b in pieces(batches):
            counts, digest, every = [[] for _ in KINDS], [], []
            for t in b.column(1).to_pylist():
                base, both = find(t, field)
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(both))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(every)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; see ``spans``."""
    return spans(session(spark).read.parquet(f"{sf_dir}/documents.parquet"), Store(spark))

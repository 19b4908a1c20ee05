"""Vectors of texts from an embedder that the caller brings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..streaming.stateful import BatchPlanner

#: Takes some texts and gives one vector for each.
Embedder = Callable[[list[str]], list[list[float]]]
WORD = re.compile(r"[a-z0-9]+")


def hashing_embedder(dims: int = 16) -> Embedder:
    """Counts of ASCII words by a hash: stands in for a model where none is at hand, as in tests."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in WORD.findall(t.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % dims] += 1.0
            out.append(v)
        return out

    return embed


def embed(texts: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, embedding): texts go to ``embedder`` in batches of bounded size and length, which grow while all goes well.

    A batch that fails is halved until it works; a single text that fails raises. Null
    texts have a null vector and are not sent.
    """
    kind = texts.schema[key].dataType.simpleString()

    def vectors(batch: list[str]) -> tuple[list[list[float]], int]:
        """The vectors, and the largest size that worked."""
        try:
            got = embedder(batch)
            if len(got) != len(batch):
                raise ValueError("an embedder gives one vector for each text")
            return got, len(batch)
        except Exception:
            if len(batch) < 2:
                raise
        half = len(batch) // 2
        (a, n), (b, m) = vectors(batch[:half]), vectors(batch[half:])
        return a + b, min(n, m)

    def run(batches):
        plan = BatchPlanner()
        for b in batches:
            every, found = b.column(1).to_pylist(), [None] * b.num_rows
            now: list[int] = []

            def send(now=now, every=every, found=found):
                if not now:
                    return
                got, most = vectors([every[i] for i in now])
                plan.done(len(now), most if most < len(now) else None)
                for i, v in zip(now, got, strict=True):
                    found[i] = v
                now.clear()

            chars = 0
            for i, t in enumerate(every):
                if t is None:
                    continue
                if plan.full(len(now), chars, len(t)):
                    send()
                    chars = 0
                now.append(i)
                chars += max(len(t), 1)
            send()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], names=[key, "embedding"])

    return texts.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, embedding array<double>")

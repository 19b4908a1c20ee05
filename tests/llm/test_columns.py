"""Columnar tokenization against the tokenizer, and block-settled suffixes against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from stratiform.llm.common import Store
from stratiform.llm.packing import Ids, tokenizer_path
from stratiform.llm.substrings import cleaned, removed


def test_ids_of_a_column_are_the_tokenizers():
    rng, ids = random.Random(1), Ids(tokenizer_path(), most=50)  # a small memory, so that it turns over
    letters = list("aAbB.,!é́ \t\n\x1c\x85 ÖøßŸ×÷0-'中")
    texts = [None, "", "  ", " . , ", "Ünï, ß. ÀÉ.", "a,b.c", "foo..", "a\x1cb", "x" * 200 + "."]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)]
    column = pa.array(texts, pa.string())
    got = ids(column)
    assert got == [ids.encode(t) if t else b"" for t in texts]
    assert ids(column.slice(7, 5)) == got[7:12]
    assert ids(column.slice(0, 0)) == [] and ids(pa.array([None, ""], pa.string())) == [b"", b""]


def brute(docs, size=50):
    raw, order, first = [(t or "").encode() for _, t in docs], [2**63 - 1 if d is None else d for d, _ in docs], {}
    for d, b in zip(order, raw, strict=True):
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(first.get(b[i : i + size], d), d)
    out = []
    for (doc, _), d, b in zip(docs, order, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((doc, len(b), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_passages_of_many_documents(spark):
    """Passages, copies, repeats inside a document, null and repeated ids, in one block and in several."""
    rng = random.Random(3)
    passages = ["".join(rng.choices("abcdefgh é\0", k=rng.randint(40, 130))) for _ in range(12)]
    docs = []
    for i in range(200):
        t = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("xyz ", k=rng.randint(0, 70))) for _ in range(rng.randint(0, 6)))
        docs.append((rng.choice([i, None, 7]) if i % 9 == 0 else i, t if i % 50 else None))
    docs += docs[:30] + [(1000 + i, docs[33][1]) for i in range(50)] + [(2000, "For " * 500), (2001, "For " * 300), (2002, "For " * 20)]
    for n in (1, 5):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        assert sorted((tuple(r) for r in removed(df, Store(spark)).collect()), key=str) == brute(docs)


def test_cleaned_texts_and_spans(spark):
    """The kept bytes and the removed spans themselves; a cut inside a character keeps its other byte."""
    text = "".join(random.Random(4).choices("abcdefgh", k=80))
    docs = [(1, "é" + text), (2, "è" + text + " tail"), (3, "head " + text + "-" * 9 + text), (4, None), (None, text), (5, "new")]
    got = {r.doc_id: ([tuple(x) for x in r.spans], bytes(r.kept), r.n_removed) for r in cleaned(spark.createDataFrame(docs, "doc_id long, text string"), Store(spark)).collect()}
    assert got[1] == ([], docs[0][1].encode(), 0)
    assert got[2] == ([(2, 82)], "è tail".encode(), 80)
    assert got[3] == ([(5, 85), (94, 174)], b"head ---------", 160)
    assert got[4] == ([], b"", 0) and got[None] == ([(0, 80)], b"", 80) and got[5] == ([], b"new", 0)

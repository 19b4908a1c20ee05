"""Word-piece counts by a longest-match automaton.

The vocabulary is a trie. Every node has a failure link (the node that matching goes
on from after the longest piece has been taken off the front) and the number of
pieces popped on the way, both computed once. Counting a word then takes one pass
over its characters and builds no pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pieces, session

MARK = "▁"  # begins a word in the vocabulary
DEAD = -1


class Automaton:
    """Greedy longest-match piece counts. Characters without a piece count their UTF-8 bytes."""

    def __init__(self, vocabulary):
        words = {p: 1 for p in vocabulary if p}
        for c in {c for p in words for c in p}:
            words.setdefault(c, len(c.encode("utf-8", "surrogatepass")))
        self.next: list[dict[str, int]] = [{}]
        cost = [0]
        for p, n in words.items():
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    cost.append(0)
                at = to
            cost[at] = n
        self.fail, self.popped = [DEAD] * len(self.next), [0] * len(self.next)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                if cost[v]:
                    self.fail[v], self.popped[v] = 0, cost[v]
                else:  # what is matched so far, less pieces taken off its front
                    z, n = self.fail[u], self.popped[u]
                    while z != DEAD and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z != DEAD:
                        self.fail[v], self.popped[v] = self.next[z][c], n
                todo.append(v)

    def count(self, word: str) -> int:
        nxt, fail, popped, u, n = self.next, self.fail, self.popped, 0, 0
        for c in word:
            while c not in nxt[u]:
                if not u:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += popped[u]
                u = fail[u]
            else:
                u = nxt[u][c]
        while u:
            n += popped[u]
            u = fail[u]
        return n


class Counts(dict):
    """Counts of words met before; emptied when it holds ``most`` words."""

    def __init__(self, automaton: Automaton, most: int):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(MARK + word)
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def load_vocabulary(path: str) -> list[str]:
    """Pieces of a public sentencepiece model, without control and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def worker_counts(path: str, most_words: int) -> Counts:
    """A Python worker builds the automaton once and keeps it, with the words it has met, for its later tasks."""
    return Counts(Automaton(load_vocabulary(path)), most_words)


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def count_tokens(docs: DataFrame, path: str, most_words: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text. No shuffle.

    The vocabulary is of a fixed size and read by each Python worker; ``most_words``
    bounds the worker's memory of counted words. Null and empty texts have none; null ids
    and repeated rows stay rows; very long texts and words are read whole; an empty table
    gives no rows; other columns are not read.
    """

    def run(batches):
        get = worker_counts(path, most_words).__getitem__
        for b in pieces(batches):
            words, tokens = [], []
            for t in b.column(1).to_pylist():
                w = SPACE.findall(t) if t else []
                words.append(len(w))
                tokens.append(sum(map(get, w)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word-piece counts of every document; nulls and repeated rows stay rows."""
    return count_tokens(session(spark).read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())

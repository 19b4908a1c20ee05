"""Toxicity by weak supervision.

Many voters look at a text: a fixed lexicon in groups, groups of words that labelled
rows tie to toxicity, how many such words there are, and patterns that need none of them:
address, masked words, shouting. A generative label model estimates each voter's
class-conditional rates from the covariances of votes over all documents (triplets of
voters that are independent given the class) and which voters stay correlated given
the class; correlated voters share their weight. Its posterior labels train a linear
classifier on words and votes, which scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Store, pieces, session, text_key

# Common insults, in groups of which each is one voter.
LEXICON = (
    ("idiot", "moron", "imbecile", "cretin", "dumb", "stupid", "fool", "dimwit"),
    ("scum", "trash", "filth", "vermin", "garbage", "parasite", "pig", "rat"),
    ("worthless", "pathetic", "useless", "loser", "failure", "nobody", "weak"),
    ("disgusting", "vile", "repulsive", "clown", "freak", "ugly", "creep"),
)
WORD = re.compile(rb"[a-z\x80-\xff]+")
SHOUT = re.compile(r"\b[A-Z]{4,}\b")
# Forms that insult whatever the word; each is one voter.
ADDRESS = re.compile(r"\b(?:[Yy]ou(?: are|'re|r)? (?:an? |such |so |nothing|all |just )|[Ss]hut up|[Gg]o away|[Nn]obody (?:likes|wants|needs) you)")
MASKED = re.compile(r"\b[A-Za-z]{1,3}[*@#$]{2,}[A-Za-z]{0,8}\b")
PATTERNS = 6
BITS = 20  # hashed word features
MINED_GROUPS = 8


def tokens(text: str) -> set[bytes]:
    """The distinct words of a whole text and their beginnings of five and seven bytes (with a star)."""
    if not text:
        return set()
    words = set(WORD.findall(text.lower().encode("utf-8", "surrogatepass")))
    long = [w for w in words if len(w) > 5]
    return words.union([w[:5] + b"*" for w in long], [w[:7] + b"*" for w in long if len(w) > 7])


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))


class Voters:
    """Votes of a text as a bit mask: bit j is set if voter j says toxic."""

    def __init__(self, mined: list[bytes]):
        groups = [frozenset(w.encode() for w in g) for g in LEXICON]
        groups += [frozenset(mined[i::MINED_GROUPS]) for i in range(MINED_GROUPS)]
        self.bit = {}
        for j, g in enumerate(groups):
            for w in g:
                self.bit[w] = self.bit.get(w, 0) | 1 << j
        self.all = frozenset(self.bit)
        self.n = len(groups) + PATTERNS

    def __call__(self, words: set[bytes], text: str) -> int:
        hit = self.all & words
        out = 0
        for w in hit:
            out |= self.bit[w]
        k = self.n - PATTERNS
        out |= (len(hit) >= 2) << k | (len(hit) >= 3) << (k + 1)
        loud = text.count("!") >= 3 and len(list(islice(SHOUT.finditer(text), 3))) == 3
        out |= bool(hit and loud) << (k + 2) | loud << (k + 3)
        return out | bool(ADDRESS.search(text)) << (k + 4) | bool(MASKED.search(text)) << (k + 5)


class LabelModel:
    """Class-conditional rates and correlations of binary voters from first and second moments."""

    def __init__(self, mean: np.ndarray, second: np.ndarray, prior: float):
        self.prior = min(max(prior, 1e-4), 0.5)
        cov = second - np.outer(mean, mean)
        var = mean * (1 - mean)
        use = np.flatnonzero(var > 1e-9)
        spread = np.sqrt(self.prior * (1 - self.prior))
        strength = np.zeros(len(mean))  # spread * (rate if toxic - rate if clean)
        free = np.ones((len(mean), len(mean)), bool)
        for _ in range(2):
            for i in use:
                got = []
                for j, k in combinations([x for x in use if x != i and free[i, x]], 2):
                    if free[j, k] and cov[j, k] > 1e-9 and cov[i, j] > 0 and cov[i, k] > 0:
                        got.append(np.sqrt(cov[i, j] * cov[i, k] / cov[j, k]))
                strength[i] = np.median(got) if got else strength[i]
            strength = np.minimum(strength, np.sqrt(var) * 0.98)
            rest = np.maximum(var - strength**2, 1e-6)
            self.correlation = np.clip((cov - np.outer(strength, strength)) / np.sqrt(np.outer(rest, rest)), -1, 1)
            free = np.abs(self.correlation) < 0.25
        gap = strength / spread
        self.toxic = np.clip(mean + (1 - self.prior) * gap, 1e-4, 1 - 1e-4)
        self.clean = np.clip(mean - self.prior * gap, 1e-4, 1 - 1e-4)
        share = np.where(free, 0, np.abs(self.correlation))
        np.fill_diagonal(share, 0)
        weight = np.zeros(len(mean))
        weight[use] = 1 / (1 + share[np.ix_(use, use)].sum(1))
        self.yes = weight * np.log(self.toxic / self.clean)
        self.no = weight * np.log((1 - self.toxic) / (1 - self.clean))

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        votes = (masks[:, None] >> np.arange(len(self.yes))) & 1
        z = np.log(self.prior / (1 - self.prior)) + np.where(votes, self.yes, self.no).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def features(words: set[bytes], mask: int, n_votes: int) -> list[int]:
    """Hashed words, then one feature per vote, then one for any vote."""
    crc, low = zlib.crc32, (1 << BITS) - 1
    out = [crc(w) & low for w in words]
    if mask:
        out += [(1 << BITS) + j for j in range(n_votes) if mask >> j & 1] + [(1 << BITS) + n_votes]
    return out


def fit_linear(rows: list[np.ndarray], y: np.ndarray, size: int, steps: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features by Adam, with the classes weighted alike."""
    if not len(rows):
        return np.zeros(size, np.float32), -3.0
    col = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, col = np.unique(col, return_inverse=True)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    weight = y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(row, w[col], len(rows))
        r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        g = np.append(np.bincount(col, r[row], len(used)), r.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    out = np.zeros(size, np.float32)
    out[used] = w[:-1]
    return out, float(w[-1])


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def scores(self, texts) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            words = tokens(t)
            f = features(words, self.voters(words, t or ""), self.voters.n)
            if f:
                z[i] += self.weights[f].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows that may be learned from, by a hash of their id."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    own = own.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("l_id"))


def train(docs: DataFrame, labels: DataFrame, store: Store, label_rows: int = 20_000, sample_rows: int = 5_000, mined_words: int = 256, least: float = 8, least_odds: float = 4.0, mined_least: int = 8, mined_odds: float = 20.0) -> Model:
    """Bounds, all parameters: ``label_rows`` labelled rows mine the words of voters, of which the
    ``mined_words`` that tell most are used (of those that ``mined_least`` toxic rows hold, ``mined_odds`` times as often as clean ones); the label model's moments cover all documents; ``sample_rows`` documents of each posterior class fit the classifier.
    A feature takes part in it if it has ``least`` rows' worth of posterior toxicity and is
    ``least_odds`` times as frequent in toxic rows as in clean ones.
    """

    def count_words(batches):
        for b in pieces(batches, 2 << 20):
            n: dict[bytes, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in tokens(t) | {b""}:  # the empty word counts rows
                    n.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), *(pa.array([v[i] for v in n.values()], pa.int64()) for i in (0, 1))], names=["word", "clean", "toxic"])

    known = labelled(docs, labels, label_rows).select("text", F.col("toxic").cast("int").alias("toxic"))
    counts = store.put(known.mapInArrow(count_words, "word binary, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "word-counts")
    rows = counts.where(F.octet_length("word") == 0).first()
    n_clean, n_toxic = (rows.clean, rows.toxic) if rows else (0, 0)
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    best = counts.where((F.octet_length("word") > 2) & (F.col("toxic") >= mined_least) & (ratio >= mined_odds)).orderBy(F.desc(F.col("toxic") * F.log(ratio)), "word").limit(mined_words)
    voters = Voters([bytes(r.word) for r in best.select("word").collect()])
    n = voters.n

    def vote(batches):
        for b in pieces(batches, 2 << 20):
            m = []
            for t in b.column(2).to_pylist():
                m.append(voters(tokens(t), t or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.int64())], names=["doc_id", "key", "mask"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), F.col("text").cast("string").alias("text"))
    votes = store.put(d.mapInArrow(vote, "doc_id bigint, key bigint, mask bigint"), "votes")

    def moments(batches):
        total, first, second = 0, np.zeros(n), np.zeros((n, n))
        for b in batches:
            v = ((np.asarray(b.column(0))[:, None] >> np.arange(n)) & 1).astype(np.float64)
            total, first, second = total + len(v), first + v.sum(0), second + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + n + n * n)), pa.array(np.concatenate([[total], first, second.ravel()]))], names=["i", "x"])

    sums = votes.select("mask").mapInArrow(moments, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x"))
    x = np.zeros(1 + n + n * n)
    for r in sums.collect():  # a fixed number of sums
        x[r.i] = r.x
    total = max(1.0, x[0])
    model = LabelModel(x[1 : n + 1] / total, x[n + 1 :].reshape(n, n) / total, (n_toxic + 1) / (n_clean + n_toxic + 10))

    def judge(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.posterior(np.asarray(b.column(2))))], names=["s_id", "s_key", "p"])

    posterior = votes.where(~held_out()).select("doc_id", "key", "mask").mapInArrow(judge, "s_id bigint, s_key bigint, p double")
    order = (F.xxhash64("s_id", "s_key"), F.col("s_id"))
    parts = [posterior.where(c).orderBy(*order).limit(sample_rows) for c in (F.col("p") >= 0.5, F.col("p") < 0.5)]
    chosen = store.put(parts[0].unionByName(parts[1]).distinct(), "sample")

    sample = d.join(F.broadcast(chosen), d.doc_id.eqNullSafe(chosen.s_id) & (d.key == chosen.s_key)).select("p", "text", "s_id", "s_key")

    def count_features(batches):
        for b in pieces(batches, 2 << 20):
            pos: dict[int, list[float]] = {}
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(t)
                for f in {-1, *features(words, voters(words, t or ""), n)}:  # -1 counts rows
                    x = pos.setdefault(f, [0.0, 0.0])
                    x[0] += p
                    x[1] += 1 - p
            yield pa.RecordBatch.from_arrays([pa.array(list(pos), pa.int64()), *(pa.array([x[i] for x in pos.values()], pa.float64()) for i in (0, 1))], names=["f", "toxic", "clean"])

    seen = sample.mapInArrow(count_features, "f bigint, toxic double, clean double").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = store.put(seen, "feature-counts")
    rows = seen.where("f = -1").first()
    toxic, clean = (rows.toxic, rows.clean) if rows else (0.0, 0.0)
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    used = {r.f for r in seen.where((F.col("f") >= 0) & (F.col("toxic") >= least) & (odds >= least_odds)).select("f").collect()}  # at most 2**BITS and the voters

    def featurize(batches):
        for b in pieces(batches, 2 << 20):
            f = []
            for t in b.column(1).to_pylist():
                words = tokens(t)
                f.append(sorted(used.intersection(features(words, voters(words, t or ""), n))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.int32())), b.column(2), b.column(3)], names=["p", "f", "s_id", "s_key"])

    # repeated rows (same id and text) are one row of the sample, which keeps it within its bound
    rows = sample.mapInArrow(featurize, "p double, f array<int>, s_id bigint, s_key bigint").dropDuplicates(["s_id", "s_key"]).select("p", "f").toArrow()
    weights, bias = fit_linear([np.asarray(f.values) for f in rows.column("f")], np.asarray(rows.column("p")), (1 << BITS) + n + 1)
    return Model(voters, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, key, held_out, score, predicted of every document row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2**BITS weights and the voters

    def run(batches):
        m = shared.value
        for b in pieces(batches, 2 << 20):
            s = m.scores(b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "key", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, key bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, store: Store) -> DataFrame:
    """The documents that are not judged toxic, with all their columns, whatever these are called.

    Null and empty texts stay or go by the score of a text without words; repeated rows
    share their fate; very long texts are scored whole; an empty table stays empty.
    """
    bad = score(docs, train(docs, labels, store)).where("predicted = 1").select(F.col("doc_id").alias("t_id"), F.col("key").alias("t_key")).distinct()
    bad = store.put(bad, "toxic")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad.t_id) & (text_key("text") == bad.t_key), "left_anti")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document row, repeated ones too. Null and empty texts get the score of a
    text without words, null ids are never held out, very long texts are scored whole, an
    empty table gives no rows, and no other column is read.
    """
    docs, labels = (session(spark).read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels, Store(spark))).drop("key")

"""Inverted index and field-weighted BM25.

``Postings`` keeps an index in segments. Rows of a segment are dealt to lots of alike
length; a row of its postings holds a term's places in one lot, with the greatest weight
that the term has there. Adding or deleting rows reads the new rows and the small table of
rows of the segments, never their postings: deleted rows are listed beside a segment,
and segments of like size are merged when there are several, from the words that each keeps. A search reads the parts
and terms it names; the best k rows come from those lots only whose bounds reach the kth
score.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import located
from ..sources.versions import Versions

TOKEN = r"([\p{L}\p{N}\p{Co}\-_./#]+)"
#: Rows of deleted keys, and of chosen lots, up to which they are sent to all tasks.
FEW = 200_000
#: Words of a lot, about, as its rows are turned into postings together; long rows make smaller lots.
LOT_WORDS = 1 << 20
#: Bytes of words that a task turns into postings at a time, besides those of one lot.
HELD = 4 << 20


def _accents() -> tuple[str, str]:
    """Lower-case letters with marks, and the plain letters they stand on."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x1EFA)]
    pairs = [(c, d) for c, d in pairs if len(d) > 1 and c.islower() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d[0] for _, d in pairs)


ACCENTS = _accents()


def terms(c: Column) -> Column:
    """Lower-case runs of letters, digits and joining marks, without diacritics, combining ones too."""
    plain = F.translate(F.regexp_replace(F.lower(c), r"[\x{0300}-\x{036F}]", ""), *ACCENTS)
    return F.regexp_extract_all(plain, F.lit(TOKEN), 1)


def saturation(tf: Column, size: Column, avg: float) -> Column:
    """The share of its largest weight that a term has in a row; grows with tf, falls with the row's size."""
    return tf / (tf + 1.2 * (0.25 + 0.75 * size / F.lit(avg)))


def length_class(size: Column) -> Column:
    return F.floor(4 * F.log2(size + 1)).cast("int")


class Postings:
    """A stored index of keyed rows with weighted text fields; see the module's text.

    Keys are whole numbers and unique among the rows added; rows without a key are not
    indexed. Positions of different fields are far apart, so that no phrase crosses fields.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, fields: dict[str, float], lot_rows: int = 256, task_bytes: int = 8 << 20):
        self.spark, self.key, self.fields, self.lot_rows, self.task_bytes = spark, key, fields, lot_rows, task_bytes
        self.versions = Versions(spark, folder)
        self.folder = self.versions.folder

    def state(self) -> dict:
        return self.versions.latest() or {"version": -1, "segments": [], "batches": {}}

    # changes

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> bool:
        """One version in which rows of ``removed`` keys are gone and ``added`` rows take the place of those of the same key.

        ``batch`` is a writer's name and the number of its batch: a batch that has been
        applied changes nothing and gives False, so that a stream may repeat it.
        """
        state = self.state()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        segments = [dict(s, dead=list(s["dead"])) for s in state["segments"]]
        keys = [d.select(F.col(self.key).cast("long").alias("key")) for d in (added, removed) if d is not None]
        if segments and keys:
            self.bury(segments, reduce(DataFrame.unionByName, keys).where("key is not null").distinct())
        if added is not None:
            segments += self.segment_of_rows(added)
        batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        self.versions.commit(state | {"segments": [s for s in segments if live(s)["rows"] > 0], "batches": batches})
        return True

    def bury(self, segments: list[dict], keys: DataFrame) -> None:
        """List the live rows of ``keys`` beside each segment that holds some."""
        name = self.versions.new("dead")
        gone = self.documents(segments).join(keys, "key", "left_semi")
        gone.write.partitionBy("segment").parquet(f"{self.folder}/{name}")
        lost = self.spark.read.schema("key bigint, len int, lot bigint, segment string").parquet(f"{self.folder}/{name}").groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.sum("len").alias("words"))
        lost = {r["segment"]: r for r in lost.collect()}  # one row a segment
        for s in segments:
            if r := lost.get(s["name"]):
                s["dead"].append({"name": name, "rows": int(r["rows"]), "words": int(r["words"])})

    def dead(self, segments: list[dict]) -> DataFrame | None:
        """(segment, lot, key) of deleted rows."""
        own = [(s["name"], [f"{self.folder}/{d['name']}/segment={s['name']}" for d in s["dead"]]) for s in segments if s["dead"]]
        tables = [self.spark.read.schema("key bigint, lot bigint").parquet(*folders).select(F.lit(name).alias("segment"), "lot", "key") for name, folders in own]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def alive(self, rows: DataFrame, segments: list[dict], on: list[str] | None = None) -> DataFrame:
        gone, on = self.dead(segments), on or ["segment", "lot", "key"]
        if gone is None:
            return rows
        if sum(d["rows"] for s in segments for d in s["dead"]) <= FEW:
            gone = F.broadcast(gone)
        return rows.join(gone.select(*on), on, "left_anti")

    def documents(self, segments: list[dict]) -> DataFrame:
        """(key, len, lot, segment) of live rows."""
        return self.alive(self.read("rows", segments), segments)

    def read(self, what: str, segments: list[dict]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/{s['name']}/{what}").withColumn("segment", F.lit(s["name"])) for s in segments])

    def segment_of_rows(self, chunks: DataFrame) -> list[dict]:
        """Texts are split once, into a table of their words that stays with the segment, so that merging reads it again."""
        cores = self.spark.sparkContext.defaultParallelism
        if chunks.rdd.getNumPartitions() < cores:  # a few large files would leave most cores idle
            chunks = chunks.select(self.key, *self.fields).repartition(cores)
        t = chunks.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias("key"), *[F.coalesce(terms(F.col(f)), F.array().cast("array<string>")).alias(f"t_{i}") for i, f in enumerate(self.fields)])
        size = reduce(lambda a, b: a + b, [F.size(f"t_{i}") for i in range(len(self.fields))])
        # no term holds a space
        return self.write(t.select("key", size.alias("len"), *[F.array_join(f"t_{i}", " ").alias(f"t_{i}") for i in range(len(self.fields))]))

    def write(self, words: DataFrame) -> list[dict]:
        """Write a segment of rows (key, len, t_0, t_1, ...), with each field's words in order.

        Rows meet once, lot by lot: a task turns whole lots into posting rows, so that no posting is shuffled.
        """
        name = self.versions.new("segment")
        words.write.option("compression", "zstd").parquet(f"{self.folder}/{name}/words")
        words = self.spark.read.parquet(f"{self.folder}/{name}/words")
        counts = {r["c"]: r for r in words.groupBy(length_class(F.col("len")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words")).collect()}  # some 130 classes at the most
        total, size = sum(int(r["n"]) for r in counts.values()), sum(int(r["words"]) for r in counts.values())
        if not total:
            fs, path = located(self.spark, f"{self.folder}/{name}")
            fs.delete(path, True)
            return []
        lots = [max(-(-int(counts[c]["n"]) // self.lot_rows), -(-int(counts[c]["words"]) // LOT_WORDS)) if c in counts else 1 for c in range(max(counts) + 1)]
        firsts = [sum(lots[:c]) for c in range(len(lots))]
        own = lambda xs: F.get(F.array(*[F.lit(x).cast("long") for x in xs]), length_class(F.col("len")))
        lot = own(firsts) + F.pmod(F.xxhash64("key"), own(lots))  # follows from a row's key and size alone
        words.select("key", "len", lot.alias("lot")).write.option("compression", "zstd").parquet(f"{self.folder}/{name}/rows")
        tasks = max(-(-size * 8 // self.task_bytes), min(self.spark.sparkContext.defaultParallelism, -(-size * 8 // (1 << 20))), 1)
        parts = math.isqrt((tasks - 1) // 4) + 1  # tasks are small, as their posting rows are sorted in memory; parts need not be
        avg = max(size / total, 1e-9)
        # a frequent term's lots lie in several tasks, so that it is split
        x = words.withColumn("lot", lot).repartition(tasks, "lot").sortWithinPartitions("lot")
        blocks = x.mapInArrow(inverted(list(self.fields.values()), avg), "term string, lot bigint, n int, most double, key array<bigint>, len array<int>, tf array<double>, places array<array<bigint>>")
        blocks = blocks.withColumn("part", (F.crc32(F.encode("term", "UTF-8")) % parts).cast("int"))
        blocks.sortWithinPartitions("part", "term", "lot").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.folder}/{name}/postings")
        return [{"name": name, "rows": total, "words": size, "avg": avg, "parts": parts, "dead": []}]

    def compact(self, several: int = 4) -> bool:
        """Merge the smallest segments of like size (within a power of ``several``) if there are as many, or those of which half is deleted; False if nothing is to be done."""
        state = self.state()
        tiers: dict[int, list[dict]] = {}
        for s in state["segments"]:
            tiers.setdefault(int(math.log(live(s)["rows"], several)), []).append(s)
        chosen = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= several), None) or [s for s in state["segments"] if 2 * live(s)["rows"] < s["rows"]]
        if not chosen:
            return False
        names = {s["name"] for s in chosen}
        merged = self.write(self.alive(self.read("words", chosen), chosen, ["segment", "key"]).drop("segment"))
        self.versions.commit(state | {"segments": [s for s in state["segments"] if s["name"] not in names] + merged})
        return True

    def clean(self) -> list[str]:
        """Delete what the latest version does not name. Nobody may be reading or writing."""
        segments = self.state()["segments"]
        return self.versions.clean({s["name"] for s in segments} | {d["name"] for s in segments for d in s["dead"]})

    # searches

    def blocks(self, segments: list[dict], words: list[str], *columns: str) -> DataFrame:
        """Posting rows of some terms: only their parts and terms are read."""

        def own(s: dict) -> DataFrame:
            parts = sorted({zlib.crc32(w.encode()) % s["parts"] for w in words})
            p = self.spark.read.parquet(f"{self.folder}/{s['name']}/postings").where(F.col("part").isin(parts) & F.col("term").isin(words))
            return p.select(F.lit(s["name"]).alias("segment"), "term", "lot", *columns)

        return reduce(DataFrame.unionByName, map(own, segments))

    def frequencies(self, segments: list[dict], words: list[str]) -> dict[str, int]:
        """Live rows of each term. Keys are read in those lots only where rows are deleted."""
        b = self.blocks(segments, words, "n")
        n = {r["term"]: int(r["n"]) for r in b.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if (gone := self.dead(segments)) is not None:
            rows = self.blocks(segments, words, "key").join(gone.select("segment", "lot").distinct(), ["segment", "lot"], "left_semi")
            lost = rows.select("segment", "lot", "term", F.explode("key").alias("key")).join(gone.select("segment", "lot", "key"), ["segment", "lot", "key"])
            for r in lost.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():
                n[r["term"]] -= int(r["n"])
        return n

    def statistics(self, segments: list[dict]) -> tuple[int, float]:
        rows, words = (sum(live(s)[k] for s in segments) for k in ("rows", "words"))
        return rows, max(words / rows, 1e-9) if rows else 1.0

    def matching(self, segments: list[dict], phrase: list[str], within=lambda b: b) -> DataFrame:
        """(segment, lot, key, len, tf) of live rows that hold a phrase; a term alone counts all its places."""
        rows = None
        for i, term in enumerate(phrase):
            if len(phrase) == 1:
                return self.alive(opened(within(self.blocks(segments, [term], "key", "len", "tf")), "key", "len", "tf").drop("term"), segments)
            own = opened(within(self.blocks(segments, [term], "key", "len", "tf", "places")), "key", "len", "tf", "places")
            own = own.select("segment", "lot", "key", F.col("len").alias(f"l_{i}"), (F.col("tf") / F.size("places")).alias(f"w_{i}"), shifted("places", i).alias(f"p_{i}"))
            rows = own if rows is None else rows.join(own, ["segment", "lot", "key"])
        at = reduce(F.array_intersect, [F.col(f"p_{i}") for i in range(len(phrase))])
        rows = rows.withColumn("at", at).where(F.size("at") > 0).select("segment", "lot", "key", F.col("l_0").alias("len"), (F.size("at") * F.col("w_0")).alias("tf"))
        return self.alive(rows, segments)

    def score(self, segments: list[dict], phrases: list[list[str]], weights: list[float], every: bool, within=lambda b: b) -> DataFrame:
        """(key, rank) of the rows that hold any phrase, or every one."""
        _, avg = self.statistics(segments)
        hits = [self.matching(segments, p, within).withColumn("gain", F.lit(w) * saturation(F.col("tf"), F.col("len"), avg)) for p, w in zip(phrases, weights, strict=True)]
        scored = reduce(DataFrame.unionByName, hits).groupBy("key").agg((-F.sum("gain")).alias("rank"), F.count(F.lit(1)).alias("n"))
        return scored.where(F.col("n") == len(phrases) if every else F.lit(True)).select(F.col("key").alias(self.key), "rank")

    def weights(self, segments: list[dict], phrases: list[list[str]]) -> list[float]:
        """A phrase's largest gain in a row, from its number of rows."""
        rows, _ = self.statistics(segments)
        single = self.frequencies(segments, [p[0] for p in phrases if len(p) == 1]) if any(len(p) == 1 for p in phrases) else {}
        n = [single.get(p[0], 0) if len(p) == 1 else self.matching(segments, p).count() for p in phrases]
        return [2.2 * max(math.log((rows - x + 0.5) / (x + 0.5)), 1e-6) for x in n]

    def search(self, phrases: list[list[str]], every: bool = False) -> DataFrame:
        """(key, rank): negative, smaller is better. ``every``: all phrases must occur, else any."""
        segments, phrases = self.state()["segments"], [list(p) for p in dict.fromkeys(map(tuple, phrases)) if p]
        if not segments or not phrases:
            return self.none()
        return self.score(segments, phrases, self.weights(segments, phrases), every)

    def none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.key} bigint, rank double")

    def bounds(self, segments: list[dict], phrases: list[list[str]], weights: list[float], every: bool) -> DataFrame:
        """(segment, lot, bound): no row of the lot has a larger gain. A phrase gains at most what its first term would."""
        _, avg = self.statistics(segments)
        # a row's saturation changes with the average size, by no more than the ratio of the two
        ratio = F.element_at(F.create_map(*[F.lit(x) for s in segments for x in (s["name"], max(1.0, avg / s["avg"]))]), F.col("segment"))
        own = [self.blocks(segments, [p[0]], "most").select("segment", "lot", (F.lit(w) * F.least(F.lit(1.0), F.col("most") * ratio)).alias("gain")) for p, w in zip(phrases, weights, strict=True)]
        b = reduce(DataFrame.unionByName, own).groupBy("segment", "lot").agg((F.sum("gain") * (1 + 1e-9)).alias("bound"), F.count(F.lit(1)).alias("n"))
        return b.where(F.col("n") == len(phrases) if every else F.lit(True)).select("segment", "lot", "bound")

    def top(self, phrases: list[list[str]], k: int, every: bool = False, first: int = 8, few: int = 1000) -> DataFrame:
        """The ``k`` best rows of ``search``, ties to smaller keys, from the lots that can hold them.

        The ``first`` lots of greatest bounds are scored; their kth score turns away all lots of lower bounds.
        Up to ``few`` lots that are left are named in the scan's filter, more are joined.
        """
        segments, phrases = self.state()["segments"], [list(p) for p in dict.fromkeys(map(tuple, phrases)) if p]
        if not segments or not phrases:
            return self.none()
        weights = self.weights(segments, phrases)
        within = self.reaching(segments, phrases, weights, k, every, first, few)
        return self.score(segments, phrases, weights, every, within).orderBy("rank", self.key).limit(k)

    def reaching(self, segments, phrases, weights, k: int, every: bool, first: int = 8, few: int = 1000):
        """A filter of posting rows: those of the lots whose bounds reach the kth score of the first lots."""
        bounds = self.bounds(segments, phrases, weights, every)
        lots = [(r["segment"], int(r["lot"])) for r in bounds.orderBy(F.desc("bound"), "segment", "lot").limit(first).collect()]
        kth = self.score(segments, phrases, weights, every, named(lots)).orderBy("rank").limit(k).agg(F.max("rank").alias("kth"), F.count(F.lit(1)).alias("n")).first()
        if kth["n"] == k:
            bounds = bounds.where(F.col("bound") >= -kth["kth"])
        chosen = [(r["segment"], int(r["lot"])) for r in bounds.select("segment", "lot").limit(few + 1).collect()]
        if len(chosen) <= few:
            return named(chosen)
        chosen = bounds.select("segment", "lot")
        if chosen.limit(FEW + 1).count() <= FEW:
            chosen = F.broadcast(chosen)
        return lambda b: b.join(chosen, ["segment", "lot"], "left_semi")


def inverted(weights: list[float], avg: float):
    """Batches of (key, len, t_0, t_1, ..., lot), in order of lots, to one posting row for each term of a lot."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for p in range(0, b.num_rows, step := max(1, int(b.num_rows * HELD / max(1, b.nbytes)))):
                held.append(b.slice(p, step))
                size += held[-1].nbytes
                if size > HELD:
                    t = pa.Table.from_batches(held).combine_chunks()
                    lots = np.asarray(t.column("lot").combine_chunks())
                    whole = int(np.searchsorted(lots, lots[-1]))  # the last lot may go on
                    if whole:
                        yield from one(t.slice(0, whole))
                    held = [pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in x.columns], names=x.schema.names) for x in t.slice(whole).to_batches()]
                    size = sum(x.nbytes for x in held)
        if held:
            yield from one(pa.Table.from_batches(held))

    def one(t):
        t = t.combine_chunks()
        key, size, lot = (np.asarray(t.column(c).combine_chunks()) for c in ("key", "len", "lot"))
        fields = [pc.split_pattern(t.column(f"t_{i}").combine_chunks(), " ") for i in range(len(weights))]
        sizes = [np.diff(np.asarray(f.offsets)) for f in fields]
        words = pa.concat_arrays([f.flatten() for f in fields])
        doc = np.concatenate([np.repeat(np.arange(len(key)), n) for n in sizes])
        at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (i << 40) for i, n in enumerate(sizes)])
        weight = np.concatenate([np.full(n.sum(), w, np.float64) for n, w in zip(sizes, weights, strict=True)])
        there = pc.not_equal(words, "")  # the one part of a field without words
        words = words.filter(there).dictionary_encode()
        there = np.asarray(there.to_numpy(zero_copy_only=False))
        doc, at, weight, code = doc[there], at[there], weight[there], np.asarray(words.indices)
        if not len(code):
            return
        order = np.lexsort((at, doc, code, lot[doc]))
        doc, code, at, weight = doc[order], code[order], at[order], weight[order]
        # a posting is a term in a row, a block a term in a lot
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])
        row, term, tf = doc[first], code[first], np.add.reduceat(weight, first)
        gain = tf / (tf + 1.2 * (0.25 + 0.75 * size[row] / avg))
        block = np.flatnonzero(np.r_[True, (lot[row][1:] != lot[row][:-1]) | (term[1:] != term[:-1])])
        ends = np.r_[block, len(row)].astype(np.int32)
        most, n = np.maximum.reduceat(gain, block), np.diff(ends)
        places, per = np.r_[first, len(at)], max(1, int(len(block) * (1 << 20) / max(1, len(at))))
        for i in range(0, len(block), per):  # some megabytes at a time
            j = min(len(block), i + per)
            p, q = ends[i], ends[j]
            off = pa.array(ends[i : j + 1] - p)
            inner = pa.ListArray.from_arrays(pa.array((places[p : q + 1] - places[p]).astype(np.int32)), pa.array(at[places[p] : places[q]].astype(np.int64)))
            lists = [pa.array(key[row[p:q]].astype(np.int64)), pa.array(size[row[p:q]].astype(np.int32)), pa.array(tf[p:q]), inner]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[block[i:j]])), pa.array(lot[row[block[i:j]]].astype(np.int64)), pa.array(n[i:j].astype(np.int32)), pa.array(most[i:j]), *[pa.ListArray.from_arrays(off, x) for x in lists]], names=["term", "lot", "n", "most", "key", "len", "tf", "places"])

    return run


def live(s: dict) -> dict:
    """Rows and words of a segment that are not deleted."""
    return {k: s[k] - sum(d[k] for d in s["dead"]) for k in ("rows", "words")}


def named(lots: list[tuple[str, int]]):
    """A filter of posting rows to some lots, which reaches the scan."""
    by: dict[str, list[int]] = {}
    for segment, lot in lots:
        by.setdefault(segment, []).append(lot)
    ok = reduce(lambda a, b: a | b, [(F.col("segment") == s) & F.col("lot").isin(own) for s, own in by.items()], F.lit(False))
    return lambda b: b.where(ok)


def opened(blocks: DataFrame, *columns: str) -> DataFrame:
    """One row for each row of a posting row's arrays."""
    x = blocks.select("segment", "term", "lot", F.explode(F.arrays_zip(*columns)).alias("x"))
    return x.select("segment", "term", "lot", *[F.col(f"x.{c}").alias(c) for c in columns])


def shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def times(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(word)))


def bm25(chunks: DataFrame, key: str, fields: dict[str, float], query: list[str], every: bool = False) -> DataFrame:
    """(key, rank) without a stored index: one pass over the texts, for tables that are searched once."""
    t = chunks.select(key, *[terms(F.col(f)).alias(f"t_{i}") for i, f in enumerate(fields)])
    n = reduce(lambda a, b: a + b, [F.size(f"t_{i}") for i in range(len(fields))])
    tf = [sum((F.lit(float(w)) * times(f"t_{i}", q) for i, w in enumerate(fields.values())), F.lit(0.0)).alias(f"tf_{j}") for j, q in enumerate(dict.fromkeys(query))]
    rows = t.select(key, n.alias("len"), *tf)
    names = [f"tf_{j}" for j in range(len(tf))]
    stats = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("avg"), *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in names])
    x = rows.crossJoin(F.broadcast(stats))
    part = [F.when(F.col(c) > 0, F.greatest(F.log((F.col("rows") - F.col(f"n_{c}") + 0.5) / (F.col(f"n_{c}") + 0.5)), F.lit(1e-6)) * F.col(c) * 2.2 / (F.col(c) + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg")))).otherwise(0.0) for c in names]
    ok = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [F.col(c) > 0 for c in names])
    return x.where(ok).select(key, (-reduce(lambda a, b: a + b, part)).alias("rank"))

"""Vector and lexical candidates, their merge, rerank and pruning as Column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import predicates

# Limits of one search.
MOST_HITS, EXPANSION, FEWEST_CANDIDATES, FEWEST_A_QUERY = 20, 8, 24, 12
#: Query vectors of a block, and rows of a shard, that a task holds at once; more are dealt to several.
QUERY_BLOCK = SHARD_ROWS = 40_000
SLACK = 1e-9  # rounding of a matrix product never hides a row


def candidate_limit(k: int) -> int:
    """Candidates of one kind for ``k`` hits."""
    return max(EXPANSION * min(max(k, 1), MOST_HITS), FEWEST_CANDIDATES)


def limit_of_each(total: int, queries: int) -> int:
    """The share of one of several sub-queries."""
    return max(total // max(queries, 1), FEWEST_A_QUERY)


def limits(k: Column, queries: int) -> Column:
    """Struct of a search's candidates and the share of each of its sub-queries, for ``k`` hits."""
    total = F.greatest(EXPANSION * F.least(F.greatest(k, F.lit(1)), F.lit(MOST_HITS)), F.lit(FEWEST_CANDIDATES)).cast("int")
    return F.struct(total.alias("candidates"), F.greatest(F.floor(total / max(queries, 1)), F.lit(FEWEST_A_QUERY)).cast("int").alias("each"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def distance_score(d: Column) -> Column:
    return 1 / (1 + F.greatest(d, F.lit(0.0)))


def rank_score(r: Column) -> Column:
    return F.abs(r) / (1 + F.abs(r))


def pseudo_distance(score: Column) -> Column:
    """The distance of a hit that only words have found."""
    return F.greatest(F.least(1 - score, F.lit(1.0)), F.lit(0.0))


def knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = QUERY_BLOCK, shards: int | None = None) -> DataFrame:
    """(query, key, distance, rank), exact: every query against all rows but its own. Keys are whole numbers.

    Rows are dealt to ``shards`` (so many that all cores have some and none holds more than ``SHARD_ROWS`` or so), queries to
    blocks of about ``block``; each block meets each shard once, as matrices, and leaves its best ``k`` of a query there.
    Vectors that can't be compared (null, of another length, holding a null) have a null distance and come last, those
    without a direction before them.
    """
    usable = lambda d, *names: d.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).where("key is not null").toDF(*names)
    own, q = usable(vectors, "key", "v"), usable(queries, "query", "qv")
    blocks = max(1, -(-queries.count() // block))
    shards = shards or max(-(-vectors.count() // SHARD_ROWS), -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = own.withColumns({"b": every(blocks), "s": dealt("key", shards)}).repartition(blocks * shards, "b", "s")
    q = q.withColumns({"b": dealt("query", blocks), "s": every(shards)}).repartition(blocks * shards, "b", "s")
    d = own.groupBy("b", "s").cogroup(q.groupBy("b", "s")).applyInArrow(nearest_in(k), "query bigint, key bigint, distance double")
    w = Window.partitionBy("query").orderBy(F.asc_nulls_last("distance"), "key")
    kinds = [F.col(a).cast(t).alias(n) for a, n, t in (("query", "query", queries.schema[key].dataType), ("key", key, vectors.schema[key].dataType))]
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*kinds, "distance", "rank")


def by_length(keys: pa.ChunkedArray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, dict[int, tuple]]:
    """(keys in order, length of each's vector or -1, rows and matrix of each length)."""
    keys, col = np.asarray(keys), vectors.combine_chunks()
    order = np.argsort(keys, kind="stable")
    length = np.asarray(pc.fill_null(pc.list_value_length(col), -1)).astype(np.int64)
    owner, there = np.asarray(pc.list_parent_indices(col)), np.asarray(pc.is_valid(pc.list_flatten(col)))
    length[owner[~there]] = -1
    length = length[order]
    found = {}
    for n in np.unique(length[length >= 0]).tolist():
        rows = np.flatnonzero(length == n)
        flat = pc.list_flatten(col.take(pa.array(order[rows])))
        found[n] = rows, np.asarray(pc.cast(flat, pa.float64(), safe=False)).reshape(len(rows), n)
    return keys[order], length, found


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows of transposed matrices, added up from the first component on as ``dot`` does."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def nearest_in(k: int, rows_at_once: int = 2048, queries_at_once: int = 256):
    """The best ``k`` rows of each query in a shard.

    One matrix product for some rows and queries says which pairs may be among the best; the distances of these
    are then added up in one fixed order, so that equal vectors have equal distances wherever they lie.
    """

    def run(rows: pa.Table, queries: pa.Table):
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        with np.errstate(all="ignore"):
            return found(by_length(rows["key"], rows["v"]), by_length(queries["query"], queries["qv"]))

    def found(rows, queries):
        (keys, length, groups), (ids, q_length, q_groups) = rows, queries
        out = []
        for n in np.unique(q_length).tolist():
            at, q = q_groups[n] if n >= 0 else (np.flatnonzero(q_length < 0), None)
            other = keys[length != n] if n >= 0 else keys  # smaller keys first
            own = compared(groups[n], q) if n in groups else None
            for i in range(0, len(at), queries_at_once):
                some = at[i : i + queries_at_once]
                best = own(keys, ids[some], i) if own else None
                j, key, d = best or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                lack = np.flatnonzero(np.bincount(j, minlength=len(some)) < k) if len(other) else ()
                none = [other[other != ids[some[x]]][:k] for x in lack]
                out.append((ids[some[j]], key, d, np.zeros(len(j), bool)))
                out += [(np.full(len(x), ids[some[y]]), x, np.zeros(len(x)), np.ones(len(x), bool)) for x, y in zip(none, lack, strict=True)]
        query, key, d, null = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": pa.array(query.astype(np.int64)), "key": pa.array(key.astype(np.int64)), "distance": pa.array(d, mask=null)})

    def compared(group, q):
        """A function of (keys, ids, first): places of the queries from the first on, keys and distances of their best rows."""
        place, m = group
        m, q = np.ascontiguousarray(m.T), np.ascontiguousarray(q.T)
        mm, qq = summed(m, m), summed(q, q)
        plain, q_plain = ((x > 1e-200) & (x < 1e200) for x in (mm, qq))  # the product's error is bounded for these
        unit, q_unit = (np.where(ok, x / np.sqrt(xx), 0.0) for x, xx, ok in ((m, mm, plain), (q, qq, q_plain)))

        def best(keys, ids, first):
            span, own_keys = slice(first, first + len(ids)), keys[place]
            kth = np.full(len(ids), -np.inf)  # no less likeness is wanted
            j = key = np.zeros(0, np.int64)
            d = np.zeros(0)
            for i in range(0, len(place), rows_at_once):
                part = slice(i, i + rows_at_once)
                like, ok = unit[:, part].T @ q_unit[:, span], plain[part]
                low, high = (np.searchsorted(own_keys[part], ids, side) for side in ("left", "right"))
                for x in np.flatnonzero(high > low):
                    like[low[x] : high[x], x] = -np.inf
                if ok.sum() >= k:
                    kth = np.maximum(kth, np.partition(like[ok] if not ok.all() else like, -k, axis=0)[-k] - SLACK) if np.isneginf(kth).any() else kth
                near = like >= kth
                near[~ok], near[:, ~q_plain[span]] = True, True
                r, c = np.nonzero(near)
                apart = own_keys[part][r] != ids[c]
                r, c = r[apart] + i, c[apart]
                if not len(r):
                    continue
                exact = 1 - summed(m[:, r], q[:, c + first]) / np.sqrt(qq[c + first] * mm[r])
                j, key, d = np.concatenate([j, c]), np.concatenate([key, own_keys[r]]), np.concatenate([d, exact])
                order = np.lexsort((key, d, j))  # not a number comes last
                j, key, d = j[order], key[order], d[order]
                n = np.bincount(j, minlength=len(ids))
                rank = np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
                last = (rank == k - 1) & ~np.isnan(d)
                kth[j[last]] = np.maximum(kth[j[last]], 1 - d[last] - SLACK)
                j, key, d = j[rank < k], key[rank < k], d[rank < k]
            return j, key, d

        return best

    return run


def best_of(hits: list[DataFrame], key: str) -> DataFrame:
    """Each key's best score over the hits of several sub-queries (key, score)."""
    return reduce(DataFrame.unionByName, [h.select(key, "score") for h in hits]).groupBy(key).agg(F.max("score").alias("score"))


def merge(vector_hits: DataFrame, lexical_hits: DataFrame, key: str) -> DataFrame:
    """Keyed merge of both sides (key, score, distance, boost); a hit of both gains 0.15 of its weaker score, to 1 at most."""
    both = vector_hits.withColumn("v", F.col("score")).withColumn("l", F.lit(0.0)).unionByName(lexical_hits.withColumn("v", F.lit(0.0)).withColumn("l", F.col("score")))
    g = both.groupBy(key).agg(F.max("v").alias("v"), F.max("l").alias("l"), F.min(F.when(F.col("v") > 0, F.col("distance"))).alias("vd"), F.min("distance").alias("d"), F.max("boost").alias("boost"))
    top, low = F.greatest("v", "l"), F.least("v", "l")
    return g.select(key, F.when(low > 0, F.least(top + 0.15 * low, F.lit(1.0))).otherwise(top).alias("score"), F.coalesce("vd", "d").alias("distance"), "boost", (F.col("v") > 0).alias("has_vector"))


def _holds(c: Column, s: str) -> Column:
    return F.contains(c, F.lit(s)) if s else F.lit(False)


def _found(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(_holds(c, w), 1).otherwise(0) for w in words], F.lit(0))


def rerank(hits: DataFrame, text: Column, path: Column, headings: Column, anchor: Column, raw: str, focus: str, required: list[str]) -> DataFrame:
    """Adds combined, coverage, matched, exact and anchored to the hits of one query.

    ``raw`` is the whole query and ``focus`` its informative part, both in lower case;
    ``headings`` is an array. Words are looked for in path, headings and text; a hit is
    anchored if path, headings or the anchor label hold the focus or a required word.
    """
    h = F.lower(F.array_join(headings, " "))
    p, a = F.lower(path), F.lower(F.coalesce(anchor, F.lit("")))
    hay = F.lower(F.concat_ws(" ", path, F.array_join(headings, " "), text))
    n = max(1, len(required))
    exact, matched = _holds(hay, focus), _found(hay, required)
    cov = matched / F.lit(n)
    score = lambda c, x: F.when(c, x).otherwise(0.0)
    lexical = score(exact, 1.0) + (score(_holds(hay, raw), 0.3) if raw != focus else F.lit(0.0)) + 1.2 * cov
    places = [(p, 0.8, 0.35), (h, 0.6, 0.25), (a, 0.3, 0.1)]
    structural = reduce(lambda x, y: x + y, [score(_holds(c, focus), whole) + _found(c, required) / F.lit(n) * part for c, whole, part in places])
    anchored = reduce(lambda x, y: x | y, [_holds(c, focus) | (_found(c, required) > 0) for c, _, _ in places])
    combined = F.col("score") + 0.45 * lexical + 0.2 * structural + 0.25 * F.col("boost") + 0.15 * cov
    return hits.withColumns({"coverage": cov, "matched": matched, "exact": exact, "anchored": anchored, "combined": combined})


def retained(min_score: float, top: str = "top", text: str = "text") -> Column:
    """Whether a reranked hit stays, judged against the best hit (a struct column)."""
    best = lambda f: F.col(f"{top}.{f}")
    floor = F.when(best("score") >= 0.8, 0.6).when(best("score") >= 0.65, 0.5).when(best("score") >= 0.5, 0.4).otherwise(0.3)
    cov = F.when(best("coverage") >= 0.8, 0.75).when(best("coverage") >= 0.6, 0.5).otherwise(0.0)
    fair, strong = (best("coverage") >= 0.6) & (best("matched") >= 2), (best("coverage") >= 0.8) & (best("matched") >= 2)
    return (
        (F.col("score") >= F.greatest(F.lit(min_score), floor))
        & (F.col("combined") >= 0.7 * best("combined"))
        & (~(strong & best("has_vector")) | ~F.col("has_vector") | (F.col("distance") <= best("distance") + 0.12))
        & ~predicates.low_information(F.col(text))
        & ((F.col("coverage") >= cov) | F.col("exact"))
        & (~fair | F.col("exact") | F.col("anchored") | (F.col("matched") >= 1))
        & (~strong | F.col("anchored") | (F.col("matched") >= 2))
    )


def prune(hits: DataFrame, key: str, file: str, min_score: float, k: int, per_file: int = 2) -> DataFrame:
    """The hits that stay against the best one, then rounds over files in order of first appearance."""
    w = Window.orderBy(F.desc("combined"), "distance", key)
    # at most the candidates of one query: expansion bounds them
    r = hits.withColumn("r", F.row_number().over(w)).withColumn("top", F.max(F.when(F.col("r") == 1, F.struct("score", "combined", "coverage", "matched", "has_vector", "distance"))).over(Window.partitionBy(F.lit(0))))
    kept = r.where(retained(min_score))
    by = Window.partitionBy(file)
    kept = kept.withColumn("round", F.row_number().over(by.orderBy("r"))).withColumn("first", F.min("r").over(by)).where(F.col("round") <= per_file)
    return kept.withColumn("place", F.row_number().over(Window.orderBy("round", "first"))).where(F.col("place") <= k)

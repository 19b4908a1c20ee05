"""Connected components of an edge table, in DataFrames.

Every round gives each node the smallest label among its own and its neighbours' and
then follows labels once (pointer doubling), until nothing changes. Nodes, labels and
edges never leave the cluster: each round is written to the shared folder. Joins read
written tables on both sides, so a hub's rows can be split; minima are combined before
they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable."""
    both = store.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = store.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        hooked = store.put(near.unionByName(labels).groupBy("node").agg(F.min("root").alias("root")), "hooked")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = store.put(hooked.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        # the same nodes: equal sums of hashes of (node, root) mean that nothing has changed
        mark = F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("s")
        same = labels.agg(mark).first()[0] == after.agg(mark).first()[0]
        store.drop(hooked, labels)
        labels = after
        if same:
            store.drop(both)
            return labels

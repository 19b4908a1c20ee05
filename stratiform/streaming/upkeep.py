"""A corpus kept up to date by batches of watcher events.

Each batch is first written to a folder of its own, named by its writer and number, then
its chunks go into the postings, then the batch is named in the corpus' next version. A
batch that fails on the way is run again by the stream: what was written whole is
read and not made again, the postings know which batches they hold, and a batch that is
named changes nothing. So no chunk is lost or stands twice, wherever a writer stops.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import index
from ..operators.lexical import Postings
from ..sources.shared import located
from ..sources.versions import Versions

FILE = "path string, size_bytes bigint, modified_at_ms bigint, content_md5 string, fingerprint string, chunk_count bigint, gone boolean"
CHUNK = "path string, chunk_index int, chunk_text string, chunk_key bigint"


class Corpus:
    """Files, their chunks and the postings of these.

    ``chunk`` takes files (path, text) and gives (path, chunk_index, chunk_text).
    """

    def __init__(self, spark: SparkSession, folder: str, chunk: Callable[[DataFrame], DataFrame]):
        self.spark, self.chunk = spark, chunk
        self.versions = Versions(spark, f"{folder.rstrip('/')}/corpus")
        self.folder = self.versions.folder
        self.postings = Postings(spark, f"{folder.rstrip('/')}/postings", "chunk_key", {"chunk_text": 1.5})

    def state(self) -> dict:
        return self.versions.latest() or {"version": -1, "logs": [], "batches": {}, "keys": 0}

    def read(self, what: str, schema: str, logs: list[str]) -> DataFrame:
        """Rows of the logs with ``log``, the log's place in their order."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{n}/{what}").withColumn("log", F.lit(i)) for i, n in enumerate(logs)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, log int")

    def files(self, logs: list[str] | None = None) -> DataFrame:
        """The newest row of each path that is there, with the log that holds its chunks."""
        rows = self.read("files", FILE, self.state()["logs"] if logs is None else logs)
        newest = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "log").alias("f"))
        return newest.select("path", "f.*").where("not gone")

    def chunks(self, logs: list[str] | None = None, files: DataFrame | None = None, own: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The chunks of the files as they are now. ``own`` is done to the stored rows before they meet the files, where it may put less in place of their texts; it keeps path and log."""
        logs = self.state()["logs"] if logs is None else logs
        files = self.files(logs) if files is None else files
        return own(self.read("chunks", CHUNK, logs)).join(files.select("path", "log"), ["path", "log"]).drop("log")

    def apply(self, events: DataFrame, look: Callable[[DataFrame], DataFrame], batch: tuple[str, int]) -> bool:
        """Bring the paths of a batch of ``events`` (path) up to date; False if the batch has been applied.

        ``look(paths)`` gives what lies at paths now: path, text, size_bytes, modified_at_ms,
        content_md5, fingerprint, eligible, has_text.
        """
        state = self.state()
        if state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        logs, name = state["logs"], f"batch-{batch[0]}-{batch[1]:012d}"
        log = f"{self.folder}/{name}"
        fs, done = located(self.spark, f"{log}/chunks/_SUCCESS")
        if not fs.exists(done) or not fs.exists(located(self.spark, f"{log}/files/_SUCCESS")[1]):
            self.stage(events, look, logs, log, state["keys"])
        files, chunks = self.spark.read.schema(FILE).parquet(f"{log}/files"), self.spark.read.schema(CHUNK).parquet(f"{log}/chunks")
        old = self.chunks(logs, self.files(logs).join(files.select("path"), "path", "left_semi")) if logs else None
        self.postings.change(added=chunks.select("chunk_key", "chunk_text"), removed=old, batch=batch)
        self.versions.commit(state | {"logs": [*logs, name], "batches": state["batches"] | {batch[0]: batch[1]}, "keys": max(state["keys"], (chunks.agg(F.max("chunk_key")).first()[0] or 0) + 1)})
        return True

    def stage(self, events: DataFrame, look, logs: list[str], log: str, keys: int) -> None:
        """Write a batch's changed files and their chunks. Files whose content is the same keep the row and the chunks they have.

        Texts are moved and sorted by nothing but ``look``: plans meet them in hash tables of paths, and a chunk's key,
        from ``keys`` on, is that of its place in the writing tasks, so that keys are unique but not without gaps.
        """
        stored = self.files(logs)
        paths = events.select("path").where(F.col("path").isNotNull()).distinct()
        found = look(paths)
        plans = index.event_plans(paths, stored, found, "path")
        new = found.join(plans.where("plan in ('reindex', 'skip_marker')").select("path").hint("shuffle_hash"), "path", "left_semi")
        cut = self.chunk(new.where("has_text").select("path", "text")).select("path", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text")
        cut.withColumn("chunk_key", F.monotonically_increasing_id() + keys).write.mode("overwrite").parquet(f"{log}/chunks")
        counts = self.spark.read.schema(CHUNK).parquet(f"{log}/chunks").groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"))
        row = new.join(counts, "path", "left").select("path", "size_bytes", "modified_at_ms", "content_md5", "fingerprint", F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"), F.lit(False).alias("gone"))
        gone = plans.where("plan = 'delete'").select("path", *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in FILE.split(", ")[1:-1])], F.lit(True).alias("gone"))
        row.unionByName(gone).write.mode("overwrite").parquet(f"{log}/files")

    def follow(self, events: DataFrame, look: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, **trigger):
        """Apply each batch of a stream of ``events``; ``trigger`` as for a stream's writer. Gives the running query."""
        step = lambda rows, n: self.apply(rows, look, (name, n))
        return events.writeStream.foreachBatch(lambda rows, n: step(rows, n) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def merge(self) -> bool:
        """One log in place of all: files as they are now and their chunks. Postings stay."""
        state = self.state()
        if len(state["logs"]) < 2:
            return False
        name = self.versions.new("log")
        self.files(state["logs"]).select(*[x.split()[0] for x in FILE.split(", ")]).write.parquet(f"{self.folder}/{name}/files")
        self.chunks(state["logs"]).write.parquet(f"{self.folder}/{name}/chunks")
        self.versions.commit(state | {"logs": [name]})
        return True

    def search(self, phrases: list[list[str]], k: int, every: bool = False) -> DataFrame:
        """(path, chunk_index, rank) of the best chunks."""
        best = self.postings.top(phrases, k, every)
        return self.chunks().join(best, "chunk_key").select("path", "chunk_index", "rank")

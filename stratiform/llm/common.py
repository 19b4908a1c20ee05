"""What the operators of this package share: staged tables, batching, row identity."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows per Arrow batch sent to Python workers. Documents may be long, so batches are small.
ARROW_ROWS = 1000
#: Whether the shuffle files of a query go as soon as it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows up to which a staged table of short strings is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def session(spark: SparkSession) -> SparkSession:
    """Keep the batches that Python workers receive small. Returns ``spark``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def work_uri(spark: SparkSession) -> str:
    """A new folder (as a URI) under the cluster's ``spark.checkpoint.dir``.

    The setting is only made here where it is unset, which is right for local
    sessions such as tests; on a cluster an unset setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratiform-")
        spark.conf.set("spark.checkpoint.dir", root)
    # the full address, as workers must not take a bare path for one on their own disk
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    if full.startswith("file:/") and not full.startswith("file:///"):
        full = "file://" + full.removeprefix("file:")
    return f"{full.rstrip('/')}/stratiform-{uuid.uuid4().hex}"


class Store:
    """Tables written to one shared folder: they cut lineage and survive lost executors.

    Results read them, so the folder stays until the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.uri, self.n = spark, work_uri(spark), 0
        p = spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.uri}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        was = df.sparkSession.conf.get(CLEAN, "false")
        df.sparkSession.conf.set(CLEAN, "true")  # the table takes the place of the shuffles that made it
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            df.sparkSession.conf.set(CLEAN, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stratiform_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._stratiform_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def text_key(c: str) -> Column:
    """Stands for a whole text, together with the row's own id."""
    return F.xxhash64(text_or_empty(c))


def release() -> None:
    """Give freed memory back to the system: Python workers stay for later stages, beside a JVM that needs the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches, most: int = 8 << 20, rows: int = 4096):
    """Cut Arrow batches so that each holds about ``most`` bytes at the most; after the last, freed memory is released."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(rows, int(b.num_rows * most / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    release()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The staged table with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if within(df, rows) else df


def within(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows

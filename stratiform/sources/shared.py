"""Folders for stored tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted when the driver ends; only local sessions may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratiform-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = located(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def located(spark: SparkSession, uri: str):
    """(file system, path) of an address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names_in(spark: SparkSession, uri: str) -> list[str]:
    fs, path = located(spark, uri)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def text_of(spark: SparkSession, uri: str) -> str:
    fs, path = located(spark, uri)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, uri: str, text: str) -> bool:
    """Write a small file that must not exist yet; readers see all of it or nothing. False if another writer was first."""
    jvm = spark._jvm
    fs, draft = located(spark, f"{uri}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without leave to overwrite
    try:
        files.rename(draft, located(spark, uri)[1], plain)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def stamp(df: DataFrame) -> tuple:
    """Names, sizes and times of the files behind a table, which change when it does."""
    out = []
    for f in sorted(df.inputFiles()):
        fs, path = located(df.sparkSession, f)
        status = fs.getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return tuple(out)


def built(df: DataFrame, name: str, build) -> str:
    """The folder that ``build(df, folder)`` has filled for this state of the table, made on first use."""
    key = (df.sparkSession.sparkContext.applicationId, name, stamp(df))
    if key not in _BUILT:
        folder = shared_folder(df.sparkSession, name)
        build(df, folder)
        _BUILT[key] = folder
    return _BUILT[key]

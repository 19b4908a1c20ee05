"""A data source that lists the files of a folder tree, a task for each of some folders.

``spark.dataSource.register(FolderWalk)``, then ``spark.read.format("folder_walk").load(root)``: path,
size_bytes, modified_at_ms, and text, which is read of rule files only. Driver and executors must see the tree
under the same path; links are not followed. With the option ``scope`` only a folder of the
tree is listed, and of the folders above it their rule files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAMES = (".ignore", ".gitignore")


def row(path: str) -> tuple:
    s = os.stat(path, follow_symlinks=False)
    text = None
    if path.endswith(tuple("/" + n for n in (*NAMES, ".git/info/exclude"))):
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
    return path, s.st_size, s.st_mtime_ns // 1_000_000, text


def entries(folder: str) -> tuple[list[str], list[str]]:
    """(files, folders) in a folder; none if it went meanwhile or can't be read."""
    try:
        with os.scandir(folder) as it:
            own = sorted((e.path, e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)) for e in it)
    except OSError:
        return [], []
    return [p for p, _, f in own if f], [p for p, d, _ in own if d]


class Folder(InputPartition):
    def __init__(self, folder: str, deep: bool, only_rules: bool = False):
        super().__init__(folder)
        self.folder, self.deep, self.only_rules = folder, deep, only_rules


class Walk(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.scope = os.path.abspath(options.get("scope", self.root))
        self.tasks = int(options.get("tasks", "64"))

    def partitions(self):
        """Folders are opened, the shallowest first, until there are enough of them for the tasks."""
        out, todo = [], [self.scope]
        while todo and len(todo) < self.tasks:
            now = todo.pop(0)
            out.append(Folder(now, False))
            todo += entries(now)[1]
        out += [Folder(f, True) for f in todo]
        above = self.scope
        while above != self.root and above.startswith(self.root):
            above = os.path.dirname(above)
            out.append(Folder(above, False, True))
        if self.scope != self.root:
            out.append(Folder(f"{self.root}/.git/info", False, True))
        return out

    def read(self, partition):
        todo = [partition.folder]
        while todo:
            files, folders = entries(todo.pop())
            for f in files:
                if partition.only_rules and os.path.basename(f) not in (*NAMES, "exclude"):
                    continue
                try:
                    yield row(f)
                except OSError:
                    continue  # it went meanwhile
            todo += folders if partition.deep else []


class FolderWalk(DataSource):
    @classmethod
    def name(cls):
        return "folder_walk"

    def schema(self):
        return "path string, size_bytes bigint, modified_at_ms bigint, text string"

    def reader(self, schema):
        return Walk(self.options)


def walk(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(FolderWalk)
    return spark.read.format("folder_walk").options(**options).load(root)

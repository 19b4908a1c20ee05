"""Versions of a stored index: a small file for each, written once it is whole.

Data folders have new names and are never changed. A writer that fails leaves folders that no
version names; of two writers on the same version, one is told that it was late.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from . import shared


class Late(RuntimeError):
    """Another writer has made the next version; read it and do the work again."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def all(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in shared.names_in(self.spark, f"{self.folder}/versions") if n.endswith(".json"))

    def latest(self) -> dict | None:
        have = self.all()
        return json.loads(shared.text_of(self.spark, self.path(have[-1]))) if have else None

    def path(self, n: int) -> str:
        return f"{self.folder}/versions/v{n:012d}.json"

    def commit(self, state: dict) -> None:
        """Make ``state`` the version after the one that it was read from."""
        state = state | {"version": state["version"] + 1}
        if not shared.put_new(self.spark, self.path(state["version"]), json.dumps(state)):
            raise Late(self.path(state["version"]))

    def new(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def clean(self, named: set[str]) -> list[str]:
        """Delete data folders that the latest version does not name, and all versions before it. No reader or writer may be at work."""
        gone = []
        for n in shared.names_in(self.spark, self.folder):
            if n != "versions" and n not in named:
                fs, path = shared.located(self.spark, f"{self.folder}/{n}")
                fs.delete(path, True)
                gone.append(n)
        for v in self.all()[:-1]:
            fs, path = shared.located(self.spark, self.path(v))
            fs.delete(path, False)
        return gone

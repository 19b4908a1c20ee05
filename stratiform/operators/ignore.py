"""Which files of a tree its rule files leave out.

A rule file (``.ignore``, ``.gitignore`` or a repository's ``info/exclude``) speaks of what lies below its folder.
For each file and each folder on its way, the rule that decides is the one of the highest
file kind (in the order above), of the deepest folder, and the last line that matches. Nothing
below a folder that is left out comes back. Rules meet entries by equal joins on folders.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .paths import FEW, plain, way

# Names of rule files, the ones that count most first, and parts of paths that are never listed.
KINDS = (".ignore", ".gitignore", ".git/info/exclude")
NEVER = ("/.git/", "/node_modules/", "/target/", "/.Trash/", "/Library/Caches/", "/Library/Containers/", "/.npm/", "/.cargo/registry/", "/.cache/")
RULE = StructType([StructField("pattern", StringType()), StructField("again", BooleanType()), StructField("folders", BooleanType())])


def translate(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression on the part of a path below the rule's folder, whether it lets in again, whether it is about folders only)."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    again = line.startswith("!")
    line = line[1:] if again else line
    folders = line.endswith("/") and not line.endswith("\\/")
    line = line.rstrip("/") if folders else line
    if not line:
        return None
    anchored, line = "/" in line, line.removeprefix("/")
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
            while i < len(line) and line[i] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end]
            no = inner[0] in "!^"
            inner = (inner[1:] if no else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + f"(?!/)[{'^' if no else ''}{inner}]", end + 1
        else:
            if c == "\\" and i + 1 < len(line):
                i += 1
                c = line[i]
            out, i = out + (c if c.isalnum() else "\\" + c if ord(c) < 128 else c), i + 1
    return f"^{out}$", again, folders


@F.pandas_udf(RULE)
def translated(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([translate(x) or (None, None, None) for x in lines], columns=["pattern", "again", "folders"])


def rules(files: DataFrame, repository: bool = True) -> DataFrame:
    """(folder, kind, line_no, pattern, again, folders) of the rule files among ``files`` (path, text). Outside a repository only ``.ignore`` counts."""
    kinds = KINDS if repository else KINDS[:1]
    kind, folder = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(kinds))):
        own = F.endswith("path", F.lit("/" + name))
        kind, folder = F.when(own, i).otherwise(kind), F.when(own, F.substr("path", F.lit(1), F.length("path") - len(name) - 1)).otherwise(folder)
    lines = files.select(folder.alias("folder"), kind.alias("kind"), "text").where("kind is not null and text is not null")
    lines = lines.select("folder", "kind", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("folder", "kind", "line_no", translated("line").alias("r")).select("folder", "kind", "line_no", "r.*").where("pattern is not null")


def kept(files: DataFrame, given: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The rows whose files the rules let in. Files outside ``root`` and those with a part that is never listed go.

    Rules of folders above the root count too, as far as ``given`` has them.
    """
    root = root.rstrip("/")
    never = "|".join(re.escape(x) for x in NEVER)
    rows = files.where(F.startswith(path, F.lit(root + "/")) & ~F.col(path).rlike(never))
    own = F.filter(way(plain(F.col(path))), lambda p: F.length(p) > len(root))
    entries = rows.select(F.explode(own).alias("entry"), F.col(path).alias("file")).select("entry", (F.col("entry") != F.col("file")).alias("folder_")).groupBy("entry").agg(F.max("folder_").alias("is_folder"))
    up = F.transform(way(F.col("entry")), lambda p: p)
    above = entries.select("entry", "is_folder", F.explode(F.slice(up, F.lit(1), F.size(up) - 1)).alias("folder"))
    given = F.broadcast(given) if given.limit(FEW + 1).count() <= FEW else given
    met = above.join(given, "folder").where((~F.col("folders") | F.col("is_folder")) & F.expr("rlike(substr(entry, length(folder) + 2), pattern)"))
    last = met.groupBy("entry").agg(F.min_by("again", F.struct("kind", -F.length("folder"), -F.col("line_no"))).alias("again"))
    out = last.where("not again").select("entry")
    gone = rows.select(path).distinct().withColumn("entry", F.explode(own)).join(out, "entry", "left_semi").select(path)
    return rows.join(gone, path, "left_anti")


def rescanned(records: DataFrame, found: DataFrame, scope: str, path: str = "path") -> DataFrame:
    """``records`` with what lies in ``scope`` replaced by what was found there."""
    inside = lambda d: (F.col(path) == scope) | F.startswith(path, F.lit(scope.rstrip("/") + "/"))
    return records.where(~inside(records)).unionByName(found.where(inside(found)))

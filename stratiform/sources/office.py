"""Word documents as Markdown; pages of text that a PDF tool has extracted."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

MOST = 16 << 20


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _kids(e, name: str):
    return [c for c in e if _name(c) == name]


def _value(e, key: str = "val") -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == key), "")


def level(style: str) -> int:
    """Heading level that a style's name or id states, or 0."""
    m = re.fullmatch(r"heading([0-9]+)", re.sub(r"[\s_-]", "", style).lower())
    return int(m[1]) if m else 0


def heading_styles(xml: bytes) -> dict[str, int]:
    out = {}
    for s in ElementTree.fromstring(xml).iter():
        if _name(s) == "style" and _value(s, "type") == "paragraph" and (own := _value(s, "styleId")):
            named = [level(_value(n)) for n in _kids(s, "name")]
            if n := level(own) or (named[0] if named else 0):
                out[own.lower()] = n
    return out


def paragraph(p, styles: dict[str, int], plain: bool = False) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    props = _kids(p, "pPr")[:1]
    # tab stops among the properties are no text
    skip = {id(e) for x in props for e in x.iter()}
    raw = "".join(e.text or "" if _name(e) == "t" else marks.get(_name(e), "") for e in p.iter() if id(e) not in skip)
    text = "\n".join(x for x in map(str.strip, raw.replace("\xa0", " ").splitlines()) if x)
    if not text or plain or not props:
        return text
    style = next((_value(s) for s in _kids(props[0], "pStyle")), "")
    if n := styles.get(style.lower()) or level(style):
        return "#" * min(n, 6) + " " + text
    return "- " + text if any(_name(e) == "numPr" for e in props[0].iter()) else text


def blocks(node, styles: dict[str, int]):
    for c in node:
        if _name(c) == "p":
            yield paragraph(c, styles)
        elif _name(c) == "tbl":
            for row in _kids(c, "tr"):
                cells = [" / ".join(filter(None, (paragraph(p, styles, True) for p in _kids(cell, "p")))) for cell in _kids(row, "tc")]
                yield " | ".join(filter(None, cells))
        else:
            yield from blocks(c, styles)


def docx_text(content: bytes) -> str | None:
    """Markdown of a Word document; None if it is broken or has no text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            styles = heading_styles(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else {}
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    body = next((e for e in root.iter() if _name(e) == "body"), None)
    return "\n\n".join(filter(None, map(str.strip, blocks(body, styles)))) or None if body is not None else None


@F.pandas_udf(StringType())
def read_docx(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: docx_text(bytes(c)), na_action="ignore")


def docx_files(spark: SparkSession, root: str) -> DataFrame:
    """Word documents of a tree; the size limit and the name filter reach the scan."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(root)
    return f.where(F.col("length") <= MOST).select("path", F.col("length").alias("size_bytes"), read_docx("content").alias("text"))

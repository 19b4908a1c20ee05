"""Python work on rows of long texts or arrays, some megabytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a batch that become Python objects together, about.
MOST = 2 << 20


def frames(batches, most: int = MOST) -> Iterator[pd.DataFrame]:
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            # nbytes may count what lies outside the slice only roughly, a row alone may be larger
            yield b.slice(i, step).to_pandas()


def release() -> None:
    """Give freed memory back to the system: Python workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Like ``mapInPandas``, but ``run`` is given frames of some megabytes, however many rows a batch has."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches):
        for f in run(frames(batches)):
            if len(f):
                yield pa.RecordBatch.from_pandas(f, schema=kind, preserve_index=False)
        release()

    return df.mapInArrow(mapped, schema)

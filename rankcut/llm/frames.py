"""Small helpers on tables with any columns."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame


def numbered(df: DataFrame) -> DataFrame:
    """The same table with columns ``_c0, _c1, ...``, so that no name of it clashes with a name added later."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def number_of(df: DataFrame, column: str) -> str:
    """The name ``numbered`` gives to a column."""
    return f"_c{df.columns.index(column)}"


def release() -> None:
    """Give memory that is held for reuse back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)

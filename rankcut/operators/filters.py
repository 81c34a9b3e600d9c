"""Predicates and conditional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cutoff_window(df: DataFrame, col: str, cutoff: Column | int, half_width: Column | int) -> DataFrame:
    """Rows with ``cutoff - half_width <= col < cutoff + half_width``."""
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    half_width = half_width if isinstance(half_width, Column) else F.lit(half_width)
    return df.where((F.col(col) >= cutoff - half_width) & (F.col(col) < cutoff + half_width))


def above_cutoff(df: DataFrame, col: str, cutoff: int) -> DataFrame:
    return df.where(F.col(col) >= cutoff)


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL or NaN."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(keep)


def at_global_max(df: DataFrame, col: str) -> DataFrame:
    """Rows at the maximum of ``col`` over the whole frame (a scalar subquery)."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def override(df: DataFrame, col: str, condition: Column, value: Column) -> DataFrame:
    """Replace ``col`` where ``condition`` holds."""
    return df.withColumn(col, F.when(condition, value).otherwise(F.col(col)))

"""Array expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(col: Column, n: Column) -> Column:
    """Last ``n`` elements; the whole array when ``n`` is NULL or exceeds its size, empty when ``n`` is 0."""
    size = F.size(col)
    keep = F.coalesce(F.least(size, n.cast("int")), size)
    return F.slice(col, size - keep + 1, keep)


def index_range(col: Column) -> Column:
    """``[0, 1, ..., size-1]``; empty for an empty array."""
    return F.transform(col, lambda _, i: i.cast("long"))


def left_pad(col: Column, length: Column, value: Column) -> Column:
    """Prepend ``value`` until the array has ``length`` elements."""
    missing = F.greatest(length.cast("int") - F.size(col), F.lit(0))
    return F.concat(F.array_repeat(value, missing), col)


def array_mean(col: Column) -> Column:
    """Mean of the non-NULL elements; NULL when there are none."""
    present = F.filter(col, lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(present) > 0, total / F.size(present))


def explode_together(df: DataFrame, arrays: list[str], pos: str | None = None, outer: bool = False) -> DataFrame:
    """Explode several equally long arrays in step, optionally with the element position.

    Unequal lengths raise an error instead of padding with NULL.
    """
    first = F.size(arrays[0])
    zipped = F.arrays_zip(*arrays)
    if len(arrays) > 1:
        same = F.lit(True)
        for name in arrays[1:]:
            same = same & (F.size(name) == first)
        message = f"arrays {arrays} differ in length"
        zipped = F.when(F.coalesce(same, F.lit(True)), zipped).otherwise(F.raise_error(F.lit(message)))
    explode = F.posexplode_outer if outer else F.posexplode
    others = [c for c in df.columns if c not in arrays]
    out = df.select(*others, explode(zipped).alias("_pos", "_row"))
    columns = [F.col(f"_row.{a}").alias(a) for a in arrays]
    if pos:
        columns.append(F.col("_pos").cast("long").alias(pos))
    return out.select(*others, *columns)

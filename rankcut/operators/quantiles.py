"""Exact order statistics per group, spread over tasks by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.session import stage

def order_statistics(
    df: DataFrame, keys: list[str], value: str, index: dict[str, Column], extra: list[Column] = (), slices: int | None = None
) -> DataFrame:
    """Per group, the value at each 0-based sorted ``index`` (expressions over the group size ``n``).

    Equal values are merged first. The rest is range-partitioned by group and value into ``slices`` (default: the session's
    shuffle partitions), so slices are even however groups and values are skewed. Counts per slice locate the slice of every
    requested index; only the rows of those slices are ranked. NULL values and rows with a NULL key are ignored.
    ``extra`` adds ordinary aggregates of a first pass.
    """
    present = F.col(value).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    rows = df.where(present)
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), *extra)
    merged = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    dealt = merged.repartitionByRange(slices, *keys, "_v") if slices else merged.repartitionByRange(*keys, "_v")
    pinned = stage(dealt.withColumn("_slice", F.spark_partition_id()), "slices")  # ranges are drawn from a sample
    per_slice = pinned.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_c"))
    by_slice = W.partitionBy(*keys).orderBy("_slice")
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), e.cast("long").alias("at")) for k, e in index.items()])
    inside = lambda t: (t["at"] >= F.col("_end") - F.col("_c")) & (t["at"] < F.col("_end"))
    located = (
        per_slice.withColumn("_end", F.sum("_c").over(by_slice))
        .withColumn("n", F.sum("_c").over(W.partitionBy(*keys)))
        .select(*keys, "_slice", (F.col("_end") - F.col("_c")).alias("_start"), F.filter(wanted, inside).alias("_wants"))
        .where(F.size("_wants") > 0)
    )
    in_order = W.partitionBy(*keys, "_slice").orderBy("_v")
    found = (
        pinned.join(located, [*keys, "_slice"])
        .withColumn("_end", F.col("_start") + F.sum("_c").over(in_order))
        .select(*keys, "_v", F.explode(F.filter("_wants", inside)).alias("_want"))
    )
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_want.name") == k, F.col("_v"))).alias(k) for k in index])
    return stats.join(picked, keys)


def nearest_index(q: float) -> Column:
    """Index of the "nearest" quantile among ``n`` sorted values."""
    return F.floor((F.col("n") - 1) * F.lit(float(q)) + F.lit(0.5))


def nearest_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], extra: list[Column] = (), slices: int | None = None
) -> DataFrame:
    """Quantiles without interpolation: the element at ``floor((n-1)q + 1/2)``."""
    return order_statistics(df, keys, value, {k: nearest_index(q) for k, q in quantiles.items()}, extra, slices)


def linear_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], extra: list[Column] = (), slices: int | None = None
) -> DataFrame:
    """Quantiles interpolated between the elements on either side of ``(n-1)q``."""
    place = {k: (F.col("n") - 1) * F.lit(float(q)) for k, q in quantiles.items()}
    sides = {f"_low_{k}": F.floor(at) for k, at in place.items()} | {f"_high_{k}": F.ceil(at) for k, at in place.items()}
    found = order_statistics(df, keys, value, sides, extra, slices)
    low = {k: F.col(f"_low_{k}") for k in quantiles}
    between = {k: low[k] + (F.col(f"_high_{k}") - low[k]) * (at - F.floor(at)) for k, at in place.items()}
    return found.withColumns(between).drop(*sides)

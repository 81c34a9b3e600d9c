"""Order-dependent operators that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.session import stage

# monotonically_increasing_id keeps the row number inside its partition in the low 33 bits.
_ROW_MASK = (1 << 33) - 1

# Tasks over which the rows of one group are spread when they meet a per-group table.
SALTS = 32

# Per-group tables of up to this many (narrow) rows are broadcast after they have been counted.
BROADCAST_GROUPS = 400_000

# Rows that a per-group table may grow to by its copies.
COPIED_ROWS = 6_400_000

# Rows that one task may merge and hand on as the first rows of a table.
TOP_ROWS = 10_000


def neighbours(df: DataFrame, keys: list[str], pos: str, value: str, block: int = 1 << 16) -> DataFrame:
    """Add ``prev`` and ``next``: ``value`` at the positions before and after, within ``keys``.

    Positions must be unique per key. A key is cut into blocks of ``block`` positions and every block
    borrows one row from each side, so a key that holds most of the rows is still spread over tasks.
    """
    b = F.floor(F.col(pos) / block)
    r = F.col(pos) % block
    home = F.struct(b.alias("_block"), F.lit(False).alias("_guest"))
    before = F.when(r == 0, F.struct((b - 1).alias("_block"), F.lit(True).alias("_guest")))
    after = F.when(r == block - 1, F.struct((b + 1).alias("_block"), F.lit(True).alias("_guest")))
    spread = df.select("*", F.inline(F.array_compact(F.array(home, before, after))))
    w = W.partitionBy(*keys, "_block").orderBy(pos)
    return (
        spread.select(
            "*",
            F.when(F.lag(pos).over(w) == F.col(pos) - 1, F.lag(value).over(w)).alias("prev"),
            F.when(F.lead(pos).over(w) == F.col(pos) + 1, F.lead(value).over(w)).alias("next"),
        )
        .where(~F.col("_guest"))
        .drop("_block", "_guest")
    )


def row_index(df: DataFrame, order: list[Column], name: str = "idx", start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in ``order`` without a global window.

    Range-partition and sort, stage the sorted slices, count rows per slice, add the slice offsets.
    Only one count per slice meets in a single task.
    """
    sorted_slices = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(sorted_slices.withColumn("_mid", F.monotonically_increasing_id()), "row_index")
    staged = staged.withColumn("_slice", F.shiftright("_mid", 33))
    slices = staged.groupBy("_slice").agg(F.count("*").alias("_n"))
    offsets = slices.select(
        "_slice",
        (F.sum("_n").over(W.orderBy("_slice")) - F.col("_n")).alias("_offset"),
    )
    return (
        staged.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_mid").bitwiseAND(F.lit(_ROW_MASK)) + F.col("_offset") + start)
        .drop("_mid", "_slice", "_offset")
    )


def number_rows(df: DataFrame, order: list[str], name: str = "idx", start: int = 0) -> DataFrame:
    """``row_index`` by columns that identify a row: only these columns are sorted and staged.

    Wide rows move once, in the join that brings the numbers back, and are computed once. NULL is a value like any
    other; the query fails if two rows have equal ``order`` columns.
    """
    numbers = row_index(df.select(*order), [F.col(c) for c in order], name, start)
    named = [f"_o{i}" for i in range(len(order))]
    single = numbers.groupBy(*[F.col(c).alias(n) for c, n in zip(order, named)]).agg(F.min(name).alias(name), F.count("*").alias("_rows"))
    single = single.where(F.assert_true(F.col("_rows") == 1, f"two rows have equal {', '.join(order)}").isNull()).drop("_rows")
    same = F.lit(True)
    for c, n in zip(order, named):
        same = same & df[c].eqNullSafe(F.col(n))
    return df.join(single, same).drop(*named)


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS, staged: bool = False, bound: int = BROADCAST_GROUPS
) -> DataFrame:
    """Join rows with a table of one row per group (NULL keys match each other).

    The group table is staged (unless it already is) and counted. Up to ``bound`` groups are broadcast, and the rows stay
    where they are. Beyond that the table is repeated up to ``salts`` times, but not beyond ``COPIED_ROWS`` rows, and every row
    picks one copy, so that a group holding most of the rows is spread over that many tasks. A table too large for copies is merged as
    it is; hot groups are then left to the engine's skew handling.
    """
    table = groups if staged else stage(groups, "groups")
    named = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    theirs = [f"_{k}" for k in keys]
    size = table.count()
    if size <= bound:
        return rows.join(F.broadcast(named), condition, how).drop(*theirs)
    salts = max(1, min(salts, COPIED_ROWS // size))
    if salts == 1:
        return rows.join(named.hint("merge"), condition, how).drop(*theirs)
    # The planner sees the files of the table, not its copies, and must not broadcast these.
    copies = named.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).hint("merge")
    # The copy depends on the row alone, so a recomputed task deals its rows as before.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    return salted.join(copies, condition & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy", *theirs)


def with_group_aggregates(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Attach group aggregates to every row.

    A partial aggregation and a join back: a window would put each group into one task.
    """
    return join_groups(df, df.groupBy(*keys).agg(*aggregates), keys, "left")


def top_k(df: DataFrame, order: list[Column], k: int, bound: int = TOP_ROWS) -> DataFrame:
    """First ``k`` rows in ``order``: up to ``bound`` rows, each task keeps k and one merges them; beyond, rows are numbered."""
    if k <= bound:
        return df.orderBy(*order).limit(k)
    return row_index(df, order, "_rank").where(F.col("_rank") < k).drop("_rank")

"""Repeated substrings of a word table, from a range-sorted suffix table.

Every position of a word gives one row, its suffix cut after ``max_chars + 1`` characters. Equal rows are counted, then
sorted over range partitions. Along the sorted rows the common prefix of neighbours tells where a substring begins and ends
to be shared (its interval): one pass with a stack of open prefixes per partition. A substring whose interval touches the
border of a partition is reported in parts, at most ``max_chars`` on either side, which are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\0"  # closes a suffix that reaches the end of its word; sorts before every other character
STRETCH = 512  # characters of a word that are cut into substrings at a time


def positions(words: DataFrame, width: int) -> DataFrame:
    """One row per position of ``w``: ``at`` and the up to ``width`` characters from there (``here``), beside the other columns.

    Long words are first cut into overlapping stretches, since finding a character in a string takes time by its position.
    """
    size = F.length("w")
    starts = F.sequence(F.lit(0), F.floor((size - 1) / STRETCH).cast("int"))
    stretches = words.where(size > 0).withColumn("_base", F.explode(starts)).withColumn("_base", F.col("_base") * STRETCH)
    stretches = stretches.withColumn("_stretch", F.substring(F.col("w"), F.col("_base") + 1, F.lit(STRETCH + width)))
    inside = F.sequence(F.lit(0), F.least(F.lit(STRETCH), F.length("w") - F.col("_base")) - 1)
    rows = stretches.withColumn("_offset", F.explode(inside))
    here = F.substring(F.col("_stretch"), F.col("_offset") + 1, F.lit(width))
    return rows.withColumn("at", F.col("_base") + F.col("_offset")).withColumn("here", here).drop("_base", "_stretch", "_offset")


def _suffix(max_chars: int) -> Column:
    ends = F.length("w") - F.col("at") <= max_chars
    return F.when(ends, F.concat("here", F.lit(END))).otherwise(F.col("here"))


_INTERVAL = "piece string, n long, low string, high string, open boolean"


def _intervals(max_chars: int):
    """Streams sorted distinct ``(suffix, n)`` to the shared prefixes of two characters or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, first, total = "", "", 0
        began = [0] * (max_chars + 2)  # rows before the first that has the present prefix of a length
        low = [""] * (max_chars + 2)  # the character that followed it there
        out: list[tuple] = []

        def close(longest: int, shared: int, at_end: bool) -> None:
            for d in range(max(shared + 1, 2), longest + 1):
                piece, high = previous[:d], previous[d : d + 1]
                is_open = at_end or first.startswith(piece)
                if high and (is_open or low[d] < high):  # the whole suffix is no shared prefix
                    out.append((piece, total - began[d], low[d], high, is_open))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["piece", "n", "low", "high", "open"])

        for batch in batches:
            for suffix, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shared, most = 0, min(len(suffix), len(previous))
                while shared < most and suffix[shared] == previous[shared]:
                    shared += 1
                close(min(len(previous) - 1, max_chars), shared, False)
                for d in range(shared + 1, min(len(suffix) - 1, max_chars) + 1):
                    began[d], low[d] = total, suffix[d]
                first = first or suffix
                previous, total = suffix, total + n
            yield batch_of(out)
            out = []
        close(min(len(previous) - 1, max_chars), 0, True)
        yield batch_of(out)

    return scan


def repeated_substrings(words: DataFrame, max_chars: int) -> DataFrame:
    """``(piece, n)``: the substrings of 2 to ``max_chars`` characters that different characters follow, with their occurrences.

    ``words`` has distinct words ``w``; the end of a word counts as a character. These are the inner nodes of the words'
    suffix tree: a substring that the same character always follows is left to the longer one.
    """
    suffixes = positions(words.select("w"), max_chars + 1).select(_suffix(max_chars).alias("s"))
    counted = suffixes.groupBy("s").agg(F.count("*").alias("n"))
    found = counted.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(_intervals(max_chars), _INTERVAL)
    parts = found.groupBy("piece").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return parts.where(F.col("low") < F.col("high")).select("piece", "n")

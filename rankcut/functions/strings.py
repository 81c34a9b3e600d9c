"""String and label expressions with strict failure rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_last(col: Column, sep: str) -> Column:
    return F.element_at(F.split(col, f"\\Q{sep}\\E"), -1)


def split_first(col: Column, sep: str) -> Column:
    return F.get(F.split(col, f"\\Q{sep}\\E"), F.lit(0))


def strip_prefix(col: Column, prefix: str) -> Column:
    return F.when(col.startswith(prefix), F.substring(col, len(prefix) + 1, 1 << 30)).otherwise(col)


def strip_suffix(col: Column, suffix: str) -> Column:
    trimmed = F.substring(col, F.lit(1), F.length(col) - len(suffix))
    return F.when(col.endswith(suffix), trimmed).otherwise(col)


def extract_group(col: Column, pattern: str, group: int = 1) -> Column:
    """One regex group; NULL (not the empty string) when the pattern does not match."""
    return F.when(F.regexp_like(col, F.lit(pattern)), F.regexp_extract(col, pattern, group))


def extract_last(col: Column, pattern: str) -> Column:
    """Last match of ``pattern``; NULL when there is none."""
    return F.try_element_at(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), F.lit(-1))


def longest_digit_run(col: Column) -> Column:
    """Longest run of digits, the first one on ties; NULL when there is none."""
    runs = F.regexp_extract_all(col, F.lit(r"\d+"), F.lit(0))
    best = F.aggregate(runs, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    return F.nullif(best, F.lit(""))


def _fail(col: Column, what: str, result_type: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown {what}: "), col.cast("string"))).cast(result_type)


def strict_lookup(col: Column, mapping: dict) -> Column:
    """Translate through a small dictionary; an unknown non-NULL key fails the query."""
    out = F.when(col.isNull(), F.lit(None).cast("string"))
    for key, value in mapping.items():
        out = out.when(col == F.lit(key), F.lit(value))
    return out.otherwise(_fail(col, "key", "string"))


def ordinal(col: Column, labels: list[str]) -> Column:
    """Rank of a label in an ordered category; an unknown non-NULL label fails the query."""
    out = F.when(col.isNull(), F.lit(None).cast("int"))
    for i, label in enumerate(labels):
        out = out.when(col == F.lit(label), F.lit(i))
    return out.otherwise(_fail(col, "label", "int"))

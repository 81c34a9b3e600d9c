"""Periodic runs of words: stretches that repeat a unit of words several times over.

A dictionary of basic factors names every factor whose length is a power of two, so that two factors are equal exactly when
their names are. The successor of a factor is its next occurrence in the same text; where one occurrence follows the other
at an equal distance not above twice the factor's length, the occurrences form an arithmetic progression and propose their
distance as a period. A proposal is extended to both sides by comparing factors of halving length, and equal runs that
several proposals lead to are kept once.

With at least four repetitions a run of smallest period q holds, for the power of two L with L/2 < q <= L, a factor of
length L that occurs three times at distance q, and no nearer (two periods on so long a stretch would have a common
divisor as period). So every run is proposed. And a distance that is not the smallest period of the run it leads to is not
proposed, since the factor would have a nearer successor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankcut.llm.frames import numbered
from rankcut.llm.text import EXACT_WORDS, GROUP, column_bytes, groups, words

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

MIN_REPEATS = 4  # below this, the smallest period of a run need not be proposed (see above)


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by ``keys`` (first key first, ties by position), and whether a row differs from the one before it."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = False
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    return order, fresh


def basic_factors(names: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per power of two: the length, the name of the factor at every position, and the repeated factors with their successors.

    ``names``: a number per word, ``rows``: the (ascending) text of each word. Names are equal for equal factors of one text.
    A factor that occurs once in its text gets a name of its own, below zero, so only repeated ones are sorted for the next
    length; the last length is the first at which nothing repeats.
    """
    n = len(names)
    alone = (-1 - np.arange(n)).astype(np.int32 if n < 1 << 31 else np.int64)
    order, fresh = _ranked(rows, names)
    length, here = 1, np.arange(n)
    while True:
        at = here[order]
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(at)))
        repeated = np.repeat(sizes > 1, sizes)
        name = alone.copy()
        name[at[repeated]] = np.cumsum(fresh)[repeated]
        later = np.flatnonzero(~fresh)
        yield length, name, at[later - 1], at[later]
        here = np.flatnonzero(name >= 0)
        here = here[here + 2 * length <= n]
        here = here[(name[here + length] >= 0) & (rows[here + 2 * length - 1] == rows[here])]
        if not len(here):
            return
        order, fresh = _ranked(name[here], name[here + length])
        length *= 2


def runs_of(names: np.ndarray, rows: np.ndarray, repeats: int, least: int) -> np.ndarray:
    """All maximal runs of the texts as rows (first word, length, period), by first word and period; see ``find_runs``."""
    n = len(names)
    tables: list[np.ndarray] = []
    proposed: list[np.ndarray] = []
    for length, name, before, after in basic_factors(names, rows):
        tables.append(name)
        gap = np.zeros(n, dtype=np.int64)
        gap[before] = after - before
        near = np.flatnonzero((gap > length // 2) & (gap <= 2 * length))
        near = near[gap[near + gap[near]] == gap[near]]  # three occurrences in arithmetic progression
        if len(near):
            # Neighbouring positions with one gap lie in one run: its first position proposes it.
            head = np.ones(len(near), dtype=bool)
            head[1:] = (near[1:] != near[:-1] + 1) | (gap[near[1:]] != gap[near[:-1]])
            proposed.append(np.stack([near[head], gap[near[head]]], axis=1))
    if not proposed:
        return np.zeros((0, 3), dtype=np.int64)
    pairs = np.concatenate(proposed)
    low, period = pairs[:, 0].copy(), pairs[:, 1]
    high = low + period  # words low .. high-1 and those one period further are compared from here on
    bounds_low, bounds_high = np.searchsorted(rows, rows[low], side="left"), np.searchsorted(rows, rows[low], side="right")
    # Nothing repeats at twice the last length, so every length is needed at most once on either side.
    for k in range(len(tables) - 1, -1, -1):
        name, step = tables[k], 1 << k
        fits = np.flatnonzero(high + step <= bounds_high)
        fits = fits[_same(name, high[fits] - period[fits], high[fits])]
        high[fits] += step
        fits = np.flatnonzero(low - step >= bounds_low)
        fits = fits[_same(name, low[fits] - step, low[fits] - step + period[fits])]
        low[fits] -= step
    size = high - low
    keep = size >= np.maximum(least, repeats * period)
    return np.unique(np.stack([low[keep], period[keep], size[keep]], axis=1), axis=0)[:, [0, 2, 1]]


def _same(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (name[a] == name[b]) & (name[a] >= 0)


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether a word stands in a run after the run's first unit."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def _texts(data: np.ndarray, offsets: np.ndarray, repeats: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, run rows (start within the text), runs per text, bytes of the collapsed texts and their lengths."""
    texts = len(offsets) - 1
    hashes, starts, ends = words(data, offsets, EXACT_WORDS)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(rows, minlength=texts)
    first = np.concatenate([[0], np.cumsum(counts)])
    runs = runs_of(hashes, rows, repeats, least) if len(hashes) else np.zeros((0, 3), dtype=np.int64)
    kept = np.flatnonzero(~_dropped(runs, len(hashes)))
    # Kept words, and the byte after each that another one of the same text follows, as a space.
    ends_kept, rows_kept = ends[kept], rows[kept]
    joined = np.zeros(len(kept), dtype=bool)
    joined[:-1] = rows_kept[1:] == rows_kept[:-1]
    out = data.copy()
    out[ends_kept[joined]] = 0x20
    marks = np.zeros(len(data) + 1, dtype=np.int8)
    marks[starts[kept]] += 1
    marks[ends_kept + joined] -= 1
    mask = np.cumsum(marks[:-1], dtype=np.int8) > 0
    sizes = np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    owner = rows[runs[:, 0]] if len(runs) else np.zeros(0, dtype=np.int64)
    runs = runs.copy()
    runs[:, 0] -= first[owner]
    return counts, runs, np.bincount(owner, minlength=texts), out[mask], sizes


def find_runs(df: DataFrame, text: str = "text", repeats: int = MIN_REPEATS, least: int = 6) -> DataFrame:
    """Add ``n_words``, ``runs`` and ``collapsed`` to every row of ``df``.

    Words are the maximal stretches free of ASCII white space, compared exactly as they are written (by 64-bit hashes).
    ``runs`` lists every maximal stretch of at least ``least`` words and ``repeats`` times its smallest period, sorted by
    start and period: ``start`` (word number from 0), ``length``, ``period`` (words). ``collapsed`` is the text with every
    run cut down to its first unit and words joined by single spaces.

    A null text has no words, no run and the collapsed text ''; so has an empty one. Rows are independent: equal rows give
    equal results, ties do not arise, and an empty table gives an empty one. Columns of ``df`` keep their names and
    values, except that columns named like the added ones are replaced. Texts are handled in batches of about a megabyte
    without a shuffle; a longer text is a batch of its own, with a few numbers per word and factor length held at once.
    """
    if repeats < MIN_REPEATS or least < 1:
        raise ValueError(f"runs are searched from {MIN_REPEATS} repeats and one word on")
    added = ["n_words", "runs", "collapsed"]
    others = [c for c in df.columns if c not in added]
    plain = numbered(df.select(*others, *([text] if text in added else [])))
    source = plain.columns[-1] if text in added else plain.columns[others.index(text)]
    schema = T.StructType(
        [*plain.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_runs", T.ArrayType(RUN)), T.StructField("_collapsed", T.StringType())]
    )

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.schema.get_field_index(source)))
            for low, high in groups(offsets, GROUP):
                part = offsets[low : high + 1]
                counts, runs, per_text, collapsed, sizes = _texts(data[part[0] : part[-1]], part - part[0], repeats, least)
                listed = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)), listed)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                cut = pa.LargeStringArray.from_buffers(high - low, pa.py_buffer(ends), pa.py_buffer(collapsed)).cast(pa.string())
                columns = [*batch.slice(low, high - low).columns, pa.array(counts.astype(np.int64)), lists, cut]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    found = plain.mapInArrow(detect, schema)
    return found.select(*[F.col(p).alias(o) for p, o in zip(plain.columns, others)], F.col("_n").alias("n_words"), F.col("_runs").alias("runs"), F.col("_collapsed").alias("collapsed"))


def with_cycled_tail(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and texts, a tenth of which end in a cycle, as the registered query's contract lays down.

    With h the CRC-32 of the decimal id and g = h / 10: where h is divisible by 10, word a + j becomes word a + j % p, with
    a = g % n and p = 1 + (n - a) / (3 + g % 8) (whole numbers, n words). Other texts, and those without id, stay as they are.
    """
    rows = df.select(doc_id, text).withColumn("_hash", F.crc32(F.col(doc_id).cast("string").cast("binary")))
    chosen = F.col("_hash") % 10 == 0
    split = F.array_remove(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), "")
    rows = rows.withColumn("_words", F.when(chosen, split)).withColumn("_g", F.floor(F.col("_hash") / 10))
    n = F.size("_words")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    unit = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    rounds = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, rounds)), F.lit(1), n - F.col("_a"))
    cycled = F.concat_ws(" ", F.slice("_words", F.lit(1), F.col("_a")), tail)
    return rows.withColumn(text, F.when(F.col("_a").isNotNull(), cycled).otherwise(F.col(text))).drop("_hash", "_words", "_g", "_a", "_p")


def run_digest(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per row of ``find_runs``: number of runs, the longest (ties: smallest start, then period), and digests."""
    runs = F.col("runs")
    longest = F.aggregate(
        runs,
        F.lit(None).cast(RUN),
        lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best),
    )
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))))
    rows = found.select(*keys, F.size(runs).cast("long").alias("n_runs"), longest.alias("_best"), lines.alias("_lines"), "collapsed")
    return rows.select(
        *keys,
        "n_runs",
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        _sha256("_lines").alias("runs_sha256"),
        _sha256("collapsed").alias("collapsed_sha256"),
    )


def _sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)

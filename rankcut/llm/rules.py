"""Quality rules: plain text statistics with fixed limits, and a calibrated model of word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.linear import Features, margins, shared_weights, sigmoid, train, training_rows
from rankcut.llm.text import EXACT_WORDS, column_bytes, groups, mix, span_hashes, windows, word_spans, words

SPEC = Features(bits=18, words=(1, 2), chars=(4,))
SAMPLE = 8_000  # labelled documents that a model is fitted on, at most
KEEP = 0.3  # least calibrated probability of good quality
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of the words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.array([0 if b == 10 else b + 1 for b in range(256)], np.uint16)
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])  # first byte of a character


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every text."""
    data, offsets = column_bytes(column)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = {k: np.zeros(len(column), np.int64) for k in names}
    for low, high in groups(offsets):
        text, rel, rows = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], high - low
        h, starts, ends = words(text, rel, EXACT_WORDS)
        owner = np.searchsorted(rel, starts, side="right") - 1
        leads = np.append(0, np.cumsum(_LEAD[text], dtype=np.int64))
        symbols = np.append(0, np.cumsum(_SYMBOL[text], dtype=np.int64))
        out["n_words"][low:high] = np.bincount(owner, minlength=rows)
        out["word_chars"][low:high] = np.bincount(owner, leads[ends] - leads[starts], rows).astype(np.int64)
        out["n_symbols"][low:high] = symbols[rel[1:]] - symbols[rel[:-1]]
        out["n_dup_lines"][low:high] = _repeated_lines(text, rel, starts, rows)
        grams, first = windows(h, owner, 3)
        covered = np.zeros(len(h), bool)
        if len(grams):
            again = _several(grams, owner[first])
            for k in range(3):
                covered[first[again] + k] = True
        out["n_repeat_words"][low:high] = np.bincount(owner[covered], minlength=rows)
    return out


def _several(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their row."""
    key = mix(values + mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    flags = np.zeros(len(key), bool)
    flags[1:] |= same
    flags[:-1] |= same
    out = np.empty(len(key), bool)
    out[order] = flags
    return out


def _repeated_lines(text: np.ndarray, rel: np.ndarray, word_starts: np.ndarray, rows: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends = word_spans(_LINE[text], rel[:-1][rel[:-1] < len(text)])
    if not len(starts):
        return np.zeros(rows, np.int64)
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[filled], ends[filled]
    if not len(starts):
        return np.zeros(rows, np.int64)
    hashes = span_hashes(_LINE[text].astype(np.uint64), starts, ends)
    owner = np.searchsorted(rel, starts, side="right") - 1
    order = np.lexsort((hashes, owner))
    h, r = hashes[order], owner[order]
    later = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[1:][later], minlength=rows)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the probability as a logistic function of the margin (Newton's method, smoothed targets)."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def quality_rules(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP, spec: Features = SPEC) -> DataFrame:
    """Statistics and verdict of every whole text: ``doc_id``, the counts, ``base_failed``, ``kept``, then ``probability``.

    A text fails the plain rules with fewer than 50 words, or when more than half of its words stand in three-word windows that the text repeats. Others
    are kept if their calibrated probability of good quality is at least ``keep``. The model is fitted on four fifths of at most ``sample`` labelled documents
    (whose ``crc32(doc_id) mod 5`` is not 0) and calibrated on the rest; scoring runs in Arrow batches.

    Null and empty texts have no words and fail. Repeated rows are judged each. Without usable labels every probability is 0.5. A null
    ``doc_id`` is never used for training. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = training_rows(documents, labels, "quality", sample)
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0
    weights, bias = train(rows.where(~calibrate), spec)
    shared = shared_weights(spark, weights)

    def margin_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"m": pa.array(margins(batch.column(0), shared.value, bias, spec)), "y": batch.column(1)})

    held = rows.where(calibrate).select("text", "y").mapInArrow(margin_of, "m double, y double").toPandas()  # a fifth of the sample
    slope, shift = platt(held["m"].to_numpy(), held["y"].to_numpy())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = text_statistics(batch.column(1))
            p = sigmoid(slope * margins(batch.column(1), shared.value, bias, spec) + shift)
            failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
            verdict = {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= keep)), "probability": pa.array(p)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v) for k, v in out.items()} | verdict)

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(judge, schema)

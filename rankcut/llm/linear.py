"""Hashed sparse linear models: features from Arrow batches, follow-the-regularised-leader training in shards, dot products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankcut.llm.frames import release
from rankcut.llm.text import CHUNK, SPACES, column_bytes, groups, mix, span_hashes, windows
from rankcut.session import stage

FOLDS = 5

# Token classes of bytes: 0 white space, 1 letters, digits and characters beyond ASCII, 2 punctuation.
_CLASS = np.array([0 if b in SPACES else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)
_SEED = 0xD1B54A32D192ED03


@dataclass(frozen=True)
class Features:
    """``bits``: log2 of the weight table; ``words``: sizes of token n-grams; ``chars``: sizes of byte n-grams."""

    bits: int = 18
    words: tuple[int, ...] = (1, 2)
    chars: tuple[int, ...] = ()

    def slots(self, hashes: np.ndarray, salt: int) -> np.ndarray:
        return (mix(hashes + np.uint64(_SEED * salt % (1 << 64))) >> np.uint64(64 - self.bits)).astype(np.int64)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: a run of letters and digits or a run of punctuation. Bytes are hashed in bounded chunks."""
    hashes, rows, low = [], [], 0
    while low < len(data):
        high = min(low + CHUNK, len(data))
        if high < len(data):  # end before a white space byte, so that no token is cut
            gaps = np.flatnonzero(_CLASS[data[high:]] == 0) if high + CHUNK >= len(data) else np.flatnonzero(_CLASS[data[high : high + CHUNK]] == 0)
            high = high + int(gaps[0]) if len(gaps) else len(data)
        kind = _CLASS[data[low:high]]
        first, last = np.searchsorted(offsets, [low, high])
        edge = np.ones(len(kind) + 1, dtype=bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets[first:last] - low] = True
        bounds = np.flatnonzero(edge)
        starts, ends = bounds[:-1], bounds[1:]
        real = kind[starts] != 0
        starts, ends = starts[real], ends[real]
        hashes.append(span_hashes(data[low:high].astype(np.uint64) + np.uint64(1), starts, ends))
        rows.append(np.searchsorted(offsets, starts + low, side="right") - 1)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def char_windows(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and rows of all runs of ``n`` bytes inside a text, in bounded chunks."""
    for low in range(0, max(len(data) - n + 1, 0), CHUNK):
        high = min(low + CHUNK, len(data) - n + 1)
        part = data[low : high + n - 1].astype(np.uint64)
        value = np.zeros(high - low, dtype=np.uint64)
        for k in range(n):
            value = (value << np.uint64(8)) | part[k : k + high - low]
        rows = np.searchsorted(offsets, np.arange(low, high), side="right") - 1 if len(offsets) > 2 else np.zeros(high - low, np.int64)
        whole = np.arange(low, high) + n <= offsets[rows + 1]
        yield value[whole], rows[whole]


def feature_parts(data: np.ndarray, offsets: np.ndarray, spec: Features) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, row) of every feature occurrence of a group of texts, part by part."""
    hashes, rows = token_hashes(data, offsets)
    for n in spec.words:
        grams, first = windows(hashes, rows, n)
        yield spec.slots(grams, n), rows[first]
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]))
    yield spec.slots(np.zeros(len(again), np.uint64), 99), rows[again]  # the bigram "a word twice", whatever the word
    for n in spec.chars:
        for grams, owner in char_windows(data, offsets, n):
            yield spec.slots(grams, 100 + n), owner


def margins(column: pa.Array, weights: np.ndarray, bias: float, spec: Features) -> np.ndarray:
    """Mean weight over the feature occurrences of each text, plus the bias; an empty text gets the bias."""
    data, offsets = column_bytes(column)
    out = np.full(len(column), bias)
    for low, high in groups(offsets):
        total, count = np.zeros(high - low), np.zeros(high - low)
        for slots, rows in feature_parts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], spec):
            total += np.bincount(rows, weights[slots], high - low)
            count += np.bincount(rows, minlength=high - low)
        out[low:high] += total / np.maximum(count, 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(texts: pa.Array, labels: np.ndarray, spec: Features, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader over the rows in the order given; returns the weight table and the bias.

    A feature's value is its share of the text's occurrences, scaled by ``2 ** 5`` for the update so that steps are of order one.
    """
    scale = 32.0
    data, offsets = column_bytes(texts)
    examples = []
    for i in range(len(labels)):
        parts = [s for s, _ in feature_parts(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), spec)]
        slots, counts = np.unique(np.concatenate(parts), return_counts=True)
        examples.append((np.append(slots, 1 << spec.bits), np.append(counts * (scale / max(counts.sum(), 1)), 1.0)))
    z, n = np.zeros((1 << spec.bits) + 1), np.zeros((1 << spec.bits) + 1)

    def current(slots: np.ndarray) -> np.ndarray:
        zs = z[slots]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[slots])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(epochs):
        for (slots, values), y in zip(examples, labels, strict=True):
            w = current(slots)
            g = (sigmoid(np.array(w @ values)) - y) * values
            old = n[slots]
            n[slots] = old + g * g
            z[slots] += g - (np.sqrt(n[slots]) - np.sqrt(old)) / alpha * w
    w = current(np.arange(len(z)))
    return w[:-1] * scale, float(w[-1])


def fold(doc_id: str = "doc_id"):
    """crc32 of the id's text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(documents: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``bound`` labelled documents outside the held-out fold.

    The sample is the labelled ids with the smallest hash (one row per id), hence the same on every run. It is bounded
    by the parameter and therefore broadcast; texts are read whole. Repeated document ids count once, with their smallest text.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max(target).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def train(rows: DataFrame, spec: Features, shards: int = 8) -> tuple[np.ndarray, float]:
    """Fit one model per shard of the training rows and average the models (the averages meet in Spark).

    Rows go to shards by the hash of their id and are visited in hash order. What reaches the driver is the weight table, whose
    size is set by ``spec``.
    """

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table["h"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        w, b = ftrl(table["text"], table["y"].to_numpy(), spec)
        used = np.append(np.flatnonzero(w), len(w))
        return pa.table({"slot": pa.array(used, pa.int64()), "w": pa.array(np.append(w, b)[used], pa.float64())})

    keyed = rows.select("text", "y", F.xxhash64("doc_id").alias("h"))
    keyed = keyed.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    models = keyed.groupBy("shard").applyInArrow(fit, "slot long, w double")
    mean = stage(models.groupBy("slot").agg((F.sum("w") / shards).alias("w")), "weights").toPandas()
    weights = np.zeros((1 << spec.bits) + 1)
    weights[mean["slot"].to_numpy()] = mean["w"].to_numpy()
    return weights[:-1], float(weights[-1])


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[dict[str, pa.Array]], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches of the chosen columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(fn({c: batch.column(i) for i, c in enumerate(columns)}))
        release()

    return df.select(*columns).mapInArrow(run, schema)


def shared_weights(spark: SparkSession, weights: np.ndarray):
    """Broadcast handle of a weight table (its size is fixed by the number of hash bits)."""
    return spark.sparkContext.broadcast(weights.astype(np.float32))

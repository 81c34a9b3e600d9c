"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.linear import fold, map_batches, training_rows
from rankcut.llm.text import FOLDED_TERMS, FOLDED_WORDS, byte_table, column_bytes, groups, span_hashes, word_spans, words
from rankcut.session import stage

SAMPLE = 12_000  # labelled documents that lexicon, trees and calibration are fitted on, at most
LEXICON = 4_096  # entries of the learned lexicon, at most
STEMS = (4, 5)  # sizes of word beginnings, in bytes, that may be lexicon entries beside whole words
NEAR = 5  # words on either side that count as close to a second person
THRESHOLD = 0.5

# Second-person pronouns of the four languages of the corpus.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "ti", "tus", "vosotros"]
# Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

NAMES = ["word_hits", "stem_hits", "log_hits", "strength", "near_second", "second_person", "capitals", "capital_words", "punctuation", "exclamations", "mixed_words", "unmasked_hits", "log_words"]

_PLAIN = byte_table(b"", lower=True)
_UNMASKED = FOLDED_WORDS.copy()
for _sign, _letter in SIGNS.items():
    _UNMASKED[ord(_sign)] = FOLDED_WORDS[ord(_letter)]
_UPPER, _LETTER, _PUNCT, _DIGIT = (np.array([f(b) for b in range(256)]) for f in (
    lambda b: 65 <= b <= 90, lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, lambda b: 33 <= b < 127 and not chr(b).isalnum(), lambda b: 48 <= b <= 57))


def hash_of_words(entries: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([words(*column_bytes(pa.array([w])), FOLDED_TERMS)[0] for w in entries]))


_SECOND = hash_of_words(SECOND_PERSON)


def _stem_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of the words that are longer than that (others: 0)."""
    out = np.zeros(len(starts), np.uint64)
    longer = np.flatnonzero(ends - starts > size)
    for low in range(0, len(longer), 1 << 16):
        part = longer[low : low + (1 << 16)]
        base = int(starts[part[0]]) if len(part) else 0
        stop = int(starts[part[-1]]) + size if len(part) else 0
        codes = _PLAIN[data[base:stop]].astype(np.uint64)
        out[part] = span_hashes(codes, starts[part] - base, starts[part] - base + size) + np.uint64(size)
    return out


def term_table(table: pa.Table) -> pa.Table:
    """Distinct term and stem hashes of each labelled text, counted by label."""
    found: dict[float, list[np.ndarray]] = {}
    data, offsets = column_bytes(table["text"])
    for i, y in enumerate(table["y"].to_pylist()):
        text = data[offsets[i] : offsets[i + 1]]
        h, s, e = words(text, np.array([0, len(text)]), FOLDED_TERMS)
        terms = np.unique(np.concatenate([h, *(_stem_hashes(text, s, e, k) for k in STEMS)]))
        found.setdefault(y, []).append(terms[terms != 0])
    rows = []
    for y, lists in found.items():
        h, n = np.unique(np.concatenate(lists), return_counts=True)
        rows.append(pa.table({"h": pa.array(h.view(np.int64)), "y": pa.array(np.full(len(h), y)), "n": pa.array(n, pa.int64())}))
    return pa.concat_tables(rows) if rows else pa.table({"h": pa.array([], pa.int64()), "y": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})


def learn_lexicon(rows: DataFrame, size: int = LEXICON, least: int = 5, odds: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Terms and stems whose smoothed log odds of standing in a toxic document exceed ``odds``: hashes (sorted) and log odds.

    Counted in Spark over the training rows; at most ``size`` entries, the commonest, reach the driver.
    """
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)
    counts = rows.select("text", "y").mapInArrow(lambda batches: (b for x in batches for b in term_table(pa.Table.from_batches([x])).to_batches()), "h long, y double, n long")
    by_term = counts.groupBy("h").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    score = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    best = by_term.where(F.col("a") >= least).withColumn("odds", score).where(F.col("odds") > odds)
    top = best.orderBy(F.desc("a"), "h").limit(size).toPandas()
    hashes = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["odds"].to_numpy(dtype=float)[order]


def _found(hashes: np.ndarray, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_set):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(sorted_set, hashes), len(sorted_set) - 1)
    return sorted_set[at] == hashes, at


def dense_features(column: pa.Array, lexicon: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` per text; an empty text has zeros."""
    data, offsets = column_bytes(column)
    out = np.zeros((len(column), len(NAMES)))
    for low, high in groups(offsets):
        text, rel, rows = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], high - low

        def per_text(flags: np.ndarray, rel: np.ndarray = rel) -> np.ndarray:
            total = np.append(0, np.cumsum(flags, dtype=np.int64))
            return (total[rel[1:]] - total[rel[:-1]]).astype(float)

        h, s, e = words(text, rel, FOLDED_TERMS)
        owner = np.searchsorted(rel, s, side="right") - 1
        count = lambda mask, owner=owner, rows=rows: np.bincount(owner[mask], minlength=rows).astype(float)
        n = np.maximum(np.bincount(owner, minlength=rows), 1).astype(float)
        whole, at = _found(h, lexicon)
        strength = np.where(whole, odds[at] if len(odds) else 0.0, 0.0)
        stems = np.zeros(len(h), bool)
        for size in STEMS:
            hit, at = _found(_stem_hashes(text, s, e, size), lexicon)
            stems |= hit
            strength = np.maximum(strength, np.where(hit, odds[at] if len(odds) else 0.0, 0.0))
        hits = whole | stems
        second, _ = _found(h, _SECOND)
        last = np.append(0, np.cumsum(second))
        ends_at = np.cumsum(np.bincount(owner, minlength=rows))  # the words of a text end here
        begins_at = np.append(0, ends_at[:-1])
        around = last[np.minimum(np.arange(len(h)) + NEAR + 1, ends_at[owner])] - last[np.maximum(np.arange(len(h)) - NEAR, begins_at[owner])]
        near = hits & (around > 0)
        letters = per_text(_LETTER[text])
        upper = np.append(0, np.cumsum(_UPPER[text], dtype=np.int64))
        loud = (upper[e] - upper[s] == e - s) & (e - s > 1)
        mh, ms, me = words(text, rel, _UNMASKED)
        m_owner = np.searchsorted(rel, ms, side="right") - 1
        lettered = np.append(0, np.cumsum(_LETTER[text], dtype=np.int64))
        trimmed = _LETTER[text[ms]] & _LETTER[text[me - 1]] if len(ms) else np.zeros(0, bool)
        mixed = trimmed & (lettered[me] - lettered[ms] < me - ms)
        unmasked, _ = _found(mh, lexicon)
        strongest = np.zeros(rows)
        np.maximum.at(strongest, owner, strength)
        length = np.maximum((rel[1:] - rel[:-1]).astype(float), 1)
        out[low:high] = np.column_stack([
            count(whole) / n, count(stems) / n, np.log1p(count(hits)), strongest, count(near) / n, count(second) / n,
            per_text(_UPPER[text]) / np.maximum(letters, 1), count(loud) / n, per_text(_PUNCT[text]) / length,
            per_text(text == 33) / length, np.bincount(m_owner[mixed], minlength=rows) / n, np.bincount(m_owner[unmasked & mixed], minlength=rows) / n,
            np.log1p(np.bincount(owner, minlength=rows)),
        ])
    return out


def with_features(df: DataFrame, keep: list[str], lexicon: np.ndarray, odds: np.ndarray) -> DataFrame:
    """``keep`` and the vector ``features`` of each text (lexicon and odds have a bounded number of entries)."""

    def run(batch: dict) -> dict:
        x = dense_features(batch["text"], lexicon, odds)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
        return {c: batch[c] for c in keep} | {"x": flat}

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", x array<double>"
    return map_batches(df, list(dict.fromkeys([*keep, "text"])), run, schema).withColumn("features", array_to_vector("x")).drop("x")


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, trees: int = 20) -> DataFrame:
    """Score every whole text for toxicity: ``doc_id, held_out, score, predicted``.

    Features: densities of a lexicon learned from the training rows (words and word beginnings), lexicon words near a second
    person, capitals, punctuation, words with signs inside, lexicon words once signs are read as letters. Boosted trees are fitted on three
    quarters of at most ``sample`` labelled documents whose ``crc32(doc_id) mod 5`` is not 0, the isotonic calibration on the rest; the lexicon is learned on the former.

    Null and empty texts have all-zero features and are scored like any other. Repeated rows are scored each; a null ``doc_id``
    is never used for training. If the labels hold fewer than two classes, the score is their mean (0.5 without labels).
    """
    rows = stage(training_rows(documents, labels, "toxic", sample), "toxic_rows")
    means = rows.agg(F.min("y").alias("low"), F.max("y").alias("high"), F.avg("y").alias("mean")).collect()[0]
    plain = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if means["low"] is None or means["low"] == means["high"]:
        score = F.lit(0.5 if means["mean"] is None else float(means["mean"]))
        return _result(plain.select("doc_id", score.alias("score")), threshold)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    # The rows that calibrate must not have shaped the features, or the curve would be too sure.
    learning = rows.where(~part)
    lexicon, odds = learn_lexicon(learning if learning.agg(F.count_distinct("y")).collect()[0][0] == 2 else rows)
    fitted = stage(with_features(rows.withColumn("calibrate", part), ["y", "calibrate"], lexicon, odds).select("y", "calibrate", vector_to_array("features").alias("x")), "toxic_features")
    fitted = fitted.select("y", "calibrate", array_to_vector("x").alias("features"))
    fit_rows, cal_rows = fitted.where(~F.col("calibrate")), fitted.where("calibrate")
    if fit_rows.agg(F.count_distinct("y")).collect()[0][0] < 2 or cal_rows.agg(F.count_distinct("y")).collect()[0][0] < 2:
        fit_rows = cal_rows = fitted  # too few rows to hold any back
    model = GBTClassifier(labelCol="y", maxIter=trees, maxDepth=3, seed=7, stepSize=0.3).fit(fit_rows)
    probability = vector_to_array("probability")[1]
    raw = model.transform(cal_rows).select("y", probability.alias("p"))
    raw = stage(raw.groupBy("p").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("weight")), "toxic_raw")  # trees give many ties
    curve = IsotonicRegression(labelCol="y", featuresCol="p", weightCol="weight").fit(raw)
    xs, ys = [float(v) for v in curve.boundaries], [float(v) for v in curve.predictions]
    scored = model.transform(with_features(plain, ["doc_id"], lexicon, odds)).select("doc_id", probability.alias("p"))
    return _result(scored.select("doc_id", interpolate(F.col("p"), xs, ys).alias("score")), threshold)


def interpolate(p, xs: list[float], ys: list[float]):
    """Linear interpolation of a monotone step table, constant outside it (one row per distinct step, bounded by the sample)."""
    if len(xs) == 1:
        return F.lit(ys[0])
    x, y = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
    k = F.greatest(F.least(F.size(F.filter(x, lambda v: v <= p)), F.lit(len(xs) - 1)), F.lit(1))  # position of the left end
    left, right = F.element_at(x, k), F.element_at(x, k + 1)
    low, high = F.element_at(y, k), F.element_at(y, k + 1)
    share = F.when(right > left, F.least(F.greatest((p - left) / (right - left), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    return low + (high - low) * share


def _result(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

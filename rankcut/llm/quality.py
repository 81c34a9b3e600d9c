"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.frames import number_of, numbered
from rankcut.llm.linear import Features, fold, map_batches, margins, shared_weights, sigmoid, train, training_rows

SPEC = Features(bits=18, words=(1, 2))
SAMPLE = 12_000  # labelled documents that a model is fitted on, at most
THRESHOLD = 0.3


def _scored(rows: DataFrame, text: str, keep: list[str], model: tuple[np.ndarray, float], threshold: float, spec: Features) -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every row."""
    weights, bias = model
    shared = shared_weights(rows.sparkSession, weights)

    def score(batch: dict) -> dict:
        p = sigmoid(margins(batch[text], shared.value, bias, spec))
        return {c: batch[c] for c in keep} | {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double, predicted int"
    return map_batches(rows, list(dict.fromkeys([*keep, text])), score, schema)


def score_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, spec: Features = SPEC) -> DataFrame:
    """Score every whole text for quality: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Features are token unigrams and bigrams (tokens: runs of letters and digits, runs of punctuation), hashed, and the bigram "one token twice". The model
    is fitted on at most ``sample`` labelled documents whose ``crc32(doc_id) mod 5`` is not 0; scores are sparse dot products in Arrow batches.

    Null and empty texts get the model's bias as score. Repeated rows are scored each. Without any usable label every score is
    0.5. A null ``doc_id`` is never used for training. Other columns are ignored. An empty table gives no rows.
    """
    model = train(training_rows(documents, labels, "quality", sample), spec)
    scored = _scored(documents.select("doc_id", "text"), "text", ["doc_id"], model, threshold, spec)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, spec: Features = SPEC) -> DataFrame:
    """The documents that ``score_quality`` does not reject, with all their columns."""
    model = train(training_rows(documents, labels, "quality", sample), spec)
    rows = numbered(documents)
    scored = _scored(rows, number_of(documents, "text"), rows.columns, model, threshold, spec)
    return scored.where(F.col("predicted") == 1).select(*rows.columns).toDF(*documents.columns)

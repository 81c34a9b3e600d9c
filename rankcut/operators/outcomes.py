"""From token scores to one outcome row per item and step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.functions.arrays import array_mean
from rankcut.operators.align import trim_evals, treated
from rankcut.operators.quantiles import nearest_quantiles
from rankcut.session import stage

# Fixed value: the outcomes that are regressed, in their reporting order.
TARGETS = ["mean", "median", "std", "iqr"]


def occurrence_scores(scores: DataFrame) -> DataFrame:
    """Sum the parts of each occurrence of an item."""
    return scores.groupBy("step", "uid", "tok", "pos").agg(F.sum("logprob").alias("logprob"))


def outcome_table(scores: DataFrame, cutoff: int) -> DataFrame:
    """Distribution of the occurrence scores per ``(step, tok)``, with the inclusion flag.

    The occurrence scores (narrow, and few beside the score arrays they come from) are staged, because the
    quantiles read them more than once.
    """
    return occurrence_outcomes(stage(occurrence_scores(scores).select("step", "tok", "logprob"), "occurrences"), cutoff)


def occurrence_outcomes(occurrences: DataFrame, cutoff: int) -> DataFrame:
    """``outcome_table`` of staged occurrence scores ``(step, tok, logprob)``."""
    per_item = nearest_quantiles(
        occurrences,
        ["step", "tok"],
        "logprob",
        {"q25": 0.25, "median": 0.5, "q75": 0.75},
        [F.avg("logprob").alias("mean"), F.stddev_samp("logprob").alias("std")],
    )
    return per_item.select(
        "step",
        "tok",
        "median",
        "mean",
        "std",
        (F.col("q75") - F.col("q25")).alias("iqr"),
        F.col("n").alias("num"),
        treated("tok", cutoff).alias("treat"),
    )


def unpivot_targets(outcomes: DataFrame, keep: list[str], targets: list[str] = TARGETS) -> DataFrame:
    """One row per target: ``keep..., target, value``."""
    return outcomes.unpivot(keep, targets, "target", "value")


def cross_entropy(evals: DataFrame, keys: list[str], docs: DataFrame | None = None) -> DataFrame:
    """Negative mean over documents of the mean score in a document.

    The score arrays are used as they are, padding included; pass ``docs`` to trim them first.
    """
    source = evals if docs is None else trim_evals(evals, docs)
    per_doc = source.select(*keys, array_mean(F.col("token_logprob")).alias("m"))
    return per_doc.groupBy(*keys).agg((-F.avg("m")).alias("token_logprob"))

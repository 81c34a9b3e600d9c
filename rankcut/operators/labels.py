"""Tables behind the figures: effect labels, relative axes, effect against cross-entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.functions.strings import ordinal, strict_lookup
from rankcut.operators.ordering import with_group_aggregates

# Display names of tokeniser kinds and vocabulary sizes.
TOKENIZER_NAMES = {"bpe": "BPE", "wordpiece": "WordPiece", "bpe2wp": "BPE2WP"}
VOCAB_NAMES = {8064: "8k", 32000: "32k", 128000: "128k"}


def effect_labels(predicted: DataFrame, facets: list[str], x: str, y: str, shared: list[str] | None = None) -> DataFrame:
    """One label per facet and distinct rounded effect, placed at the lower left corner of the facet.

    With ``shared``, the corner is that of the coarser ``shared`` group.
    """
    corner = [F.min(x).alias("xpos"), F.min(y).alias("ypos")]
    effects = predicted.select(*facets, F.round("ate", 2).alias("ate")).distinct()
    corners = predicted.groupBy(*(shared or facets)).agg(*corner)
    return effects.join(corners, shared or facets).withColumn("label", F.concat(F.lit("ATE: "), F.col("ate").cast("string")))


def relative_axis(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Centre ``col`` on its mean within ``keys``."""
    out = with_group_aggregates(df, keys, [F.avg(col).alias("_mean")])
    return out.withColumn(col, F.col(col) - F.col("_mean")).drop("_mean")


def run_label(tokenizers: dict = TOKENIZER_NAMES, vocab_sizes: dict = VOCAB_NAMES) -> Column:
    return F.concat_ws(
        " ",
        strict_lookup(F.col("tokenizer"), tokenizers),
        strict_lookup(F.col("vocab_size"), vocab_sizes),
        F.col("model_size"),
    )


def effect_vs_loss(effects: DataFrame, losses: DataFrame, keys: list[str], vocab_sizes: dict = VOCAB_NAMES) -> DataFrame:
    """Effects of ``mean`` after step 0 beside the validation loss of the same cell, with a display label."""
    after = effects.where((F.col("step") > 0) & (F.col("target") == "mean"))
    return losses.join(after, keys).withColumn("label", run_label(vocab_sizes=vocab_sizes))


def scaling_table(effects: DataFrame, losses: DataFrame, keys: list[str], models: list[str], without: list[str] = ()) -> DataFrame:
    """Left-joined effects and losses, models given an order; a model outside the order fails."""
    after = effects.where((F.col("step") > 0) & (F.col("target") == "mean")).select(*keys, "ate")
    if without:
        after = after.where(~F.col("model_size").isin(list(without)))
    return after.join(losses, keys, "left").withColumn("model_order", ordinal(F.col("model_size"), models))

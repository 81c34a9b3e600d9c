"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links(a, b)``; the label is the smallest node of the component.

    Every round takes the smallest label among a node's neighbours and then follows labels one step, so that chains shrink by
    half or more. Each round is staged; only a count of changes comes back.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "both_ways")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        lower = stage(labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label")), "lower")
        target = lower.select(F.col("node").alias("t"), F.col("label").alias("next"))
        labels = stage(lower.join(target, F.col("label") == F.col("t")).select("node", "was", F.col("next").alias("label")), "labels")
        if labels.where(F.col("was") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")

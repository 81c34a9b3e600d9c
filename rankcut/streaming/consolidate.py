"""Incremental consolidation: checkpoint files are picked up once, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankcut.sources.readers import EVALS_SCHEMA
from rankcut.sources.writers import label_checkpoints


def new_checkpoints(spark: SparkSession, eval_path: str) -> DataFrame:
    """Streaming rows of files not seen before, labelled with ``run`` and ``step``."""
    files = (
        spark.readStream.schema(EVALS_SCHEMA)
        .parquet(f"{eval_path}/*/*")
        .withColumn("filename", F.col("_metadata.file_path"))
    )
    return label_checkpoints(files)


# Folders that a task has open at a time; rows are sorted by folder only beyond that.
OPEN_FOLDERS = 16


def consolidate_available(spark: SparkSession, eval_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Append every new file to ``out_path`` exactly once, then stop. Stateless, so any volume fits.

    A task reads few files, each of one run and step, so it writes their rows as they come and does not sort the score arrays.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FOLDERS))  # the query takes its settings when it starts
    try:
        return (
            new_checkpoints(spark, eval_path)
            .writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .partitionBy("run", "step")
            .trigger(availableNow=True)
            .start(out_path)
        )
    finally:
        spark.conf.set(name, before)

"""Scans of corpora, evaluations, merge logs and vocabulary documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankcut.functions.names import parse_run_name, run_of_path, step_of_path
from rankcut.operators.ordering import top_k
from rankcut.operators.vocab import MERGES_SCHEMA

EVALS_SCHEMA = "uid long, token_logprob array<double>, token_ids array<int>"
TOKENISED_SCHEMA = "uid long, input_ids array<int>"
REGDATA_SCHEMA = (
    "step long, tok long, median double, mean double, std double, iqr double, num long, treat boolean"
)


def scan_parquet(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*paths)


def spread_scan(scan: DataFrame) -> DataFrame:
    """Redistribute the rows of a plain scan that yields fewer slices than there are cores.

    Meant for costly per-row work on a small source; a large source has many slices and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def scan_with_path(spark: SparkSession, *paths: str, schema: str | None = None, name: str = "filename") -> DataFrame:
    """Parquet scan of files or globs with the source file as a column."""
    return scan_parquet(spark, *paths, schema=schema).withColumn(name, F.col("_metadata.file_path"))


def read_runs(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """One file per run -> rows labelled with what the file name says (``run``, ``tokenizer``, ``vocab_size``, ``model_size``)."""
    rows = scan_with_path(spark, *paths, schema=schema)
    run = run_of_path(F.col("filename"))
    labels = parse_run_name(F.col("run"))
    return (
        rows.withColumn("run", run)
        .withColumn("_l", labels)
        .withColumns({c: F.col(f"_l.{c}") for c in ("tokenizer", "vocab_size", "model_size")})
        .drop("_l", "filename")
    )


def read_checkpoints(spark: SparkSession, *paths: str) -> DataFrame:
    """Evaluations of many checkpoints, ``step`` from the path."""
    rows = scan_with_path(spark, *paths, schema=EVALS_SCHEMA)
    return rows.withColumn("step", step_of_path(F.col("filename"))).drop("filename")


def read_merges_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines merges log under its explicit schema (no inference pass)."""
    return spark.read.schema(MERGES_SCHEMA).option("mode", "FAILFAST").json(path)


def read_vocab_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document ``{model: {vocab: {token: id}, merges: [..]}}`` -> ``vocab(id, token)``, ``merges(rank, merge)``."""
    schema = "model struct<type:string, vocab:map<string,int>, merges:array<string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    vocab = doc.select(F.explode(F.map_entries("model.vocab")).alias("e")).select(
        F.col("e.value").alias("id"), F.col("e.key").alias("token")
    )
    merges = doc.select(F.posexplode("model.merges").alias("rank", "merge"))
    return vocab, merges


def read_corpus(docs: DataFrame, order: list[Column], rows: int, text: str = "text") -> DataFrame:
    """The first ``rows`` documents of a corpus in ``order``, text only."""
    return top_k(docs, order, rows).select(text)


def with_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Named splits -> one table with a ``split`` column."""
    tables = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out

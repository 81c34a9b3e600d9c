"""Metadata carried by run names such as ``me57M-tied_corpus_bpe32000corpus``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankcut.functions import strings as S

# Fixed value: the tokeniser kinds a run name may contain, longest alternative first.
TOKENIZER_PATTERN = r"((bpe2wp)|(bpe)|(wordpiece))"


def run_of_path(path: Column) -> Column:
    """Name of a run from its Parquet file, or from a part file in its Parquet folder."""
    return S.extract_group(path, r"(?:^|/)([^/]+?)\.parquet(?:/part-[^/]*)?$")


def parse_run_name(run: Column) -> Column:
    """Struct of every label in a run name.

    ``tokenizer`` and ``vocab_size`` follow the analysis rule (first kind found, last digit run);
    ``tok_name`` and ``cutoff`` follow the extraction rule (third part, its longest digit run).
    """
    parts = F.split(run, "_")
    tok_name = F.get(parts, F.lit(2))
    return F.struct(
        S.strip_prefix(F.get(parts, F.lit(0)), "me").alias("model_size"),
        F.get(parts, F.lit(1)).alias("dataset"),
        tok_name.alias("tok_name"),
        S.extract_group(run, TOKENIZER_PATTERN).alias("tokenizer"),
        S.extract_last(run, r"\d+").cast("int").alias("vocab_size"),
        S.longest_digit_run(tok_name).cast("int").alias("cutoff"),
    )


def step_of_path(path: Column) -> Column:
    return S.extract_group(path, r"step(\d+)").cast("long")

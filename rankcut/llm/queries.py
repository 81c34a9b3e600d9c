"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankcut.llm import filter_audit, search
from rankcut.llm.decontaminate import find_overlaps, oracle_sql
from rankcut.llm.licenses import scan_licenses
from rankcut.llm.neardup import near_duplicates
from rankcut.llm.packing import pack_documents
from rankcut.llm.pii import find_personal_data
from rankcut.llm.quality import score_quality
from rankcut.llm.rules import quality_rules
from rankcut.llm.runs import find_runs, run_digest, with_cycled_tail
from rankcut.llm.sharding import shard_documents
from rankcut.llm.token_counts import count_tokens
from rankcut.llm.toxicity import score_toxicity
from rankcut.session import ship_package

COUNT_VOCABULARY = "byte_bpe_50k.json"
PACK_VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return wrap


@query("op1_quality_classifier")
def op1(read):
    return score_quality(read("documents"), read("labels")).select("doc_id", "held_out", "score", "predicted")


@query("op2_personal_data")
def op2(read):
    return find_personal_data(read("documents"))


@query("op3_sharding")
def op3(read):
    return shard_documents(read("documents"), shards=8)


@query("op4_ngram_join")
def op4(read):
    return near_duplicates(read("documents"))


@query("op5_packing")
def op5(read):
    return pack_documents(read("documents"), vocabulary(PACK_VOCABULARY), with_ids=False)


@query("op6_license_scan")
def op6(read):
    """Documents lie in folders by source and language."""
    documents = read("documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(documents.select("doc_id", path.alias("path"), "text"))


@query("op7_quality_rules")
def op7(read):
    return quality_rules(read("documents"), read("labels"))


@query("op8_decontamination", oracle_sql())
def op8(read):
    return find_overlaps(read("documents"), read("benchmark"))


@query("op9_token_counts")
def op9(read):
    return count_tokens(read("documents"), vocabulary(COUNT_VOCABULARY))


@query("op10_toxicity")
def op10(read):
    return score_toxicity(read("documents"), read("labels"))


@query("op11_filter_audit", filter_audit.oracle_sql())
def op11(read):
    return filter_audit.audit_documents(read("documents"), read("labels"))


@query("op12_periodic_runs")
def op12(read):
    return run_digest(find_runs(with_cycled_tail(read("documents"))), ["doc_id"])


@query("op13_exact_topk", search.oracle_sql())
def op13(read):
    return search.search_embeddings(read("embeddings"), every=50, k=5, scale=256)

import sys
from pathlib import Path

import pytest

import __spark_entry__ as spark_entry

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).parents[1] / "tools"))
from check_queries import close, comparable  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are not here")

# One query per family; tools/check_queries.py runs all of them.
SAMPLE = [
    "src02_glob_with_path",
    "src04_arrow_folder",
    "src07_vocab_document",
    "snk03_consolidate_checkpoints",
    "flt07_global_max",
    "joi04_shifted_self_join",
    "joi08_anti_join",
    "agg04_quantile_nearest",
    "agg04_quantile_linear",
    "agg10_two_level",
    "win01_lead",
    "win03_centre",
    "win04_running_id",
    "str09_run_name",
    "arr05_explode_together",
    "aln04_tag_pairs",
    "aln04_tag_pairs_greedy",
    "aln07_regression_data",
    "aln07_bucketed_runs",
    "aln07_all_runs",
    "aln07_scored_run",
    "sta01_scored_run",
    "sco06_evaluate",
    "qa03_token_agreement",
    "sta03_effect_fit",
    "sta06_window_sensitivity",
    "sta08_loess_linear",
    "sta09_effect_labels",
    "tok01_words",
    "tok03_first_pairs",
    "sco01_pack_batches",
    "tok05_seed_substrings",
    "sco04_score_trigram",
    "sco05_checkpoints",
    "qa01_alignment_complete",
    "qa01_observed",
    "udf02_user_model",
    "udf02_predict_batch",
    "stm01_incremental_consolidation",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_statement_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
    assert set(SAMPLE) <= set(spark_entry.oracle_sql())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns[:2] == ["step", "target"]
    rows = df.collect()
    assert len(rows) == 12 and all(r["lower"] < r["ate"] < r["upper"] for r in rows if r["status"] == "ok")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = spark_entry.queries()[name](spark, str(SF_DIR))
    result = con.execute(spark_entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = comparable([tuple(r) for r in df.collect()], df.columns, order)
    theirs = comparable(result.fetchall(), columns, order)
    assert len(ours) == len(theirs) and ours
    assert all(close(a, b) for a, b in zip(ours, theirs))

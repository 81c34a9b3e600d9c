import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankcut.sources import arrow_folder, readers, writers
from rankcut.streaming.consolidate import consolidate_available


def write_checkpoint(spark, root, run, step, uids):
    rows = [(u, [-1.0 * step, -2.0], [u, 2]) for u in uids]
    df = spark.createDataFrame(rows, readers.EVALS_SCHEMA)
    df.write.parquet(f"{root}/{run}_2025-02-03T04-05-06/step{step}_2025-02-03T04-05-07")


def rows_of(df):
    return sorted((r["run"], r["step"], r["uid"], tuple(r["token_logprob"])) for r in df.collect())


def test_export_and_incremental_consolidation_agree(spark, tmp_path):
    root, out = str(tmp_path / "evals"), str(tmp_path / "out")
    stream, state = str(tmp_path / "stream"), str(tmp_path / "state")
    write_checkpoint(spark, root, "me57M_c_bpe500", 0, [1, 2])
    write_checkpoint(spark, root, "me57M_c_bpe500", 2000, [1, 2])
    consolidate_available(spark, root, stream, state).awaitTermination()
    assert len(rows_of(spark.read.parquet(stream))) == 4
    write_checkpoint(spark, root, "me100M_c_bpe500", 2000, [5])
    for _ in range(2):  # new files once, then nothing
        consolidate_available(spark, root, stream, state).awaitTermination()
    writers.export_evals(spark, root, out)
    exported = rows_of(spark.read.parquet(out))
    assert exported == rows_of(spark.read.parquet(stream))
    assert [(r, s, u) for r, s, u, _ in exported] == [("me100M_c_bpe500", 2000, 5), *[("me57M_c_bpe500", s, u) for s in (0, 2000) for u in (1, 2)]]
    assert {r["step"] for r in readers.read_checkpoints(spark, f"{root}/me57M*/*/*.parquet").collect()} == {0, 2000}


def test_vocab_document(spark, tmp_path):
    path = tmp_path / "tokenizer.json"
    doc = {"version": "1.0", "model": {"type": "BPE", "vocab": {"a": 0, "Ġ\"b": 1, "ab": 2}, "merges": ["a b", "ab Ġ"]}}
    path.write_text(json.dumps(doc, indent=2))
    vocab, merges = readers.read_vocab_document(spark, str(path))
    assert {(r["id"], r["token"]) for r in vocab.collect()} == {(0, "a"), (1, "Ġ\"b"), (2, "ab")}
    assert sorted((r["rank"], r["merge"]) for r in merges.collect()) == [(0, "a b"), (1, "ab Ġ")]


def test_merges_log_round_trip_and_bad_lines(spark, tmp_path):
    rows = [([1, 2], "ab", 300, "a", "b", 17), ([300, 3], "abc", 301, "ab", "c", 9)]
    path = str(tmp_path / "log")
    writers.write_merges_log(spark.createDataFrame(rows, readers.MERGES_SCHEMA), path)
    assert sorted(tuple(r) for r in readers.read_merges_log(spark, path).collect()) == rows
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"pair": [1, 2], "new_token_id": 5}\n{"pair": "oops"\n')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        readers.read_merges_log(spark, str(bad)).collect()


def test_runs_are_labelled_from_file_names(spark, tmp_path):
    for run in ("me57M-tied_c_bpe8064c", "me850M_c_bpe2wp128000c"):
        df = spark.createDataFrame([(0, 1, 0.1, 0.2, None, 0.4, 5, True)], readers.REGDATA_SCHEMA)
        df.coalesce(1).write.parquet(str(tmp_path / f"{run}.parquet"))
    rows = readers.read_runs(spark, f"{tmp_path}/*.parquet", schema=readers.REGDATA_SCHEMA).collect()
    assert {(r["run"], r["model_size"], r["tokenizer"], r["vocab_size"]) for r in rows} == {
        ("me57M-tied_c_bpe8064c", "57M-tied", "bpe", 8064),
        ("me850M_c_bpe2wp128000c", "850M", "bpe2wp", 128000),
    }


def test_configurations_are_pruned_by_folder(spark, tmp_path):
    path = str(tmp_path / "corpus")
    df = spark.createDataFrame([(1, [1], "train"), (2, [2], "test")], "uid long, input_ids array<int>, split string")
    writers.write_config(df, path, "bpe500c")
    writers.write_config(df, path, "bpe900c")
    part = spark.read.parquet(path).where((F.col("tok_name") == "bpe900c") & (F.col("split") == "test"))
    assert [(r["uid"]) for r in part.collect()] == [2]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tok_name" in plan


def test_writing_over_existing_results_fails(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.range(3)
    writers.write_parquet(df, path)
    with pytest.raises(PySparkException):
        writers.write_parquet(df, path)
    writers.append_batches(df, path)
    assert spark.read.parquet(path).count() == 6


def test_arrow_folder_round_trip(spark, tmp_path):
    rows = [(i, f"text {i} é" if i % 7 else None, [i, i + 1], i / 2) for i in range(500)]
    df = spark.createDataFrame(rows, "uid long, text string, ids array<int>, x double").repartition(4)
    path = str(tmp_path / "folder")
    arrow_folder.write_arrow_folder(df, path)
    back = arrow_folder.read_arrow_folder(spark, path)
    assert dict(back.dtypes) == dict(df.dtypes) and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.rdd.getNumPartitions() == len(arrow_folder.data_files(path)) == 4
    some = arrow_folder.read_arrow_folder(spark, path, "x double, uid long")
    assert sorted(map(tuple, some.collect())) == sorted((r[3], r[0]) for r in rows)
    # Files that the list does not name are those of lost tasks.
    (tmp_path / "folder" / "data-lost.arrow").write_bytes(b"half a file")
    assert arrow_folder.read_arrow_folder(spark, f"file://{path}").count() == 500
    arrow_folder.write_arrow_folder(df.limit(10), path)
    assert arrow_folder.read_arrow_folder(spark, path).count() == 510
    arrow_folder.write_arrow_folder(df.limit(0), path, mode="overwrite")
    empty = arrow_folder.read_arrow_folder(spark, path)
    assert empty.columns == df.columns and empty.collect() == []


def test_arrow_folder_of_another_writer(spark, tmp_path):
    """Plain stream files without a list, in order of their names."""
    import pyarrow as pa

    for k in range(3):
        table = pa.table({"input_ids": pa.array([[k], [k, k]], pa.list_(pa.uint16())), "uid": pa.array([2 * k, 2 * k + 1], pa.int32())})
        with pa.OSFile(str(tmp_path / f"data-0000{k}-of-00003.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
            out.write_table(table, max_chunksize=1)
    rows = arrow_folder.read_arrow_folder(spark, str(tmp_path), "uid long, input_ids array<int>").collect()
    assert sorted(map(tuple, rows)) == [(0, [0]), (1, [0, 0]), (2, [1]), (3, [1, 1]), (4, [2]), (5, [2, 2])]


def test_layouts_are_kept_by_joins_on_more_keys(spark):
    from rankcut.session import layouts_kept

    rows = spark.range(100).select(F.col("id").alias("uid"), (F.col("id") % 3).alias("pos")).repartition("uid")
    joined = rows.join(rows.withColumnRenamed("pos", "at").withColumn("pos", F.col("at") * 1).hint("merge"), ["uid", "pos"])
    name, before = "spark.sql.requireAllClusterKeysForCoPartition", spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with layouts_kept(spark):
        plan = joined.groupBy().count()._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(uid" in plan and "pos" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])
    assert spark.conf.get(name) == before


def test_consolidation_does_not_sort_score_arrays(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming import DataStreamWriter

    for run, step in (("a", 0), ("a", 2000), ("b", 0)):
        rows = spark.createDataFrame([(u, [-1.0 * u], [u]) for u in range(4)], readers.EVALS_SCHEMA)
        rows.write.parquet(str(tmp_path / "evals" / f"{run}_2026-01-01T00-00-00" / f"step{step}_2026-01-01T00-00-00"))
    name, seen, start = "spark.sql.maxConcurrentOutputFileWriters", [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: (seen.append(int(spark.conf.get(name))), start(self, *a, **k))[1])
    before = spark.conf.get(name)
    for _ in range(2):  # the second pass finds nothing new
        consolidate_available(spark, str(tmp_path / "evals"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert min(seen) > 0 and spark.conf.get(name) == before  # with open writers, Spark adds no sort by folder
    got = {(r["run"], r["step"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("run", "step").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 0): 4, ("a", 2000): 4, ("b", 0): 4}

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankcut.functions import arrays as A
from rankcut.functions import names as N
from rankcut.functions import strings as S
from rankcut.functions.student import two_sided_p, upper_quantile


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("_")])
    return row.select(column.alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("n, expected", [(0, []), (2, [2, 3]), (3, [1, 2, 3]), (9, [1, 2, 3]), (None, [1, 2, 3])])
def test_keep_last(spark, n, expected):
    df = spark.createDataFrame([([1, 2, 3], n)], "x array<int>, n int")
    assert df.select(A.keep_last(F.col("x"), F.col("n")).alias("r")).collect()[0]["r"] == expected


def test_array_helpers_on_empty_arrays(spark):
    df = spark.createDataFrame([([],)], "x array<double>")
    row = df.select(A.index_range(F.col("x")).alias("i"), A.array_mean(F.col("x")).alias("m"), A.left_pad(F.col("x"), F.lit(2), F.lit(0.0)).alias("p")).collect()[0]
    assert row["i"] == [] and row["m"] is None and row["p"] == [0.0, 0.0]


def test_array_mean_skips_nulls(spark):
    df = spark.createDataFrame([([1.0, None, 4.0],)], "x array<double>")
    assert df.select(A.array_mean(F.col("x")).alias("m")).collect()[0]["m"] == 2.5


def test_explode_together_rejects_unequal_lengths(spark):
    df = spark.createDataFrame([(1, [1, 2], [3])], "k int, a array<int>, b array<int>")
    with pytest.raises(PySparkException, match="differ in length"):
        A.explode_together(df, ["a", "b"]).collect()


def test_explode_together_keeps_empty_rows_on_request(spark):
    df = spark.createDataFrame([(1, []), (2, [5])], "k int, a array<int>")
    rows = A.explode_together(df, ["a"], "pos", outer=True).orderBy("k").collect()
    assert [(r["k"], r["a"], r["pos"]) for r in rows] == [(1, None, None), (2, 5, 0)]


def test_strict_lookup_and_ordinal_fail_on_unknown_labels(spark):
    df = spark.createDataFrame([("bpe",), (None,)], "x string")
    rows = df.select(S.strict_lookup(F.col("x"), {"bpe": "BPE"}).alias("a"), S.ordinal(F.col("x"), ["z", "bpe"]).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [("BPE", 1), (None, None)]
    other = spark.createDataFrame([("other",)], "x string")
    for column in (S.strict_lookup(F.col("x"), {"bpe": "BPE"}), S.ordinal(F.col("x"), ["bpe"])):
        with pytest.raises(PySparkException, match="unknown"):
            other.select(column).collect()


def test_regex_helpers_give_null_without_a_match(spark):
    assert one(spark, S.extract_group(F.col("s"), r"step(\d+)"), s="none") is None
    assert one(spark, S.extract_last(F.col("s"), r"\d+"), s="none") is None
    assert one(spark, S.longest_digit_run(F.col("s")), s="a12b34c5") == "12"
    assert one(spark, S.longest_digit_run(F.col("s")), s="none") is None


def test_affixes(spark):
    assert one(spark, S.strip_prefix(F.col("s"), "me"), s="meme") == "me"
    assert one(spark, S.strip_prefix(F.col("s"), "me"), s="57M") == "57M"
    assert one(spark, S.strip_suffix(F.col("s"), ".parquet"), s="a.parquet") == "a"
    assert one(spark, S.strip_suffix(F.col("s"), ".parquet"), s="parquet") == "parquet"


@pytest.mark.parametrize(
    "run, model, tokenizer, vocab, cutoff",
    [
        ("me57M-tied_corpus_bpe32000corpus", "57M-tied", "bpe", 32000, 32000),
        ("me850M_corpus-20B_bpe2wp8064corpus", "850M", "bpe2wp", 8064, 8064),
        ("me100M_corpus_wordpiece128000", "100M", "wordpiece", 128000, 128000),
    ],
)
def test_run_names(spark, run, model, tokenizer, vocab, cutoff):
    row = one(spark, N.parse_run_name(F.col("s")), s=run)
    assert (row["model_size"], row["tokenizer"], row["vocab_size"], row["cutoff"]) == (model, tokenizer, vocab, cutoff)


@pytest.mark.parametrize("path", ["/a/run1.parquet", "file:/a/run1.parquet/part-00000-x.c000.snappy.parquet", "run1.parquet"])
def test_run_of_path(spark, path):
    assert one(spark, N.run_of_path(F.col("s")), s=path) == "run1"


# Table values of the Student-t distribution.
@pytest.mark.parametrize("df, level, t", [(1, 0.95, 12.706), (10, 0.95, 2.228), (30, 0.95, 2.042), (120, 0.99, 2.617), (1000, 0.95, 1.962)])
def test_student_t_table(df, level, t):
    assert abs(upper_quantile(level, df) - t) < 5e-4
    assert abs(two_sided_p(t, df) - (1 - level)) < 5e-4

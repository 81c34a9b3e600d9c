import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.operators import outcomes, quantiles, regress, smooth
from rankcut.operators.filters import at_global_max, drop_incomplete, override


@pytest.mark.parametrize("slices", [1, 7, None])
def test_nearest_quantiles_against_brute_force(spark, slices):
    rng = random.Random(1)
    groups = {"one": [4.0], "two": [1.0, 2.0], "four": [1.0, 2.0, 3.0, 10.0], "ties": [2.0] * 50, "many": [rng.gauss(0, 1) for _ in range(500)]}
    groups["skewed"] = [math.exp(rng.gauss(0, 4)) for _ in range(301)] + [7.0] * 100
    rows = [(k, v) for k, values in groups.items() for v in values] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q0": 0.0, "q100": 1.0}
    got = {r["k"]: r for r in quantiles.nearest_quantiles(df, ["k"], "v", qs, [F.avg("v").alias("mean")], slices).collect()}
    for k, values in groups.items():
        ordered = sorted(values)
        for name, q in qs.items():
            assert got[k][name] == ordered[math.floor((len(ordered) - 1) * q + 0.5)], (k, name)
        assert got[k]["n"] == len(values)
    got = {r["k"]: r for r in quantiles.linear_quantiles(df, ["k"], "v", qs, [F.avg("v").alias("mean")], slices).collect()}
    for k, values in groups.items():
        assert [got[k][name] for name in qs] == pytest.approx([np.quantile(values, q) for q in qs.values()]) and got[k]["mean"] == pytest.approx(np.mean(values))
        assert got[k]["mean"] == pytest.approx(sum(values) / len(values))


def test_one_outlier_does_not_gather_a_group(spark):
    n = 100_000
    value = F.when(F.col("id") == 0, 1e12).otherwise(F.sqrt(F.col("id")))
    df = spark.range(n).select(F.lit(1).alias("k"), value.alias("v"))
    row = quantiles.nearest_quantiles(df, ["k"], "v", {"m": 0.5, "top": 1.0}, slices=8).collect()[0]
    assert row["m"] == math.sqrt(n // 2 + 1) and row["top"] == 1e12
    per_slice = df.repartitionByRange(8, "k", "v").groupBy(F.spark_partition_id()).count().agg(F.max("count")).collect()[0][0]
    assert per_slice < n / 4


def test_nearest_quantile_of_four_values(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 10.0)], "k int, v double")
    row = quantiles.nearest_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()[0]
    assert (row["a"], row["b"], row["c"]) == (2.0, 3.0, 3.0)


def sandwich(x, t, y):
    """HC1 by plain matrix algebra on the uncentred design."""
    X = np.column_stack([np.ones(len(x)), x, t])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    e = y - X @ beta
    bread = np.linalg.inv(X.T @ X)
    n = len(y)
    v = n / (n - 3) * bread @ (X.T * e**2) @ X @ bread
    return beta, np.sqrt(v[2, 2]), 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))


def test_cells_against_matrix_algebra(spark):
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for cell in range(6):
        n = 40 + 10 * cell
        tok = 32000 + np.arange(-n // 2, n // 2)
        treat = tok < 32000
        y = 3 + 0.4 * tok / 1000 + 1.5 * treat + rng.normal(0, 0.2 + 0.3 * treat, n)
        expected[cell] = sandwich(tok / 1000, treat.astype(float), y)
        rows += [(cell, int(a), bool(b), float(c)) for a, b, c in zip(tok, treat, y)]
    df = spark.createDataFrame(rows, "cell int, tok long, treat boolean, value double")
    fits = regress.with_inference(regress.fit_cells(df, ["cell"], F.col("tok") / 1000))
    for r in fits.collect():
        beta, se, r2 = expected[r["cell"]]
        assert r["status"] == "ok"
        assert r["ate"] == pytest.approx(beta[2], rel=1e-6)
        assert r["slope"] == pytest.approx(beta[1], rel=1e-5, abs=1e-6)
        assert r["se"] == pytest.approx(se, rel=1e-5)
        assert r["r2"] == pytest.approx(r2, rel=1e-6)
        assert r["lower"] < r["ate"] < r["upper"]
    predicted = regress.predictions(df, fits, ["cell"], F.col("tok") / 1000)
    for r in predicted.where("cell = 0").collect():
        assert r["fitted"] == pytest.approx(r["fitted_on"] if r["treat"] else r["fitted_off"])


def test_planted_effect_is_covered(spark):
    rng = np.random.default_rng(4)
    tok = np.arange(1000, 3000)
    rows = [(int(t), bool(t < 2000), float(-8 + t / 1000 + 2.5 * (t < 2000) + rng.normal())) for t in tok]
    df = spark.createDataFrame(rows, "tok long, treat boolean, value double").withColumn("cell", F.lit(1))
    r = regress.with_inference(regress.fit_cells(df, ["cell"], F.col("tok") / 1000)).collect()[0]
    assert r["lower"] < 2.5 < r["upper"] and r["pvalue"] < 1e-6


def test_singular_and_tiny_cells(spark):
    rows = [("one-sided", t, True, float(t)) for t in range(10)] + [("tiny", 1, True, 1.0), ("tiny", 2, False, 2.0), ("tiny", 3, False, 4.0)]
    rows += [("gaps", t, t < 5, float("nan") if t % 2 else None) for t in range(10)]
    df = spark.createDataFrame(rows, "cell string, tok long, treat boolean, value double")
    got = {r["cell"]: r for r in regress.with_inference(regress.fit_cells(df, ["cell"], F.col("tok"))).collect()}
    assert got["one-sided"]["status"] == "singular" and got["tiny"]["status"] == "too_few"
    assert all(got[c][k] is None for c in got for k in ("ate", "se", "lower", "pvalue"))
    assert "gaps" not in got


def test_window_sensitivity_uses_the_global_last_step(spark):
    rng = random.Random(9)
    rows = []
    for model, last in (("a", 4000), ("b", 2000)):
        for step in range(2000, last + 1, 2000):
            rows += [(model, 500, "bpe", step, t, t < 500, rng.gauss(0, 1), rng.gauss(0, 1), 1.0 + rng.random(), rng.random()) for t in range(480, 520)]
    df = spark.createDataFrame(rows, "model_size string, vocab_size int, tokenizer string, step long, tok long, treat boolean, mean double, median double, std double, iqr double")
    got = regress.window_sensitivity(df, ["model_size", "vocab_size", "tokenizer", "step"], [5, 10, 100]).collect()
    assert {(r["model_size"], r["step"]) for r in got} == {("a", 4000)}
    assert {(r["window_size"], r["n"]) for r in got} == {(5, 10), (10, 20), (100, 40)}
    assert len(got) == 12


def sweep_by_rows(df, keys, windows, vocab_sizes=None):
    """Every row repeated for every window that holds it, and each window fitted on its own rows."""
    last = at_global_max(df, "step")
    last = last.where(F.col("vocab_size").isin(vocab_sizes)) if vocab_sizes else last
    every = [last.where((F.col("tok") >= F.col("vocab_size") - w) & (F.col("tok") < F.col("vocab_size") + w)).withColumn("window_size", F.lit(w)) for w in windows]
    long = outcomes.unpivot_targets(reduce(DataFrame.unionByName, every), ["window_size", *keys, "tok", "treat"])
    return regress.fit_cells(long, ["window_size", *keys, "target"], F.col("tok") / 1000)


def test_window_sweep_equals_fits_of_every_window(spark):
    """Far from zero, with gaps, nulls and cells that end on one side, in several batches and files."""
    rng = random.Random(4)
    rows = []
    for model, size in (("a", 100_000), ("b", 100_000), ("c", 90_000), (None, 100_000)):
        for t in range(size - 400, size + 400):
            if rng.random() < 0.6 and not (model == "b" and t >= size + 20):
                y = 1e4 + (t - size) * 0.01 + (t < size) * 2
                values = [y + rng.gauss(0, 1), None if rng.random() < 0.1 else y, float("nan") if rng.random() < 0.1 else rng.random(), 3.0]
                rows.append((model, size, "bpe", 2000, t, t < size, *values))
    rows += [("a", 100_000, "bpe", 1000, t, t < 100_000, 1.0, 1.0, 1.0, 1.0) for t in range(99_990, 100_010)]
    schema = "model_size string, vocab_size int, tokenizer string, step long, tok long, treat boolean, mean double, median double, std double, iqr double"
    df = spark.createDataFrame(rows, schema).repartition(5)
    keys, windows = ["model_size", "vocab_size", "tokenizer", "step"], [5, 20, 50, 300, 1000]
    for sizes in (None, [100_000]):
        got = {tuple(r[:6]): r for r in regress.window_sensitivity(df, keys, windows, sizes).collect()}
        expected = {tuple(r[:6]): r for r in sweep_by_rows(df, keys, windows, sizes).collect()}
        assert got.keys() == expected.keys() and len(got) == (80 if sizes is None else 60)
        for k, r in expected.items():
            assert got[k]["status"] == r["status"] and got[k]["n"] == r["n"]
            for c in ("intercept", "slope", "ate", "se", "r2"):
                # Constant targets leave nothing but rounding.
                if r[c] is None:
                    assert got[k][c] is None or k[5] == "iqr" and c == "r2"
                else:
                    assert got[k][c] == pytest.approx(r[c], rel=1e-6, abs=1e-6) or k[5] == "iqr" and c in ("r2", "se")


def test_window_moments_read_the_table_once_and_repeat_no_row(spark, tmp_path):
    rows = [("a", 500, 1, t, t < 500, 1.0 * t, 1.0, 2.0, 3.0) for t in range(300, 700)]
    spark.createDataFrame(rows, "model string, vocab_size int, step long, tok long, treat boolean, mean double, median double, std double, iqr double").coalesce(2).write.parquet(f"{tmp_path}/t")
    parts = regress.window_moments(spark.read.parquet(f"{tmp_path}/t"), ["model", "step", "vocab_size"], [5, 50, 100], 1000.0, outcomes.TARGETS)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Generate" not in plan and "Expand" not in plan and "Exchange" not in plan
    kept = parts.where("ring >= 0")
    assert kept.agg(F.sum("n")).first()[0] == 4 * 200  # every row in reach once per target
    assert kept.count() <= 2 * 4 * 3 * 2  # files, targets, rings, sides


def test_line_smoother_band(spark):
    rng = np.random.default_rng(6)
    x = np.arange(30.0)
    y = 2 + 0.5 * x + rng.normal(size=30)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double")
    X = np.column_stack([np.ones(30), x])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    s2 = ((y - X @ beta) ** 2).sum() / 28
    half = 2.0484 * np.sqrt(s2 * np.einsum("ij,jk,ik->i", X, np.linalg.inv(X.T @ X), X))
    for r in regress.line_smoother(df, ["g"], "x", "y").collect():
        i = int(r["x"])
        assert r["line"] == pytest.approx(X[i] @ beta)
        assert r["line_upper"] - r["line"] == pytest.approx(half[i], rel=1e-4)


@pytest.mark.parametrize("degree", [1, 2])
def test_loess_against_brute_force(spark, degree):
    rng = np.random.default_rng(8)
    x = np.sort(rng.uniform(0, 10, 60))
    y = np.sin(x) + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "g0 string, x double, y double")
    got = {r["g"]: r for r in smooth.loess(df, ["g0"], "x", "y", span=0.3, degree=degree, points=15).collect()}
    assert len(got) == 15
    for g, x0 in enumerate(np.linspace(x.min(), x.max(), 15)):
        d = np.abs(x - x0)
        h = np.sort(d)[math.ceil(0.3 * 60) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        X = np.vander(x - x0, degree + 1, increasing=True)
        beta = np.linalg.lstsq(X * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        assert got[g]["fit"] == pytest.approx(beta[0], abs=1e-6)
        assert got[g]["lower"] < got[g]["fit"] < got[g]["upper"]


@pytest.mark.parametrize("block", [1, 3, 16])
def test_loess_over_blocks_against_brute_force(spark, block):
    """Ties in x, several groups, and windows whose edges lie in other blocks than their centres."""
    rng = np.random.default_rng(block)
    rows = []
    for name, n in (("a", 70), ("b", 9), ("c", 1), ("d", 200)):
        xs = np.round(rng.exponential(3, n), 1)
        rows += [(name, float(a), float(np.cos(a) + rng.normal(0, 0.2))) for a in xs]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0), ("a", None, 1.0), ("a", 1.0, None), ("a", 1.0, float("nan"))], "g0 string, x double, y double")
    got = {(r["g0"], r["g"]): r for r in smooth.loess(df, ["g0"], "x", "y", span=0.4, degree=1, points=11, block=block).collect()}
    assert len(got) == 44
    for name in "abcd":
        x, y = (np.array([r[k] for r in rows if r[0] == name]) for k in (1, 2))
        for g, x0 in enumerate(x.min() + np.arange(11) * ((x.max() - x.min()) / 10)):
            d = np.abs(x - x0)
            h = np.sort(d)[min(max(math.ceil(0.4 * len(x)), 2), len(x)) - 1]
            w = np.where(d < h, (1 - (d / h) ** 3) ** 3, d == 0) if h > 0 else (d == 0).astype(float)
            X = np.vander((x - x0) / (h or 1.0), 2, increasing=True)
            m = X.T @ (X * w[:, None])
            assert got[name, g]["fit"] == pytest.approx((np.linalg.pinv(m) @ (X.T @ (w * y)))[0], abs=1e-6)


def test_filters(spark):
    df = spark.createDataFrame([(0, 1.0), (5, float("nan")), (5, None), (5, 2.0)], "step int, v double")
    assert [r["v"] for r in drop_incomplete(df, ["v"]).orderBy("v").collect()] == [1.0, 2.0]
    assert at_global_max(df, "step").count() == 3
    assert override(df, "v", F.col("step") == 0, F.lit(12.0)).where("step = 0").collect()[0]["v"] == 12.0

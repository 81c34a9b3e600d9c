"""All regression cells in one job: ``y ~ 1 + x + treat`` with HC1 errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.functions.student import t_critical, t_pvalue
from rankcut.operators.filters import drop_incomplete
from rankcut.operators.ordering import join_groups
from rankcut.operators.outcomes import TARGETS, unpivot_targets
from rankcut.session import stage

# Fixed value: half-widths of the window-sensitivity sweep.
WINDOW_SIZES = [5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000]


def _design(df: DataFrame, x: Column) -> DataFrame:
    return df.withColumns({"_x": x.cast("double"), "_t": F.col("treat").cast("double")})


def coefficients(df: DataFrame, cells: list[str], x: Column, value: str = "value") -> DataFrame:
    """OLS coefficients per cell: ``n, intercept, slope, ate, status`` and the centred moments.

    Variances and covariances are merged from per-task partial results, and are already centred, which
    keeps the nearly collinear id axis well conditioned. One-sided cells and cells with three rows or
    fewer get NULL estimates and a ``status``.
    """
    m = (
        _design(drop_incomplete(df, [value]), x)
        .groupBy(*cells)
        .agg(
            F.count("*").alias("n"),
            F.avg("_x").alias("mx"),
            F.avg("_t").alias("mt"),
            F.avg(value).alias("my"),
            F.var_pop("_x").alias("sxx"),
            F.var_pop("_t").alias("stt"),
            F.var_pop(value).alias("syy"),
            F.covar_pop("_x", "_t").alias("sxt"),
            F.covar_pop("_x", value).alias("sxy"),
            F.covar_pop("_t", value).alias("sty"),
        )
    )
    return _solved(m)


def _solved(m: DataFrame) -> DataFrame:
    """Add ``det, status, slope, ate, intercept`` to cells with means and centred second moments."""
    det = F.col("sxx") * F.col("stt") - F.col("sxt") * F.col("sxt")
    singular = det <= F.lit(1e-12) * F.col("sxx") * F.col("stt")
    status = F.when(F.col("n") <= 3, "too_few").when(singular, "singular").otherwise("ok")
    m = m.withColumns({"det": det, "status": status})
    ok = F.col("status") == "ok"
    slope = (F.col("sxy") * F.col("stt") - F.col("sty") * F.col("sxt")) / F.col("det")
    ate = (F.col("sty") * F.col("sxx") - F.col("sxy") * F.col("sxt")) / F.col("det")
    m = m.withColumns({"slope": F.when(ok, slope), "ate": F.when(ok, ate)})
    return m.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx") - F.col("ate") * F.col("mt"))


def fit_cells(df: DataFrame, cells: list[str], x: Column, value: str = "value") -> DataFrame:
    """Effect per cell: ``n, ate, se, r2, status`` plus the coefficients."""
    fits = stage(coefficients(df, cells, x, value), "fits")
    wanted = fits.select(*cells, "mx", "mt", "my", "slope", "ate")
    rows = join_groups(_design(drop_incomplete(df, [value]), x).select(*cells, "_x", "_t", value), wanted, cells, staged=True)
    dx, dt = F.col("_x") - F.col("mx"), F.col("_t") - F.col("mt")
    e = F.col(value) - F.col("my") - F.col("slope") * dx - F.col("ate") * dt
    meat = rows.groupBy(*cells).agg(
        F.sum(e * e).alias("sse"),
        F.sum(e * e * dx * dx).alias("mxx"),
        F.sum(e * e * dx * dt).alias("mxt"),
        F.sum(e * e * dt * dt).alias("mtt"),
    )
    return _with_errors(join_groups(fits, meat, cells), cells)


def _with_errors(fits: DataFrame, cells: list[str]) -> DataFrame:
    """Effects with HC1 error and fit, from the sums of squared residuals times centred regressors."""
    n, sxx, sxt, det = F.col("n"), F.col("sxx"), F.col("sxt"), F.col("det")
    # Row of the inverse cross-product matrix that belongs to treat, times n.
    qx, qt = -sxt / det, sxx / det
    ok = F.col("status") == "ok"
    variance = (qx * qx * F.col("mxx") + 2 * qx * qt * F.col("mxt") + qt * qt * F.col("mtt")) / (n * n) * n / (n - 3)
    return (
        fits.withColumn("se", F.when(ok, F.sqrt(F.greatest(variance, F.lit(0.0)))))
        .withColumn("r2", F.when(ok & (F.col("syy") > 0), 1 - F.col("sse") / (n * F.col("syy"))))
        .select(*cells, "n", "intercept", "slope", "ate", "se", "r2", "status")
    )


def with_inference(effects: DataFrame, level: float = 0.95) -> DataFrame:
    """Add ``lower, upper, pvalue`` from Student t with ``n - 3`` degrees of freedom."""
    dof = (F.col("n") - 3).cast("double")
    half = t_critical(dof, F.lit(float(level))) * F.col("se")
    t = F.when(F.col("se") > 0, F.col("ate") / F.col("se"))
    return effects.withColumns(
        {"lower": F.col("ate") - half, "upper": F.col("ate") + half, "pvalue": t_pvalue(t, dof)}
    )


def predictions(df: DataFrame, effects: DataFrame, cells: list[str], x: Column, value: str = "value") -> DataFrame:
    """Fitted values and the two counterfactuals (treat forced off / on), one row per observation."""
    coef = effects.select(*cells, "intercept", "slope", "ate")
    rows = join_groups(drop_incomplete(df, [value]), coef, cells)
    base = F.col("intercept") + F.col("slope") * x.cast("double")
    return rows.withColumns(
        {
            "fitted": base + F.col("ate") * F.col("treat").cast("double"),
            "fitted_off": base,
            "fitted_on": base + F.col("ate"),
        }
    ).drop("intercept", "slope", "ate")


def effect_table(outcomes: DataFrame, keys: list[str], scale: float = 1000.0, targets: list[str] = TARGETS) -> DataFrame:
    """Effects of every ``keys`` x target cell of an outcome table."""
    long = unpivot_targets(outcomes, [*keys, "tok", "treat"], targets)
    return fit_cells(long, [*keys, "target"], F.col("tok") / F.lit(scale))


# Sums of products of deviations from the mean, by powers of x and y.
_MOMENTS = [(2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (4, 0), (3, 1), (2, 2)]
_NAMES = [f"m{i}{j}" for i, j in _MOMENTS]


def window_moments(outcomes: DataFrame, groups: list[str], windows: list[int], scale: float, targets: list[str]) -> DataFrame:
    """Partial centred moments per group, target, distance ring and side: one pass over the rows, which are never repeated.

    A row's ring is the first (smallest) of ``windows`` that contains it; ``treat`` is its side. Every Arrow batch gives one row per
    cell that occurs in it: ``n``, the means ``mx, my`` and the sums of powers of deviations from them. Rows outside all
    windows and incomplete ones are left out; a row with ring -1 per batch carries the largest step of all its rows.
    """
    half = np.array(windows)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({c: pd.Series([marker.get(c, batch["step"].max() if c == "step" else None)], dtype=object) for c in names})
            distance = (batch["tok"] - batch["vocab_size"]).to_numpy(dtype=float)
            ring = np.where(distance < 0, np.searchsorted(half, -distance, side="left"), np.searchsorted(half, distance, side="right"))
            inside = (ring < len(half)) & ~np.isnan(distance) & batch["treat"].notna().to_numpy()
            rows = batch[inside].assign(ring=ring[inside])
            for target in targets:
                known = rows[rows[target].notna()]
                if not len(known):
                    continue
                cells = known.groupby([*groups, "ring", "treat"], dropna=False, sort=False)
                code = cells.ngroup().to_numpy()
                n = np.bincount(code)
                x, y = known["tok"].to_numpy(dtype=float) / scale, known[target].to_numpy(dtype=float)
                mx, my = np.bincount(code, x) / n, np.bincount(code, y) / n
                u, v = x - mx[code], y - my[code]
                out = known.iloc[np.unique(code, return_index=True)[1]][[*groups, "ring", "treat"]].reset_index(drop=True)
                out = out.assign(target=target, n=n, mx=mx, my=my, **{c: np.bincount(code, u**i * v**j) for c, (i, j) in zip(_NAMES, _MOMENTS)})
                yield out[names].astype(dict.fromkeys([*groups, "target", "treat"], object))

    marker = {"ring": -1, "n": 0}
    types = dict(outcomes.dtypes)
    columns = {**{g: types[g] for g in groups}, "target": "string", "ring": "int", "treat": "boolean", "n": "long", "mx": "double", "my": "double"}
    columns |= dict.fromkeys(_NAMES, "double")
    names = list(columns)
    taken = list(dict.fromkeys([*groups, "step", "vocab_size", "tok", "treat", *targets]))
    return outcomes.select(*taken).mapInPandas(partial, ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def _merged(parts: DataFrame, cells: list[str]) -> DataFrame:
    """Moments of whole cells: partial ones are moved to the common mean and added."""
    whole = W.partitionBy(*cells)
    total = F.sum("n").over(whole)
    rows = parts.withColumns({"_x": F.sum(F.col("n") * F.col("mx")).over(whole) / total, "_y": F.sum(F.col("n") * F.col("my")).over(whole) / total})
    n, a, b = F.col("n"), F.col("mx") - F.col("_x"), F.col("my") - F.col("_y")
    m = {c: F.col(c) for c in _NAMES}
    moved = {
        "m20": m["m20"] + n * a * a,
        "m11": m["m11"] + n * a * b,
        "m02": m["m02"] + n * b * b,
        "m30": m["m30"] + 3 * a * m["m20"] + n * a * a * a,
        "m21": m["m21"] + b * m["m20"] + 2 * a * m["m11"] + n * a * a * b,
        "m12": m["m12"] + a * m["m02"] + 2 * b * m["m11"] + n * a * b * b,
        "m40": m["m40"] + 4 * a * m["m30"] + 6 * a * a * m["m20"] + n * a * a * a * a,
        "m31": m["m31"] + b * m["m30"] + 3 * a * (m["m21"] + b * m["m20"] + a * m["m11"]) + n * a * a * a * b,
        "m22": m["m22"] + 2 * b * m["m21"] + b * b * m["m20"] + 2 * a * m["m12"] + 4 * a * b * m["m11"] + a * a * m["m02"] + n * a * a * b * b,
    }
    return rows.groupBy(*cells).agg(
        F.sum("n").alias("n"), F.first("_x").alias("mx"), F.first("_y").alias("my"), *[F.sum(e).alias(c) for c, e in moved.items()]
    )


def _fit_from_moments(sides: DataFrame, cells: list[str]) -> DataFrame:
    """``fit_cells`` from the moments of both sides of each cell (columns with ``_0`` and ``_1``)."""
    side = lambda c, t: F.coalesce(F.col(f"{c}_{t}"), F.lit(0.0))
    both = (0, 1)
    n = side("n", 0) + side("n", 1)
    rows = sides.withColumns({"n": n.cast("long"), "mx": sum(side("n", t) * side("mx", t) for t in both) / n, "my": sum(side("n", t) * side("my", t) for t in both) / n, "mt": side("n", 1) / n})
    n = F.col("n")
    g = {t: F.when(side("n", t) > 0, side("mx", t) - F.col("mx")).otherwise(0.0) for t in both}
    f = {t: F.when(side("n", t) > 0, side("my", t) - F.col("my")).otherwise(0.0) for t in both}
    h = {t: F.lit(float(t)) - F.col("mt") for t in both}
    per_row = {
        "sxx": sum(side("m20", t) + side("n", t) * g[t] * g[t] for t in both),
        "sxy": sum(side("m11", t) + side("n", t) * g[t] * f[t] for t in both),
        "syy": sum(side("m02", t) + side("n", t) * f[t] * f[t] for t in both),
        "sxt": sum(side("n", t) * g[t] * h[t] for t in both),
        "sty": sum(side("n", t) * f[t] * h[t] for t in both),
        "stt": sum(side("n", t) * h[t] * h[t] for t in both),
    }
    rows = _solved(rows.withColumns({c: e / n for c, e in per_row.items()}))
    slope = F.col("slope")
    sums = {"sse": [], "mxx": [], "mxt": [], "mtt": []}
    for t in both:
        m = {c: side(c, t) for c in _NAMES}
        # A residual is v - slope * u + shift, with the deviations u, v from the side's means.
        shift = f[t] - slope * g[t] - F.col("ate") * h[t]
        e = m["m02"] + slope * slope * m["m20"] + side("n", t) * shift * shift - 2 * slope * m["m11"]
        eu = m["m12"] + slope * slope * m["m30"] - 2 * slope * m["m21"] + 2 * shift * (m["m11"] - slope * m["m20"])
        euu = m["m22"] + slope * slope * m["m40"] + shift * shift * m["m20"] - 2 * slope * m["m31"] + 2 * shift * (m["m21"] - slope * m["m30"])
        ex = eu + g[t] * e
        sums["sse"].append(e)
        sums["mxx"].append(euu + 2 * g[t] * eu + g[t] * g[t] * e)
        sums["mxt"].append(h[t] * ex)
        sums["mtt"].append(h[t] * h[t] * e)
    return _with_errors(rows.withColumns({c: F.greatest(sum(parts), F.lit(0.0)) if c != "mxt" else sum(parts) for c, parts in sums.items()}), cells)


def window_sensitivity(
    outcomes: DataFrame,
    keys: list[str],
    windows: list[int] = WINDOW_SIZES,
    vocab_sizes: list[int] | None = None,
    scale: float = 1000.0,
    targets: list[str] = TARGETS,
) -> DataFrame:
    """Effects at the last step for every half-width around ``vocab_size``.

    The last step is that of the whole table, so a model that stopped earlier yields no rows. The table is read once, and
    no row is repeated per window: moments per distance ring and side are added up from the innermost ring, and
    estimates and HC1 errors of every window are read off the moments.
    """
    windows = sorted(windows)
    groups = list(dict.fromkeys([*keys, "step", "vocab_size"]))
    parts = stage(window_moments(outcomes, groups, windows, scale, targets), "moments")
    last = parts.agg(F.max("step")).first()[0]
    rings = parts.where((F.col("ring") >= 0) & (F.col("step") == F.lit(last)))
    if vocab_sizes:
        rings = rings.where(F.col("vocab_size").isin(vocab_sizes))
    cells = [*keys, "target"]
    rings = _merged(rings, [*cells, "ring", "treat"])
    sizes = F.array(*[F.lit(w) for w in windows])
    outer = F.slice(sizes, F.col("ring") + 1, F.lit(len(windows)))
    inner = _merged(rings.withColumn("window_size", F.explode(outer)), ["window_size", *cells, "treat"])  # a few rows per cell
    columns = ["n", "mx", "my", *_NAMES]
    sides = inner.groupBy("window_size", *cells).agg(*[F.max(F.when(F.col("treat") == bool(t), F.col(c))).alias(f"{c}_{t}") for c in columns for t in (0, 1)])
    return _fit_from_moments(sides, ["window_size", *cells])


def line_smoother(df: DataFrame, keys: list[str], x: str, y: str, level: float = 0.95) -> DataFrame:
    """Least-squares line per group with its pointwise confidence band."""
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.var_pop(x).alias("sxx"),
        F.covar_pop(x, y).alias("sxy"),
        F.var_pop(y).alias("syy"),
    )
    ok = (F.col("n") > 2) & (F.col("sxx") > 0)
    sums = sums.withColumn("slope", F.when(ok, F.col("sxy") / F.col("sxx")))
    s2 = (F.col("syy") - F.col("slope") * F.col("sxy")) * F.col("n") / (F.col("n") - 2)
    sums = sums.withColumn("s2", F.when(ok, F.greatest(s2, F.lit(0.0))))
    sums = sums.withColumn("crit", t_critical((F.col("n") - 2).cast("double"), F.lit(float(level))))
    d = F.col(x) - F.col("mx")
    rows = join_groups(df, sums, keys)
    rows = rows.withColumn("line", F.col("my") + F.col("slope") * d)
    half = F.col("crit") * F.sqrt(F.col("s2") * (1 / F.col("n") + F.when(F.col("sxx") > 0, d * d / (F.col("n") * F.col("sxx")))))
    return rows.withColumns({"line_lower": F.col("line") - half, "line_upper": F.col("line") + half}).drop(
        "n", "mx", "my", "sxx", "sxy", "syy", "s2", "crit"
    )

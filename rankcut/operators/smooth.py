"""Local regression (LOESS) per group, evaluated on a fixed grid.

Rows are merged by distinct x, sorted, and cut into blocks that know their range and count. Where the window of a grid point ends
follows from the blocks' ranges but for the few blocks that the edge may lie in; only these are looked into. A window's sums
are formed block by block, for all grid points whose window reaches the block. So the number of rows in any step is that of
distinct x, or of grid points times blocks, never of rows times grid points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.functions.student import t_critical
from rankcut.operators.ordering import join_groups
from rankcut.session import stage

BLOCK = 4096  # distinct x of a block


def _solver(degree: int):
    """Solve the weighted normal equations of one grid point per row; returns value, norm and leverage."""

    @F.pandas_udf("struct<fit double, norm double, lever double>")
    def solve(w: pd.Series, v: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.full((len(w), 3), np.nan)
        p = degree + 1
        index = np.add.outer(np.arange(p), np.arange(p))
        for i in range(len(w)):
            moments = np.asarray(w.iloc[i], dtype=float)[index]
            squares = np.asarray(v.iloc[i], dtype=float)[index]
            right = np.asarray(b.iloc[i], dtype=float)
            row = np.linalg.pinv(moments)[0]
            out[i] = row @ right, np.sqrt(max(row @ squares @ row, 0.0)), row[0]
        return pd.DataFrame(out, columns=["fit", "norm", "lever"])

    return solve


def _blocks(points: DataFrame, block: int) -> DataFrame:
    """Sorted blocks of at most ``block`` distinct x of one group: ``bid, gid, lo, hi, n, x, c, y`` (the last three packed)."""
    schema = "bid long, gid long, lo double, hi double, n long, x binary, c binary, y binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []

        def rows(data: np.ndarray, last: bool) -> tuple[list[tuple], np.ndarray]:
            """Full blocks, and what is left of the last group unless nothing follows."""
            nonlocal number
            out = []
            edges = np.flatnonzero(np.diff(data[0], prepend=np.nan, append=np.nan))
            for low, high in zip(edges[:-1], edges[1:]):
                while low < high and (high - low >= block or high < data.shape[1] or last):
                    end = min(low + block, high)
                    gid, x, c, y = data[:, low:end]
                    out.append((number, int(gid[0]), x[0], x[-1], int(c.sum()), x.tobytes(), c.tobytes(), y.tobytes()))
                    number, low = number + 1, end
            return out, data[:, low:] if len(edges) > 1 else data

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), *[pa.binary()] * 3]
            columns = list(zip(*out)) if out else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(4)]))
            out, rest = rows(np.concatenate(held, axis=1), False)
            held = [rest]
            yield batch_of(out)
        if held:
            yield batch_of(rows(held[0], True)[0])

    ordered = points.select("gid", "x", "c", "y").repartitionByRange("gid", "x").sortWithinPartitions("gid", "x")
    return stage(ordered.mapInArrow(cut, schema), "blocks")


_TARGET = "gid long, g int, x0 double, known long, wanted long, bid long"


def _edges_in_blocks(points: int, span: float, degree: int):
    """For one group's blocks: the blocks that the edge of each grid point's window may lie in, and how many rows surely lie inside."""

    def find(table: pa.Table) -> pa.Table:
        lo, hi, n, bid = (table[c].to_numpy() for c in ("lo", "hi", "n", "bid"))
        total = int(n.sum())
        wanted = min(max(int(np.ceil(total * span)), degree + 1), total)
        first, step = lo.min(), (hi.max() - lo.min()) / (points - 1)
        out = []
        for g in range(points):
            x0 = first + g * step
            far = np.maximum(np.abs(lo - x0), np.abs(hi - x0))
            near = np.where((lo <= x0) & (x0 <= hi), 0.0, np.minimum(np.abs(lo - x0), np.abs(hi - x0)))
            by_far, by_near = np.argsort(far, kind="stable"), np.argsort(near, kind="stable")
            most = far[by_far][np.searchsorted(np.cumsum(n[by_far]), wanted)]
            least = near[by_near][np.searchsorted(np.cumsum(n[by_near]), wanted)]
            inside = far < least
            unsure = ~inside & (near <= most)
            known = int(n[inside].sum())
            out += [(table["gid"][0].as_py(), g, x0, known, wanted, int(b)) for b in bid[unsure]]
        types = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in _TARGET.split(", ")])

    return find


def _width(table: pa.Table) -> pa.Table:
    """Distance of the wanted nearest row of one grid point, from the blocks it may lie in."""
    x = np.concatenate([np.frombuffer(b) for b in table["x"].to_pylist()])
    c = np.concatenate([np.frombuffer(b) for b in table["c"].to_pylist()])
    first = {k: table[k][0].as_py() for k in ("gid", "g", "x0", "known", "wanted")}
    d = np.abs(x - first["x0"])
    order = np.argsort(d, kind="stable")
    place = np.searchsorted(np.cumsum(c[order]), first["wanted"] - first["known"])
    return pa.table({"gid": [first["gid"]], "g": pa.array([first["g"]], pa.int32()), "x0": [first["x0"]], "h": [float(d[order][place])]})


def _local_sums(degree: int):
    """Weighted power sums of one block for every grid point whose window reaches it."""

    def add(block: pa.Table, windows: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("gid", "g", "x0", "w", "v", "b")}
        if block.num_rows:
            x, c, y = (np.frombuffer(block[k][0].as_py()) for k in ("x", "c", "y"))
            for r in windows.to_pylist():
                low, high = np.searchsorted(x, [r["x0"] - r["h"], r["x0"] + r["h"]])
                low, high = max(low - 1, 0), high + 1
                xs, cs, ys = x[low:high], c[low:high], y[low:high]
                d = np.abs(xs - r["x0"])
                here = (d < r["h"]) | (d == 0)
                xs, cs, ys, d = xs[here], cs[here], ys[here], d[here]
                weight = (1 - (d / r["h"]) ** 3) ** 3 if r["h"] > 0 else np.ones(len(d))
                powers = ((xs - r["x0"]) / (r["h"] if r["h"] > 0 else 1.0))[None, :] ** np.arange(2 * degree + 1)[:, None]
                out["gid"].append(block["gid"][0].as_py())
                out["g"].append(r["g"])
                out["x0"].append(r["x0"])
                out["w"].append((powers @ (weight * cs)).tolist())
                out["v"].append((powers @ (weight * weight * cs)).tolist())
                out["b"].append((powers[: degree + 1] @ (weight * cs * ys)).tolist())
        types = {"gid": pa.int64(), "g": pa.int32(), "x0": pa.float64()} | dict.fromkeys("wvb", pa.list_(pa.float64()))
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    return add


def loess(
    df: DataFrame, keys: list[str], x: str, y: str, span: float = 0.1, degree: int = 2, points: int = 80, level: float = 0.95, block: int = BLOCK
) -> DataFrame:
    """``keys..., g, x0, fit, lower, upper``: tricube-weighted local polynomials at ``points`` positions.

    Positions are equally spaced between a group's smallest and largest ``x``; the bandwidth is the exact distance of the
    ``span * n``-th nearest row. Rows with a NULL key, a NULL ``x``, or a NULL or NaN ``y`` are left out.
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    present = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y")
    for k in keys:
        present = present & F.col(k).isNotNull()
    # One row per distinct x: count, mean, and the squared deviations from the mean.
    merged = rows.where(present).groupBy(*keys, "x").agg(F.count("*").alias("c"), F.avg("y").alias("y"), (F.count("*") * F.var_pop("y")).alias("own"))
    merged = stage(merged, "distinct_x")
    groups = merged.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    groups = stage(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    placed = stage(join_groups(merged, groups, keys, staged=True).select("gid", "x", "c", "y", "own", "_lo", "_hi"), "points")
    blocks = _blocks(placed, block)
    ranges = blocks.select("gid", "bid", "lo", "hi", "n")
    unsure = ranges.groupBy("gid").applyInArrow(_edges_in_blocks(points, span, degree), _TARGET)
    looked = unsure.join(blocks.select("bid", "x", "c"), "bid")
    windows = stage(looked.groupBy("gid", "g").applyInArrow(_width, "gid long, g int, x0 double, h double"), "windows")
    reach = (F.col("lo") <= F.col("x0") + F.col("h")) & (F.col("hi") >= F.col("x0") - F.col("h"))
    met = windows.join(ranges, "gid").where(reach).select(F.col("bid").alias("block"), "g", "x0", "h")
    local = blocks.groupBy("bid").cogroup(met.groupBy("block")).applyInArrow(_local_sums(degree), "gid long, g int, x0 double, w array<double>, v array<double>, b array<double>")
    added = lambda c, size: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(size)]).alias(c)
    sums = local.groupBy("gid", "g", "x0").agg(added("w", 2 * degree + 1), added("v", 2 * degree + 1), added("b", degree + 1))
    fits = stage(sums.select("gid", "g", "x0", _solver(degree)("w", "v", "b").alias("s")).select("gid", "g", "x0", "s.*"), "fits")
    names = groups.select(F.col("gid").alias("_gid"), *keys)
    return _with_band(placed, fits, points, level).join(names, F.col("gid") == F.col("_gid")).select(*keys, "g", "x0", "fit", "lower", "upper")


def _with_band(placed: DataFrame, fits: DataFrame, points: int, level: float) -> DataFrame:
    """Residual spread from the curve interpolated between grid points, then a t band around the fit."""
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    place = F.when(step > 0, (F.col("x") - F.col("_lo")) / step).otherwise(0.0)
    rows = placed.withColumn("_place", place).withColumn("g", F.least(F.floor("_place"), F.lit(points - 2)).cast("int"))
    left = fits.select("gid", "g", F.col("fit").alias("f0"), F.col("lever").alias("l0"))
    right = fits.select("gid", (F.col("g") - 1).alias("g"), F.col("fit").alias("f1"), F.col("lever").alias("l1"))
    share: Column = F.col("_place") - F.col("g")
    residual = F.col("y") - (F.col("f0") * (1 - share) + F.col("f1") * share)
    spread = (
        join_groups(rows, left.join(right, ["gid", "g"]), ["gid", "g"])
        .groupBy("gid")
        .agg(
            F.sum(F.col("own") + F.col("c") * residual * residual).alias("_sse"),
            (F.sum("c") - F.sum(F.col("c") * (F.col("l0") * (1 - share) + F.col("l1") * share))).alias("_dof"),
        )
    )
    half = t_critical(F.col("_dof"), F.lit(float(level))) * F.col("norm") * F.sqrt(F.col("_sse") / F.col("_dof"))
    half = F.when(F.col("_dof") > 0, half)
    return fits.join(spread, "gid").select("gid", "g", "x0", "fit", (F.col("fit") - half).alias("lower"), (F.col("fit") + half).alias("upper"))

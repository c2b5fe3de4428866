"""Covariance, simple regression, density grids, confusion matrices and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import ieee


def _pairs(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Pairs of which neither value is missing."""
    return df.select(ieee.valid(x).alias("x"), ieee.valid(y).alias("y")).filter("x is not null and y is not null")


def covariance(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: n, means, sample deviations and variances, covariance and correlation."""
    return _pairs(df, x, y).agg(
        F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), F.stddev_samp("x").alias("x_sd"), F.stddev_samp("y").alias("y_sd"),
        F.var_samp("x").alias("x_var"), F.var_samp("y").alias("y_var"), F.covar_samp("x", "y").alias("covariance"), F.corr("x", "y").alias("correlation"),
    )


def linear_regression(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: rows, beta0, beta1, their standard errors, r2, ssto, sse, ssr."""
    a = _pairs(df, x, y).agg(
        F.regr_count("y", "x").alias("rows"), F.regr_intercept("y", "x").alias("beta0"), F.regr_slope("y", "x").alias("beta1"), F.regr_r2("y", "x").alias("r2"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("ssto"), F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("mx"),
    )
    ssr = F.col("beta1") * F.col("sxy")
    sse = F.col("ssto") - ssr
    var = ieee.div(sse, F.col("rows") - 2)
    return a.select(
        "rows", "beta0", "beta1",
        F.sqrt(var * (ieee.div(F.lit(1.0), F.col("rows")) + ieee.div(F.col("mx") * F.col("mx"), F.col("sxx")))).alias("beta0_std_err"),
        F.sqrt(ieee.div(var, F.col("sxx"))).alias("beta1_std_err"), "r2", "ssto", sse.alias("sse"), ssr.alias("ssr"),
    )


def density(df: DataFrame, x: Column, y: Column, width: int = 800, height: int = 800) -> DataFrame:
    """px, py, count: rows in each pixel of a grid over the ranges of x and y, at most 255."""
    p = _pairs(df, x, y)
    r = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()

    def pixel(c: str, lo: float | None, hi: float | None, n: int) -> Column:
        span = (hi - lo) if lo is not None and hi != lo else 1.0
        return F.least(F.floor((F.col(c) - F.lit(lo or 0.0)) / F.lit(span) * n), F.lit(n - 1)).cast("int")

    at = p.select(pixel("x", r["x0"], r["x1"], width).alias("px"), pixel("y", r["y0"], r["y1"], height).alias("py"))
    return at.groupBy("px", "py").agg(F.least(F.count("*"), F.lit(255)).alias("count"))


def threshold_counts(df: DataFrame, actual: Column, predicted: Column, thresholds: Sequence[float]) -> DataFrame:
    """threshold, tn, fp, fn, tp for each threshold: positive if predicted >= threshold. One pass, few rows for the driver."""
    ts = np.array(sorted(thresholds), dtype=float)
    rows = df.select(ieee.dbl(actual).alias("a"), ieee.dbl(predicted).alias("p")).filter("a is not null and p is not null")
    found = totals(rows, lambda a, p: by_threshold(a, p, ts), 2 * (len(ts) + 1))
    return df.sparkSession.createDataFrame(matrices(found, ts), "threshold double, tn long, fp long, fn long, tp long")


def totals(rows: DataFrame, part: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of part(columns as arrays), an array of so many numbers.

    A task adds up its batches, and the tasks' arrays are added up entry by
    entry before the driver sees them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        with np.errstate(all="ignore"):
            for b in batches:
                if b.num_rows:
                    total += part(*(c.to_numpy(zero_copy_only=False) for c in b.columns))
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

    sums = {r["k"]: r["v"] for r in rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return np.array([sums.get(k, 0.0) for k in range(size)])


def by_threshold(actual: np.ndarray, predicted: np.ndarray, ts: np.ndarray) -> np.ndarray:
    """Rows by how many of the sorted thresholds they reach: those that count as true, then the others. NaN is above all."""
    bins = np.searchsorted(ts, predicted, side="right")
    return np.concatenate([np.bincount(bins[(actual != 0) == t], minlength=len(ts) + 1) for t in (True, False)]).astype(float)


def matrices(found: np.ndarray, ts: np.ndarray) -> list[tuple[float, int, int, int, int]]:
    """threshold, tn, fp, fn, tp from the sums of by_threshold()."""
    pos, neg = (x[::-1].cumsum()[::-1] for x in found.astype(np.int64).reshape(2, -1))
    return [(float(t), int(neg[0] - neg[k + 1]), int(neg[k + 1]), int(pos[0] - pos[k + 1]), int(pos[k + 1])) for k, t in enumerate(ts)]


def class_errors(tn: int, fp: int, fn: int, tp: int) -> tuple[float, float]:
    """Error of class 0 and of class 1; 0 for a class without rows."""
    return (fp / (tn + fp) if tn + fp else 0.0), (fn / (fn + tp) if fn + tp else 0.0)


#: What a threshold is chosen by.
METRICS = {
    "MAXC": lambda tn, fp, fn, tp: max(class_errors(tn, fp, fn, tp)),
    "SUMC": lambda tn, fp, fn, tp: sum(class_errors(tn, fp, fn, tp)),
    "TOTAL": lambda tn, fp, fn, tp: (fp + fn) / max(1, tn + fp + fn + tp),
}


def best_threshold(matrices: Sequence[tuple[float, int, int, int, int]], metric: str = "SUMC") -> int:
    """Place of the first matrix with the least error."""
    return min(range(len(matrices)), key=lambda k: (METRICS[metric](*matrices[k][1:]), k))


def auc(matrices: Sequence[tuple[float, int, int, int, int]]) -> float:
    """Area under the curve through the thresholds' points, from (1, 1) to (0, 0), by trapezoids."""
    area, x0, y0 = 0.0, 1.0, 1.0
    for _, tn, fp, fn, tp in sorted(matrices):
        x, y = (fp / (tn + fp) if tn + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
        area += (x0 - x) * (y0 + y) / 2
        x0, y0 = x, y
    return area + x0 * y0 / 2


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """actual, predicted, count of classes; rows that miss either are left out."""
    c = df.select(actual.alias("actual"), predicted.alias("predicted")).filter("actual is not null and predicted is not null")
    return c.groupBy("actual", "predicted").agg(F.count("*").alias("count"))


#: Columns up to which the sums of products are one aggregate of built-in functions; more outgrow a generated method.
_FEW = 12


def moments(df: DataFrame, xs: Sequence[Column], y: Column, w: Column | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """n, and the weighted sums xx and xy of gram() as arrays on the driver.

    Many columns are multiplied batch by batch; a task gives one matrix, and
    those are added up entry by entry before the driver sees the sum.
    """
    p = len(xs) + 1
    if p <= _FEW:
        r = gram(df, xs, y, w).first()
        xx = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
        return r["n"], xx, np.array([r[f"xy_{i}"] for i in range(p)], dtype=float)
    return many_moments(df, xs, [(y, w if w is not None else F.lit(1.0))])[0]


def many_moments(df: DataFrame, xs: Sequence[Column], weighted: Sequence[tuple[Column, Column]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """moments() of the same columns for several pairs of y and w, in one pass; a row that misses a pair's value is left out of that pair."""
    p, n = len(xs) + 1, len(weighted)
    size = p * (p + 1) + 1
    named = df.select(*(ieee.dbl(x).alias(f"x{k}") for k, x in enumerate(xs)), *(ieee.dbl(c).alias(f"{a}{k}") for k, pair in enumerate(weighted) for a, c in zip("yw", pair, strict=True)))
    named = named.na.drop(subset=[f"x{k}" for k in range(p - 1)]) if p > 1 else named

    def part(*columns: np.ndarray) -> np.ndarray:
        x = np.column_stack([*columns[: p - 1], np.ones(len(columns[0]))]).astype(float, copy=False)
        out = []
        for y, w in zip(columns[p - 1 :: 2], columns[p::2], strict=True):
            z, v = np.column_stack([x, y]), w
            if not (on := ~(np.isnan(y) | np.isnan(w))).all():
                z, v = z[on], w[on]
            out += [((z[:, :p] * v[:, None]).T @ z).ravel(), [float(len(z))]]
        return np.concatenate(out)

    found = totals(named, part, n * size).reshape(n, size)
    return [(int(r[-1]), r[:-1].reshape(p, p + 1)[:, :p], r[:-1].reshape(p, p + 1)[:, p]) for r in found]


def gram(df: DataFrame, xs: Sequence[Column], y: Column, w: Column | None = None) -> DataFrame:
    """One row: n, and the weighted sums xx_i_j (i <= j), xy_i, yy over rows without missing values; the last x is 1."""
    cols = [*(ieee.dbl(x) for x in xs), F.lit(1.0)]
    p = len(cols)
    named = df.select(*(c.alias(f"x{k}") for k, c in enumerate(cols)), ieee.dbl(y).alias("y"), (ieee.dbl(w) if w is not None else F.lit(1.0)).alias("w"))
    named = named.na.drop()
    aggs = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx_{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(F.col("w") * F.col(f"x{i}") * F.col("y")).alias(f"xy_{i}") for i in range(p)]
    return named.agg(F.count("*").alias("n"), *aggs, F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"))

"""Neighbourhood operators as separable window functions with reflected edges.

Each axis is one window over one row or column of cells, so that work spreads over rows and nothing larger than a row is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.grid import inside, mirrored


def along(cells: DataFrame, axis: str, side: int, low: int, high: int, over: Callable[[Window], dict[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """New columns from windows of low cells before to high cells after along an axis (r or c) of `side` cells, edges reflected. by names the keys of grids of equal size in one table."""
    other = "c" if axis == "r" else "r"
    w = Window.partitionBy(*by, other).orderBy(axis).rangeBetween(-low, high)
    return inside(mirrored(cells, axis, side, low, high).withColumns(over(w)), axis, side)


def separable(cells: DataFrame, v: str, out: str, sides: tuple[int, int], low: int, high: int, agg: Callable[[Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """agg over columns, then over rows; right for means, extremes and sums."""
    a = along(cells, "c", sides[1], low, high, lambda w: {out: agg(F.col(v)).over(w)}, by)
    return along(a, "r", sides[0], low, high, lambda w: {out: agg(F.col(out)).over(w)}, by)


def odd(metres: float, res: float) -> int:
    """Cells of a window of so many metres, odd and three at least."""
    return max(3, int(round(metres / res)) | 1)


def box_mean(cells: DataFrame, v: str, out: str, sides: tuple[int, int], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over size x size cells; an even size reaches one cell further back than forward."""
    return separable(cells, v, out, sides, size // 2, size - size // 2 - 1, F.avg, by)


def box_max(cells: DataFrame, v: str, out: str, sides: tuple[int, int], size: int, by: Sequence[str] = ()) -> DataFrame:
    return separable(cells, v, out, sides, size // 2, size - size // 2 - 1, F.max, by)


def gauss_weights(sigma: float) -> list[float]:
    k = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    return [x / sum(w) for x in w]


def _weigh(weights: Sequence[float], x: Column) -> Column:
    ws = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(x, ws, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)


#: Weights to a side beyond which lines are convolved by transforms, and lines in a group of these.
LONG, LINES = 64, 16


def _line_pass(cells: DataFrame, v: str, axis: str, side: int, weights: Sequence[float]) -> DataFrame:
    """(r, c, _v): the weights along the lines of an axis, by Fourier transforms of whole lines; null where a cell in reach is missing."""
    other, k = ("c" if axis == "r" else "r"), len(weights) // 2
    n = 1 << (side + 2 * k + len(weights)).bit_length()

    def run(key, t):
        line, at, x = (t.column(name).to_numpy() for name in (other, axis, v))
        kernel, out = np.fft.rfft(np.array(weights), n), np.empty(len(x))
        for one in np.unique(line):
            here = np.flatnonzero(line == one)
            full, there = np.zeros(side), np.zeros(side, bool)
            full[at[here]], there[at[here]] = x[here], True
            wide = np.pad(full, k, "symmetric")
            got = np.fft.irfft(np.fft.rfft(wide, n) * kernel, n)[2 * k : 2 * k + side]
            if not there.all():
                gaps = np.cumsum(np.r_[0, ~np.pad(there, k, "symmetric")])
                got[gaps[2 * k + 1 :] > gaps[: -2 * k - 1]] = np.nan
            out[here] = got[at[here]]
        return pa.table({"r": t.column("r"), "c": t.column("c"), "_v": pa.array(out, mask=np.isnan(out))})

    return cells.select("r", "c", F.col(v).cast("double").alias(v)).groupBy(F.expr(f"{other} div {LINES}")).applyInArrow(run, "r int, c int, _v double")


def convolve(cells: DataFrame, v: str, out: str, sides: tuple[int, int], weights: Sequence[float]) -> DataFrame:
    """The same weights along both axes. v must not be null. Wide kernels cost a cell the logarithm of a line's length and not their own."""
    k = len(weights) // 2
    if k > LONG:
        smooth = _line_pass(_line_pass(cells, v, "c", sides[1], weights), "_v", "r", sides[0], weights)
        return cells.drop(out).join(smooth.withColumnRenamed("_v", out), ["r", "c"])
    step = lambda col: lambda w: {out: _weigh(weights, F.collect_list(col).over(w))}
    return along(along(cells, "c", sides[1], k, k, step(v)), "r", sides[0], k, k, step(out))


def gaussian(cells: DataFrame, v: str, out: str, sides: tuple[int, int], sigma: float) -> DataFrame:
    return convolve(cells, v, out, sides, gauss_weights(sigma))


def gaussian_present(cells: DataFrame, v: str, out: str, sides: tuple[int, int], sigma: float) -> DataFrame:
    """Gaussian over what is there: smoothed value over smoothed mask, null where nothing is near."""
    filled = cells.withColumn("_v", F.coalesce(v, F.lit(0.0))).withColumn("_m", F.col(v).isNotNull().cast("double"))
    both = gaussian(gaussian(filled, "_v", "_v", sides, sigma), "_m", "_m", sides, sigma)
    return both.withColumn(out, F.when(F.col("_m") > 1e-9, F.col("_v") / F.col("_m"))).drop("_v", "_m")


def derivative(cells: DataFrame, v: str, out: str, axis: str, res: float = 1.0) -> DataFrame:
    """Central differences, one-sided at the edges of the grid; null beside a cell that is null or missing."""
    w, at, x = Window.partitionBy("c" if axis == "r" else "r").orderBy(axis), F.col(axis), F.col(v)
    first, last = F.lag(axis).over(w).isNull(), F.lead(axis).over(w).isNull()
    before, after = F.when(F.lag(axis).over(w) == at - 1, F.lag(v).over(w)), F.when(F.lead(axis).over(w) == at + 1, F.lead(v).over(w))
    return cells.withColumn(out, F.when(first, after - x).when(last, x - before).otherwise((after - before) / 2) / res)


def slope_aspect(cells: DataFrame, v: str, res: float) -> DataFrame:
    """Columns slope, aspect (degrees) and cool (1 on north slopes, 0 on south slopes)."""
    d = derivative(derivative(cells, v, "_dy", "r", res), v, "_dx", "c", res)
    d = d.withColumn("slope", F.degrees(F.atan(F.hypot("_dx", "_dy")))).withColumn("aspect", F.pmod(F.degrees(F.atan2(F.col("_dy"), -F.col("_dx"))) + 360, F.lit(360.0)))
    return d.withColumn("cool", (F.cos(F.radians("aspect")) + 1) / 2).drop("_dx", "_dy")


def saddle(cells: DataFrame, v: str, out: str) -> DataFrame:
    """-(product of the eigenvalues) of the second derivatives where it is negative, else 0. v is smoothed already."""
    d = derivative(derivative(cells, v, "_a", "r"), v, "_b", "c")
    d = derivative(derivative(derivative(d, "_a", "_aa", "r"), "_a", "_ab", "c"), "_b", "_bb", "c")
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    return d.withColumn(out, F.when(det < 0, -det).otherwise(0.0)).drop("_a", "_b", "_aa", "_ab", "_bb")


def local_peaks(cells: DataFrame, v: str, sides: tuple[int, int], distance: int, least: Column) -> DataFrame:
    """Cells above `least` that no cell within `distance` (in either axis) outranks; rank is by value, then r, then c."""
    key = F.struct(F.col(v).alias("v"), (-F.col("r")).alias("nr"), (-F.col("c")).alias("nc"))
    ranked = separable(cells.withColumn("_key", key), "_key", "_best", sides, distance, distance, F.max)
    return ranked.where((F.col("_key") == F.col("_best")) & (F.col(v) > least)).drop("_key", "_best")

"""Focus areas: spaced peaks of a smoothed surface, grown over related ground, ranked by extent times quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.core import materialize
from cellweave.operators.focal import gaussian, local_peaks
from cellweave.operators.zonal import global_rank

# Shares of the bar that ground must clear to belong to an area, and the steps of relaxation.
GROW_FLOOR, GROW_PEAK, RAW_SHARE, TARGET_AREAS = 0.72, 0.80, 0.70, 3
PASSES = ((1.0, 0.82, 1.0), (0.8, 0.70, 0.5))  # bar, gate, least area, each as a share
LADDER = (0.96, 0.92, 0.88, 0.84, 0.80)
BUCKET = 32


def _grow(key, t: pa.Table, closing: int) -> pa.Table:
    """The connected ground around a peak, closed by `closing` steps and without holes."""
    r, c, ok = t.column("r").to_numpy(), t.column("c").to_numpy(), t.column("ok").to_numpy(zero_copy_only=False)
    r0, c0 = int(r.min()), int(c.min())
    shape = (int(r.max()) - r0 + 1, int(c.max()) - c0 + 1)
    ground, known = np.zeros(shape, bool), np.zeros(shape, bool)
    known[r - r0, c - c0] = True
    ground[r - r0, c - c0] = ok
    own = np.zeros(shape, bool)
    start = (t.column("pr")[0].as_py() - r0, t.column("pc")[0].as_py() - c0)

    def flood(mask: np.ndarray, seeds: list) -> np.ndarray:
        out, todo = np.zeros(shape, bool), [s for s in seeds if mask[s]]
        for s in todo:
            out[s] = True
        while todo:
            a, b = todo.pop()
            for x, y in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= x < shape[0] and 0 <= y < shape[1] and mask[x, y] and not out[x, y]:
                    out[x, y] = True
                    todo.append((x, y))
        return out

    def wider(m: np.ndarray) -> np.ndarray:
        w = m.copy()
        w[1:] |= m[:-1]
        w[:-1] |= m[1:]
        w[:, 1:] |= m[:, :-1]
        w[:, :-1] |= m[:, 1:]
        return w

    if ground[start]:
        own = flood(ground, [start])
        if closing:
            big = np.pad(own, closing)
            shape = big.shape
            for _ in range(closing):
                big = wider(big)
            for _ in range(closing):
                big = ~wider(~big)
            border = [(i, j) for i in range(shape[0]) for j in (0, shape[1] - 1)] + [(i, j) for j in range(shape[1]) for i in (0, shape[0] - 1)]
            big = ~flood(~big, border)
            own = big[closing:-closing, closing:-closing] & known
    a, b = np.nonzero(own)
    return pa.table({"peak": pa.array([key[0].as_py()] * len(a), pa.int64()), "r": pa.array((a + r0).astype(np.int32)), "c": pa.array((b + c0).astype(np.int32))})


def grow(cells: DataFrame, peaks: DataFrame, smooth: str, raw: str, bar: float, gate: float, radius: int, closing: int = 2) -> DataFrame:
    """(peak, r, c): ground within radius of each peak (peak, r, c, smooth) that clears both bars and hangs together with it."""
    near = peaks.select("peak", F.col("r").alias("pr"), F.col("c").alias("pc"), F.col(smooth).alias("top"))
    tiles = near.withColumn("tr", F.explode(F.sequence(F.floor((F.col("pr") - radius) / BUCKET), F.floor((F.col("pr") + radius) / BUCKET)))).withColumn("tc", F.explode(F.sequence(F.floor((F.col("pc") - radius) / BUCKET), F.floor((F.col("pc") + radius) / BUCKET))))
    seen = cells.withColumns({"tr": F.floor(F.col("r") / BUCKET), "tc": F.floor(F.col("c") / BUCKET)}).join(tiles, ["tr", "tc"])
    seen = seen.where((F.col("r") - F.col("pr")) ** 2 + (F.col("c") - F.col("pc")) ** 2 <= radius * radius)
    ok = (F.col(smooth) >= F.greatest(F.lit(bar * GROW_FLOOR), F.col("top") * gate * GROW_PEAK)) & (F.col(raw) >= bar * RAW_SHARE)
    seen = seen.select("peak", "pr", "pc", "r", "c", F.coalesce(ok, F.lit(False)).alias("ok"))
    return seen.groupBy("peak").applyInArrow(lambda key, t: _grow(key, t, closing), "peak long, r int, c int")


def areas_at(cells: DataFrame, sides: tuple[int, int], smooth: str, raw: str, bar: float, gate: float, spacing: int, radius: int, least_cells: int, closing: int = 2) -> DataFrame:
    """(rank, peak, r, c): areas at one bar, each cell in its best-ranked area only."""
    p = local_peaks(cells, smooth, sides, spacing, F.lit(bar)).withColumn("peak", F.col("r").cast("long") * sides[1] + F.col("c"))
    grown = materialize(grow(cells, p, smooth, raw, bar, gate, radius, closing), "grown")
    scored = grown.join(cells.select("r", "c", F.col(raw).alias("_v")), ["r", "c"])
    per = scored.groupBy("peak").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_v"), 9).alias("mean")).where(F.col("n") >= least_cells)
    per = global_rank(per.withColumn("_worth", -(F.col("n") * F.col("mean"))), ["_worth", "peak"], "rank").withColumn("rank", F.col("rank").cast("int"))
    best = Window.partitionBy("r", "c").orderBy("rank")
    return grown.join(per.select("peak", "rank"), "peak").withColumn("_n", F.row_number().over(best)).where("_n = 1").select("rank", "peak", "r", "c")


def focus_areas(cells: DataFrame, sides: tuple[int, int], surface: str, floor: float, sigma: float, spacing: int, radius: int, least_cells: int, target: int = TARGET_AREAS) -> DataFrame:
    """(rank, peak, r, c) of the best areas: at the absolute bar, then relaxed, then down a ladder of percentiles until there are `target` of them."""
    cells = materialize(gaussian(cells.select("r", "c", F.coalesce(surface, F.lit(0.0)).alias("_raw")), "_raw", "_smooth", sides, sigma), "smooth")
    found, n = None, -1

    def attempt(bar: float, gate: float, least: int) -> bool:
        nonlocal found, n
        new = materialize(areas_at(cells, sides, "_smooth", "_raw", bar, gate, spacing, radius, least), "areas")
        count = new.agg(F.countDistinct("rank")).head()[0]
        if count > n:
            found, n = new, count
        return n >= target

    for bar, gate, least in PASSES:
        if attempt(floor * bar, gate, max(1, int(least_cells * least))):
            return found
    bars = cells.agg(F.percentile("_smooth", F.array(*[F.lit(x) for x in LADDER]))).head()[0] or []
    for bar in bars:
        if attempt(min(floor, bar), PASSES[-1][1], max(1, least_cells // 2)):
            break
    return found


def best_sites(cells: DataFrame, sides: tuple[int, int], areas: DataFrame, v: str, spacing: int, least: float, k: int) -> DataFrame:
    """(rank, site, r, c, v): the k best spaced peaks of a surface in each area."""
    inside = cells.join(areas.select("rank", "r", "c"), ["r", "c"], "left")
    p = local_peaks(inside.select("r", "c", "rank", F.when(F.col("rank").isNotNull(), F.col(v)).otherwise(F.lit(-1.0)).alias(v)), v, sides, spacing, F.lit(least)).where("rank is not null")
    w = Window.partitionBy("rank").orderBy(F.desc(v), "r", "c")
    return p.withColumn("site", F.row_number().over(w).cast("int")).where(F.col("site") <= k).select("rank", "site", "r", "c", v)

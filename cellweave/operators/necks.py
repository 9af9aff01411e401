"""Necks of passable ground: where they pinch and whether they link two sides."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.algebra import funnel_strength
from cellweave.operators.focal import box_max, box_mean, odd
from cellweave.operators.shapes import euclidean, labels

# Sides in km2, halo in metres, margins in cells of the analysis grid, widths in metres.
LEAST_SIDE, FULL_SIDE, HALO_M, CUT_MARGIN, RING = 0.5, 5.0, 6000.0, 2, 2
NECK_M, OFF_BARRIER_M = 600.0, 20.0
BUCKET = 64


def windows(res: float, grid_res: float | None = None) -> tuple[int, int]:
    """Sides in cells of the windows in which a ridge stands out and over which it is pinched."""
    return max(3, int(round(3 * (grid_res or res) / res)) | 1), odd(600, res)


def pinched(d: DataFrame, res: float) -> DataFrame:
    """strength from (barrier, db, _top, _mean): above zero on ridges of narrow, pinched ground."""
    ridge = (F.col("db") >= F.col("_top") - 1e-6) & ~F.col("barrier") & (F.col("db") > max(res, OFF_BARRIER_M)) & (2 * F.col("db") < NECK_M)
    return d.withColumn("strength", F.when(ridge, funnel_strength(F.col("db"), F.col("_mean"))).otherwise(0.0)).drop("_top", "_mean")


def constriction(cells: DataFrame, barrier: Column, res: float, sides: tuple[int, int], grid_res: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(.., r, c, barrier, db, strength): db is the distance to the barrier, strength is above zero on ridges of narrow, pinched ground. by names the keys of grids of equal size in one table; grid_res is what a cell of the working grid measures."""
    top, mean = windows(res, grid_res)
    d = euclidean(cells.select(*by, "r", "c", barrier.alias("barrier")), F.col("barrier"), "db", res, by)
    return pinched(box_mean(box_max(d, "db", "_top", sides, top, by), "db", "_mean", sides, mean, by), res)


def _grow(mask: np.ndarray, k: int) -> np.ndarray:
    for _ in range(k):
        wide = mask.copy()
        wide[1:] |= mask[:-1]
        wide[:-1] |= mask[1:]
        wide[:, 1:] |= mask[:, :-1]
        wide[:, :-1] |= mask[:, 1:]
        mask = wide
    return mask


def _pieces(mask: np.ndarray) -> tuple[np.ndarray, int]:
    out = np.zeros(mask.shape, np.int64)
    n = 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start] = n
        todo = [start]
        while todo:
            a, b = todo.pop()
            for x, y in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= x < mask.shape[0] and 0 <= y < mask.shape[1] and mask[x, y] and not out[x, y]:
                    out[x, y] = n
                    todo.append((x, y))
    return out, n


def _sides(key, t: pa.Table, ring: int) -> pa.Table:
    """Cut the ground across a neck and measure the two largest pieces that the cut touches."""
    r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
    r, c = r - r.min(), c - c.min()
    shape = (int(r.max()) + 1, int(c.max()) + 1)
    ground, core = np.zeros(shape, bool), np.zeros(shape, bool)
    ground[r, c] = t.column("passable").to_numpy(zero_copy_only=False)
    core[r, c] = t.column("core").to_numpy(zero_copy_only=False)
    cut = _grow(core, t.column("rad")[0].as_py())
    pieces, n = _pieces(ground & ~cut)
    touched = sorted((int((pieces == p).sum()) for p in set(np.unique(pieces[_grow(cut, ring) & ~cut & ground]).tolist()) - {0}), reverse=True)
    first, second = (touched + [0, 0])[:2] if n > 1 and len(touched) > 1 else (0, 0)
    return pa.table({"label": pa.array([key[0].as_py()], pa.int64()), "pieces": pa.array([n], pa.int64()), "first": pa.array([first], pa.int64()), "second": pa.array([second], pa.int64())})


def neck_sides(cells: DataFrame, core: Column, passable: Column, half_width: Column, width: int, halo: int, margin: int = CUT_MARGIN, ring: int = RING) -> DataFrame:
    """(label, pieces, first, second): for each neck (component of core) the cells of the two largest pieces that a cut across it parts; zeros where it parts none.

    half_width is in cells. Each neck sees the window around it only, so work is bounded by the halo.
    """
    ground = cells.select("r", "c", passable.alias("passable"), core.alias("core"), half_width.alias("half"))
    named = labels(ground, F.col("core"), "label", width)
    box = named.join(ground.select("r", "c", "half"), ["r", "c"]).groupBy("label").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), (F.ceil(F.max("half")) + margin).cast("int").alias("rad"))
    pad = F.col("rad") + halo
    box = box.select("label", "rad", (F.col("r0") - pad).alias("r0"), (F.col("r1") + pad).alias("r1"), (F.col("c0") - pad).alias("c0"), (F.col("c1") + pad).alias("c1"))
    tiles = box.withColumn("tr", F.explode(F.sequence(F.floor(F.col("r0") / BUCKET), F.floor(F.col("r1") / BUCKET)))).withColumn("tc", F.explode(F.sequence(F.floor(F.col("c0") / BUCKET), F.floor(F.col("c1") / BUCKET))))
    placed = ground.withColumns({"tr": F.floor(F.col("r") / BUCKET), "tc": F.floor(F.col("c") / BUCKET)})
    seen = placed.join(tiles, ["tr", "tc"]).where("r between r0 and r1 and c between c0 and c1")
    own = named.select("r", "c", F.col("label").alias("own"))
    seen = seen.join(own, ["r", "c"], "left").select("label", "rad", "r", "c", "passable", F.coalesce(F.col("own") == F.col("label"), F.lit(False)).alias("core"))
    return seen.groupBy("label").applyInArrow(lambda key, t: _sides(key, t, ring), "label long, pieces long, first long, second long")


def linkage(second_km2: Column) -> Column:
    """0 for a stub, rising to 1 at FULL_SIDE km2 on the smaller side."""
    return F.when(second_km2 < LEAST_SIDE, 0.0).otherwise(F.least(F.lit(1.0), second_km2 / FULL_SIDE))


def destination(feed_a: Column, cover_a: Column, feed_b: Column, cover_b: Column, floor: float = 0.6, same: float = 0.6) -> tuple[Column, Column]:
    """(weight, text) of a neck from the 90th percentiles of feed and cover on its sides: food on one side and cover on the other count most."""
    pair = F.greatest(F.least(feed_a, cover_b), F.least(feed_b, cover_a))
    both = F.least(F.greatest(feed_a, cover_a), F.greatest(feed_b, cover_b))
    dest = F.least(F.lit(1.0), F.greatest(F.lit(0.0), pair, same * both))

    def side(feed: Column, cover: Column) -> Column:
        return F.when((feed < 0.20) & (cover < 0.20), "open").when(F.abs(feed - cover) < 0.10, "mixed").when(feed > cover, "food").otherwise("cover")

    a, b = side(feed_a, cover_a), side(feed_b, cover_b)
    text = F.when(a == b, F.concat(F.lit("same: "), a)).when(((a == "food") & (b == "cover")) | ((a == "cover") & (b == "food")), "food to cover").otherwise(F.concat_ws(" to ", a, b))
    return floor + (1 - floor) * dest, text

"""How much of what a surface can tell apart ends up in the selected ground, against equal areas chosen without it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.core import materialize
from cellweave.operators.focal import gaussian
from cellweave.operators.shapes import labels
from cellweave.operators.zonal import first_n, spearman

# Headroom below which nothing can be captured, the share of it a selection has to keep, how far it may agree with a road buffer, patches of the random draw for each of its own.
MIN_HEADROOM, LEAST_CAPTURE, MOST_OVERLAP, PATCHES = 0.02, 0.25, 0.75, 5
BORDER_M = 2000.0


def pool(cells: DataFrame, sides: tuple[int, int], res: float, allowed: Column) -> DataFrame:
    """cells with pool: the ground an extraction may choose from. Near the border filters see reflections, so a strip is left out."""
    m = max(5, round(BORDER_M / res))
    inside = F.col("r").between(m, sides[0] - 1 - m) & F.col("c").between(m, sides[1] - 1 - m)
    return cells.withColumn("pool", inside & F.coalesce(allowed, F.lit(False)))


def blob_sigma(n: int) -> float:
    """How far an area of n cells looks around."""
    return max(2.0, math.sqrt(n / math.pi) / 2)


def oracle_blob(cells: DataFrame, v: str, sides: tuple[int, int], n: int) -> DataFrame:
    """(r, c): the n cells of the pool nearest to where v, smoothed at the scale of such an area, is highest. The same shape of thing as a focus area, at the best place."""
    ground = cells.select("r", "c", "pool", F.when(F.col("pool"), F.coalesce(v, F.lit(0.0))).otherwise(0.0).alias("_v"))
    smooth = gaussian(ground, "_v", "_s", sides, blob_sigma(n))
    at = smooth.where("pool").agg(F.max(F.struct(F.round("_s", 9).alias("s"), (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("b")).select((-F.col("b.r")).alias("_br"), (-F.col("b.c")).alias("_bc"))
    at = materialize(at, "blob")  # not smoothed again for each histogram below
    near = cells.where("pool").select("r", "c").crossJoin(F.broadcast(at))  # one row
    near = near.select("r", "c", ((F.col("r") - F.col("_br")) ** 2 + (F.col("c") - F.col("_bc")) ** 2).alias("_d"))
    return first_n(near, ["_d", "r", "c"], n).select("r", "c")


def patches(cells: DataFrame, width: int) -> DataFrame:
    """(patches) in one row: how many pieces the cells (r, c) hang together in."""
    return labels(cells, F.lit(True), "_l", width).agg(F.countDistinct("_l").alias("patches"))


def benchmark(cells: DataFrame, v: str, d_road: str, picked: str, random: Sequence[Column | str], sides: tuple[int, int]) -> DataFrame:
    """One row of measurements of the ground `picked` (boolean) within `pool`; random orders the cells of the random draw, without ties.

    The best n cells by value are what no area could reach (ceiling); the best blob of n cells is the fair target (oracle).
    """
    width = sides[1]
    chosen = [c for c in dict.fromkeys(["r", "c", v, d_road, picked, "pool"])]
    cells = materialize(cells.select(*chosen, F.struct(*random).alias("_rand")).withColumn(v, F.coalesce(F.col(v), F.lit(0.0))), "pool")
    ground = cells.where("pool")
    n = ground.where(picked).count()
    total = ground.count()
    road = first_n(ground.select("r", "c", F.coalesce(d_road, F.lit(float("inf"))).alias("_d")), ["_d", "r", "c"], n)
    best = first_n(ground.select("r", "c", (-F.col(v)).alias("_v")), ["_v", "r", "c"], n)
    rand = materialize(first_n(ground.select("r", "c", "_rand"), ["_rand", "r", "c"], n), "random")
    blob = oracle_blob(cells, v, sides, n)
    mean = lambda df, out: ground.join(df.select("r", "c"), ["r", "c"], "left_semi").agg(F.coalesce(F.avg(v), F.lit(0.0)).alias(out))
    rows = [
        ground.where(picked).agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("selected")), mean(rand, "random"), mean(best, "ceiling"), mean(blob, "oracle"),
        ground.where(picked).join(road.select("r", "c"), ["r", "c"], "left_semi").agg((F.count(F.lit(1)) / max(1, n)).alias("overlap_road")),
        patches(ground.where(picked).select("r", "c"), width).withColumnRenamed("patches", "patches_selected"), patches(rand.select("r", "c"), width).withColumnRenamed("patches", "patches_random"),
        spearman(ground.select("r", "c", v, (-F.coalesce(d_road, F.lit(1e6))).alias("_near")), v, "_near", ["r", "c"]).select(F.col("rho").alias("spearman_road")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.crossJoin(row)  # one row each
    headroom = F.col("oracle") - F.col("random")
    out = out.withColumns({"cells": F.lit(total).cast("long"), "n": F.lit(n).cast("long"), "headroom": headroom})
    out = out.withColumn("capture", F.when(headroom >= MIN_HEADROOM, (F.col("selected") - F.col("random")) / headroom))
    apart = (F.col("overlap_road") < MOST_OVERLAP) & (F.abs("spearman_road") < MOST_OVERLAP)
    coherent = F.col("patches_selected") * PATCHES < F.greatest(F.lit(1), F.col("patches_random"))
    return out.withColumns({"beats_road": apart, "beats_random": F.when(F.col("capture").isNotNull(), (F.col("capture") >= LEAST_CAPTURE) & coherent)})

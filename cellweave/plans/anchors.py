"""Where a party sleeps and leaves its vehicle: one camp and one staging point an area, by style of hunt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.vector import nearest
from cellweave.operators.zonal import member_point

# Fixed values, in metres: the best set-back of a camp from a road and how fast both sides fall, how near to water, the road that still counts, the farthest look in cells.
SET_BACK_M, BEYOND_M, PUT_IN_M, WATER_M, ROAD_WITHIN_M, MOST_STEPS = 400.0, 900.0, 500.0, 500.0, 5000.0, 60
STYLES = ("fixed", "vehicle", "spike")


def reach_cells(walk_km: float, res: float) -> int:
    """How many steps a camp may lie outside its area."""
    return min(max(2, round(walk_km * 1000 / res)), MOST_STEPS)


def flooded(areas: DataFrame, reach: int) -> DataFrame:
    """(rank, r, c0, c1): the cells within `reach` city-block steps of each area (rank, r, c) as disjoint runs of columns.

    Floods of all areas go in one pass and may overlap. What moves are runs, not cells: a run of an area reaches 2 * reach + 1 rows,
    each a step narrower than the row before, and runs of a row that touch become one.
    """
    row = Window.partitionBy("rank", "r").orderBy("c")
    cells = areas.select("rank", "r", "c").distinct()
    runs = cells.withColumn("_g", F.col("c") - F.row_number().over(row)).groupBy("rank", "r", "_g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    wide = runs.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_x", F.lit(reach) - F.abs("d"))
    wide = wide.select("rank", (F.col("r") + F.col("d")).cast("int").alias("r"), (F.col("c0") - F.col("_x")).alias("c0"), (F.col("c1") + F.col("_x")).alias("c1"))
    order = Window.partitionBy("rank", "r").orderBy("c0", "c1")
    before = F.max("c1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = wide.withColumn("_n", F.when(F.col("c0") <= before + 1, 0).otherwise(1)).withColumn("_g", F.sum("_n").over(order))
    return cut.groupBy("rank", "r", "_g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_g")


def access_kind(cells: DataFrame, d_road: str) -> DataFrame:
    """(kind) in one row: `road` if any road is near enough to count, else `water`."""
    return cells.agg(F.when(F.min(F.when(~F.isnan(d_road), F.col(d_road))) < ROAD_WITHIN_M, "road").otherwise("water").alias("kind"))


def camp_score(kind: Column, d_road: Column, d_water: Column, hunt: Column) -> Column:
    """Set back from the road but within an easy carry of it, or at the put-in; near water, on good ground. Unknown ground scores 0."""
    back = F.least(F.lit(1.0), F.greatest(F.lit(0.0), d_road / SET_BACK_M)) * F.exp(-F.greatest(F.lit(0.0), d_road - SET_BACK_M) / BEYOND_M)
    access = F.when(kind == "road", back).otherwise(F.exp(-d_water / PUT_IN_M))
    return F.coalesce(access * F.exp(-d_water / WATER_M) * hunt, F.lit(0.0))


def camps(areas: DataFrame, cells: DataFrame, score: str, reach: int) -> DataFrame:
    """(rank, r, c): of each area the best cell within reach (ties: the smaller row, then column); areas without a score above 0 have none."""
    spread = flooded(areas, reach).select("rank", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("r")).alias("r"), (-F.col("c")).alias("c")))
    top = spread.join(cells.where(F.col(score) > 0).select("r", "c", score), ["r", "c"]).groupBy("rank").agg(best.alias("b"))
    return top.select("rank", (-F.col("b.r")).alias("r"), (-F.col("b.c")).alias("c"))


def staging(areas: DataFrame, stages: DataFrame, width: int, start: float = 16.0) -> DataFrame:
    """(rank, r, c, walk): for each area the stage cell (r, c) nearest to the area's own middle cell, and how far, in cells."""
    middle = member_point(areas.select("rank", "r", "c"), "rank")
    points = middle.select(F.col("rank").alias("id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    targets = stages.select((F.col("r").cast("long") * width + F.col("c")).alias("id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    found = nearest(points, targets, start).where("target is not null")
    return found.select(F.col("id").alias("rank"), F.expr(f"cast(target div {width} as int)").alias("r"), F.expr(f"cast(target % {width} as int)").alias("c"), F.col("dist").alias("walk"))


def anchors(areas: DataFrame, cells: DataFrame, stages: DataFrame, style: str, reach: int, width: int, res: float, fixed: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pins, starts) of one style. pins (rank, legend, r, c, is_camp, walk_km) go on the map; starts (rank, r, c) are where routes of an area begin.

    A fixed camp is where every area is hunted from and is no pin, since the party named it. Who sleeps in the vehicle has a parking
    pin that is the camp. A spike hunt has both. cells has score; stages are cells of road, or of water where no road is mapped.
    """
    if style not in STYLES or (style == "fixed") != (fixed is not None):
        raise ValueError("style is one of fixed, vehicle, spike, and fixed has a cell")
    if style == "fixed":
        at = areas.select("rank").distinct().select("rank", F.lit(fixed[0]).alias("r"), F.lit(fixed[1]).alias("c"))
        return at.select("rank", F.lit("base_camp").alias("legend"), "r", "c", F.lit(True).alias("is_camp"), F.lit(None).cast("double").alias("walk_km")).where("false"), at
    parked = staging(areas, stages, width)
    parking = parked.select("rank", F.lit("parking").alias("legend"), "r", "c", F.lit(style == "vehicle").alias("is_camp"), F.round(F.col("walk") * res / 1000, 2).alias("walk_km"))
    if style == "vehicle":
        return parking, parked.select("rank", "r", "c")
    camp = camps(areas, cells, "score", reach)
    return parking.unionByName(camp.select("rank", F.lit("base_camp").alias("legend"), "r", "c", F.lit(True).alias("is_camp"), F.lit(None).cast("double").alias("walk_km"))), camp

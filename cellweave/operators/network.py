"""Water that has to be walked around, the ground a vehicle can use, and the finer grid on which necks are measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.shapes import euclidean
from cellweave.operators.vector import touched

#: Cells that a fine grid may have, its finest step and the least half-width of a river, both in metres (fixed values).
FINE_CELLS, FINEST_M, RIVER_M = 9_000_000, 5.0, 15.0
#: Sources of lines that a machine may ride; all others are for feet.
MOTORISED = ("official_trail", "official_rail")


def fine_step(res: Column, h: Column, w: Column) -> Column:
    """How many fine cells go along one cell: the largest odd number within the budget and the finest step, at least 1."""
    most = F.least(F.floor(F.sqrt(F.lit(float(FINE_CELLS)) / (h.cast("double") * w))), F.floor(res / FINEST_M)).cast("int")
    return F.greatest(F.lit(1), most - F.when(most % 2 == 0, 1).otherwise(0))


def water_barrier(cells: DataFrame, water: Column, river: Column, lake: Column, res: float, out: str = "barrier") -> DataFrame:
    """cells with out: raster water, lakes, and rivers or canals widened by the larger of a cell and RIVER_M. Wetland is no barrier."""
    flag = lambda x: F.coalesce(x, F.lit(False))
    near = euclidean(cells.withColumn("_river", flag(river)), F.col("_river"), "_d_river", res)
    return near.withColumn(out, flag(water) | flag(lake) | flag(F.col("_d_river") <= max(res, RIVER_M))).drop("_river", "_d_river")


def linear_layers(lines: DataFrame, x0: float, y0: float, res: float, w: int, h: int, motorised: Sequence[str] = MOTORISED) -> DataFrame:
    """(r, c, motor, foot) of the cells that lines (id, source, ring) touch: every line helps on foot, only the motorised ones carry a machine."""
    hit = touched(lines, x0, y0, res, w, h).join(lines.select("id", F.col("source").isin(*motorised).alias("_motor")), "id")
    return hit.groupBy("r", "c").agg(F.bool_or(F.coalesce("_motor", F.lit(False))).alias("motor")).withColumn("foot", F.lit(True))


def vehicle_networks(cells: DataFrame, kit: DataFrame, road: Column, motor: Column, water: Column, lake: Column) -> DataFrame:
    """(party, mode, r, c): ground that each vehicle of a kit (party, atv, boat, engine) can use; nobody without a vehicle has a row.

    The kit is expanded to its modes first, so a cell is joined only with the parties whose mode it can carry.
    """
    flag = lambda x: F.coalesce(x, F.lit(False))
    modes = F.array(F.when(flag(F.col("atv")), F.lit("atv")), F.when(flag(F.col("boat")), F.when(flag(F.col("engine")), "motor").otherwise("canoe")))
    wanted = kit.select("party", F.explode(F.filter(modes, lambda m: m.isNotNull())).alias("mode")).withColumn("ground", F.when(F.col("mode") == "atv", "land").otherwise("water"))
    kinds = F.filter(F.array(F.when(flag(road) | flag(motor), F.lit("land")), F.when(flag(water) | flag(lake), F.lit("water"))), lambda g: g.isNotNull())
    return cells.select("r", "c", F.explode(kinds).alias("ground")).join(wanted, "ground").select("party", "mode", "r", "c")

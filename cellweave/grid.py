"""The cell table: one row a cell (r, c), one nullable column a layer.

A grid has its origin at the top left; x grows with c, y falls with r. NULL means that a source does not cover the cell, which is
never the same as zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest side of an automatic and of a requested grid, in cells (fixed values).
AUTO_SIDE, MOST_SIDE = 2400, 3200
#: Padding of a drawn ring and the length of a degree, in km (fixed values).
RING_PAD_KM, DEGREE_KM = 2.5, 111.0


@dataclass(frozen=True)
class GridSpec:
    crs: str
    x0: float
    y0: float
    res: float
    w: int
    h: int

    @classmethod
    def over(cls, crs: str, left: float, bottom: float, right: float, top: float, res: float) -> GridSpec:
        return cls(crs, left, top, res, math.ceil((right - left) / res), math.ceil((top - bottom) / res))

    def cells(self, spark: SparkSession) -> DataFrame:
        """(r, c) of every cell, made where it is used."""
        return spark.range(self.w * self.h).select(F.expr(f"cast(id div {self.w} as int)").alias("r"), F.expr(f"cast(id % {self.w} as int)").alias("c"))

    def x(self, c: Column) -> Column:
        return F.lit(self.x0) + (c + 0.5) * self.res

    def y(self, r: Column) -> Column:
        return F.lit(self.y0) - (r + 0.5) * self.res

    def row(self, y: Column) -> Column:
        """Row of a coordinate, clamped to the grid."""
        return F.greatest(F.lit(0), F.least(F.lit(self.h - 1), F.floor((F.lit(self.y0) - y) / self.res))).cast("int")

    def column(self, x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.w - 1), F.floor((x - F.lit(self.x0)) / self.res))).cast("int")


def bbox(lon: Column, lat: Column, radius_km: Column) -> list[Column]:
    """(min_lon, min_lat, max_lon, max_lat) of a square around a centre."""
    dlat = radius_km / DEGREE_KM
    dlon = radius_km / (DEGREE_KM * F.cos(F.radians(lat)))
    return [lon - dlon, lat - dlat, lon + dlon, lat + dlat]


def ring_bbox(ring: Column) -> list[Column]:
    """The padded box of a ring (array of structs lon, lat)."""
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    mid = (F.array_min(lats) + F.array_max(lats)) / 2
    dlat = F.lit(RING_PAD_KM / DEGREE_KM)
    dlon = RING_PAD_KM / (DEGREE_KM * F.cos(F.radians(mid)))
    return [F.array_min(lons) - dlon, F.array_min(lats) - dlat, F.array_max(lons) + dlon, F.array_max(lats) + dlat]


def half_width_km(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Half of the longer side of a box."""
    mid = F.cos(F.radians((min_lat + max_lat) / 2))
    return F.greatest((max_lat - min_lat) * DEGREE_KM, (max_lon - min_lon) * DEGREE_KM * mid) / 2


def resolution(half_width: Column, base: Column, asked: Column | None = None) -> Column:
    """Metres a cell: the base or what keeps the longest side within AUTO_SIDE; a request is clamped to what keeps it within MOST_SIDE, and to 20..500."""
    auto = F.greatest(base.cast("double"), F.ceil(2 * half_width * 1000 / AUTO_SIDE).cast("double"))
    if asked is None:
        return auto
    low = F.greatest(F.lit(20.0), F.ceil(2 * half_width * 1000 / MOST_SIDE).cast("double"))
    return F.coalesce(F.least(F.lit(500.0), F.greatest(low, asked.cast("double"))), auto)


def mirrored(cells: DataFrame, axis: str, size: int, reach_low: int, reach_high: int) -> DataFrame:
    """cells with a halo along axis by reflection (c b a | a b c): positions below 0 and from size on, reflected again where the reach exceeds size."""
    x, reach = F.col(axis), max(reach_low, reach_high)
    if reach <= size:
        places = F.filter(F.array(x, F.when(x < reach_low, -1 - x), F.when(x >= size - reach_high, 2 * size - 1 - x)), lambda p: p.isNotNull())
    else:
        turns = reach // (2 * size) + 1
        every = F.array(*[p for k in range(-turns, turns + 1) for p in (2 * k * size + x, 2 * k * size - 1 - x)])
        places = F.filter(every, lambda p: (p >= -reach_low) & (p < size + reach_high))
    spread = cells.withColumn("_at", F.explode(places))  # one pass over the cells, no union of copies
    return spread.withColumn(axis, F.col("_at").cast("int")).drop("_at")


def inside(cells: DataFrame, axis: str, size: int) -> DataFrame:
    return cells.where((F.col(axis) >= 0) & (F.col(axis) < size))


def neighbours(cells: DataFrame, offsets: Iterable[tuple[int, int]]) -> DataFrame:
    """cells shifted by each of the offsets: row (r, c) stands for what is seen from there."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    return cells.withColumn("o", F.explode(steps)).withColumn("r", (F.col("r") + F.col("o.dr")).cast("int")).withColumn("c", (F.col("c") + F.col("o.dc")).cast("int"))


CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))
RING8 = (*CROSS, (-1, -1), (-1, 1), (1, -1), (1, 1))


def demo_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A square grid laid over the events table, and its side: elevation from value, class from type, k from props, zone from user.

    Every event is a cell; what is left of the last rows is filled from the first events again.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    side = math.isqrt(n - 1) + 1 if n else 0
    code = F.when(F.col("event_type") == "view", 10).when(F.col("event_type") == "click", 20).when(F.col("event_type") == "purchase", 30).when(F.col("event_type") == "signup", 80).otherwise(90)
    twice = F.when(F.col("event_id") < side * side - n, F.array("event_id", F.col("event_id") + n)).otherwise(F.array("event_id"))
    cells = events.withColumn("event_id", F.explode(twice)).select(
        F.expr(f"cast(event_id div {side} as int)").alias("r"), F.expr(f"cast(event_id % {side} as int)").alias("c"), F.col("value").alias("elev"), code.cast("int").alias("cls"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("user_id").alias("zone"), F.to_date("ts").alias("d"),
    )
    return cells, side


#: The same table as a SQL prefix: g(w), cells.
CELLS_SQL = """g AS (SELECT CAST(ceil(sqrt(count(*))) AS INTEGER) AS w, count(*) AS n FROM events),
ev AS (SELECT event_id AS i, * FROM events UNION ALL SELECT event_id + n, events.* FROM events, g WHERE event_id < w * w - n),
cells AS MATERIALIZED (SELECT CAST(i // w AS INTEGER) AS r, CAST(i % w AS INTEGER) AS c, value AS elev,
  CAST(CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 20 WHEN 'purchase' THEN 30 WHEN 'signup' THEN 80 ELSE 90 END AS INTEGER) AS cls,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id AS zone, CAST(ts AS DATE) AS d FROM ev, g)"""

"""Which routes an area gets, what a route amounts to, and who sits where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Routes an area gets by the kind of site they lead to, and their names; the reach of a road in metres; loads of a carry (fixed values).
ROUTES = {"rut_calling": (2, "route_best"), "thermal_refuge": (1, "route_midday_hot")}
ROAD_M, LOADS = 5000.0, 7
#: Seats by kind of site, in the order in which they are given out.
SEATS = {"rut_calling": (1, "caller"), "glassing": (2, "glasser"), "saline_blind": (3, "sitter"), "funnel": (3, "sitter")}


def plan_routes(areas: DataFrame, sites: DataFrame) -> DataFrame:
    """(area, legend, n, r, c) for areas (area, camp_r, camp_c, stage_r, stage_c, d_road) and sites (area, legend, seq, r, c).

    From camp to the first sites of each kind that has routes, in the order they were placed; and in from where one leaves the car, by
    road where any area has a road within ROAD_M, else by water. No route where start and end are one cell or the camp is unknown.
    """
    table = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("most"), F.lit(v[1]).alias("name")))])
    ranked = sites.withColumn("_k", table[F.col("legend")]).where("_k is not null").withColumn("n", F.row_number().over(Window.partitionBy("area", "legend").orderBy("seq")))
    first = ranked.where(F.col("n") <= F.col("_k.most")).join(areas.select("area", "camp_r", "camp_c"), "area").where("not (r = camp_r and c = camp_c)")
    out = first.select("area", F.col("_k.name").alias("legend"), "n", "r", "c")
    legs = areas.where("not (stage_r = camp_r and stage_c = camp_c)").crossJoin(F.broadcast(areas.agg(F.min("d_road").alias("_near"))))  # one row
    road = F.coalesce(F.col("_near") < ROAD_M, F.lit(False))
    return out.unionByName(legs.select("area", F.when(road, "route_access").otherwise("route_paddle").alias("legend"), F.lit(1).alias("n"), F.col("camp_r").alias("r"), F.col("camp_c").alias("c")))


def route_properties(legs: DataFrame) -> DataFrame:
    """One row a route of legs (route, seq, mode, km, end): km_by_mode, walk_km, carry_km, ride_km, ride_mode and where the vehicle stays.

    A walk beside a leg by boat is a portage. The ride is the longest sum of a mode other than walking (portages count, ties to the
    smaller name); the vehicle stays at the end of its first leg that another leg follows.
    """
    w = Window.partitionBy("route").orderBy("seq")
    boat = lambda m: F.coalesce(m.isin("canoe", "motor"), F.lit(False))
    on_foot = F.col("mode").startswith("foot")
    named = legs.withColumns({"_p": boat(F.lag("mode").over(w)) | boat(F.lead("mode").over(w)), "_more": F.lead("seq").over(w).isNotNull()})
    named = named.withColumn("mode", F.when(on_foot & F.col("_p"), "portage").otherwise(F.col("mode")))
    stops = named.groupBy("route", "mode").agg(F.round(F.sum("km"), 2).alias("km"), F.min(F.when(F.col("_more"), F.struct("seq", "end"))).alias("stop"))
    walked = F.col("mode").startswith("foot")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("km"))), F.lit(0.0))
    best = F.min(F.when(~walked, F.struct((-F.col("km")).alias("k"), F.col("mode").alias("m"), F.col("stop").alias("s"))))
    out = stops.groupBy("route").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "km")))).alias("km_by_mode"), F.round(total(walked | (F.col("mode") == "portage")), 2).alias("walk_km"),
        F.round(LOADS * total(walked) + (LOADS + 1) * total(F.col("mode") == "portage"), 1).alias("carry_km"), F.round(total(~walked), 2).alias("ride_km"), best.alias("b"),
    )
    return out.select("route", "km_by_mode", "walk_km", "carry_km", "ride_km", F.col("b.m").alias("ride_mode"), F.col("b.s.end").alias("vehicle_left_at"))


def seats(sites: DataFrame, party: Column) -> DataFrame:
    """sites (area, legend, seq, ..) with role, n within the role and seat over the area: callers, glassers, sitters, twice as many as the party at most."""
    table = F.create_map(*[x for k, v in SEATS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("o"), F.lit(v[1]).alias("role")))])
    s = sites.withColumn("_k", table[F.col("legend")]).where("_k is not null").select("*", F.col("_k.o").alias("_o"), F.col("_k.role").alias("role")).drop("_k")
    inner = [F.col("legend") == "funnel", F.col("seq")]  # blinds before necks
    s = s.withColumns({"n": F.row_number().over(Window.partitionBy("area", "role").orderBy(*inner)), "seat": F.row_number().over(Window.partitionBy("area").orderBy("_o", *inner))})
    return s.where(F.col("seat") <= 2 * F.greatest(party, F.lit(1))).drop("_o")

"""Camps for groups of areas, what has to be packed in from them, and the gate of a party without a boat."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.core import materialize
from cellweave.functions.geo import haversine_km
from cellweave.operators.sphere import clusters_km, nearest_km
from cellweave.operators.zonal import global_rank
from cellweave.plans.merge import letters

#: Areas less than so many kilometres apart share a camp (fixed value).
SHARED_KM = 15.0
NO_BOAT = "no boat, and the way in crosses water that needs one"


def camp_sites(areas: DataFrame, roads: DataFrame, km: float = SHARED_KM, fixed: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(camps, packin) of areas (rank, lat, lon): camps (camp, lat, lon, access, areas, max_packin_km) and packin (rank, camp, km).

    Areas that hang together in hops of less than km have one camp, at the road point (id, lat, lon) nearest to their mean, or at the
    mean where no road is mapped. Camps are lettered by how many areas they have, then by their smallest rank. A camp that the party
    named is the only one, and everything is measured from it.
    """
    if fixed is not None:
        members = areas.select("rank", "lat", "lon", F.lit("A").alias("camp"), F.lit(fixed[0]).alias("slat"), F.lit(fixed[1]).alias("slon"), F.lit("yours").alias("access"))
    else:
        grouped = materialize(clusters_km(areas.select(F.col("rank").alias("id"), "lat", "lon"), km), "clusters")
        mean = grouped.groupBy(F.col("cluster").alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), (-F.count(F.lit(1))).alias("_few"))
        found = nearest_km(mean, roads).join(roads.select(F.col("id").alias("target"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon")), "target", "left")
        sited = mean.join(found.select("id", "rlat", "rlon"), "id", "left")
        sited = global_rank(sited, ["_few", "id"], "_n").select(
            F.col("id").alias("cluster"), letters(F.col("_n")).alias("camp"), F.coalesce("rlat", "lat").alias("slat"), F.coalesce("rlon", "lon").alias("slon"), F.when(F.col("rlat").isNotNull(), "road").otherwise("water/centroid").alias("access"),
        )
        members = grouped.select(F.col("id").alias("rank"), "lat", "lon", "cluster").join(sited, "cluster").drop("cluster")
    members = materialize(members.withColumn("km", F.round(haversine_km(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon")), 1)), "members")
    camps = members.groupBy("camp", F.round("slat", 5).alias("lat"), F.round("slon", 5).alias("lon"), "access").agg(F.count(F.lit(1)).alias("areas"), F.max("km").alias("max_packin_km"))
    return camps, members.select("rank", "camp", "km")


def boat_gate(areas: DataFrame, crossings: DataFrame, has_boat: Column, others: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """{areas, crossings, *others} after the gate, all with the same ranks: areas (plan, rank, status, reason, ..), the rest (plan, rank, ..).

    Where the way in crosses water by boat and the party (has_boat, a column of areas) has none, an area that was `ok` is excluded. In a
    plan where that happens ranks are given anew, areas that are ok first, both parts in their old order, and every table follows.
    Rows of a rank that the plan does not know keep it.
    """
    by_boat = crossings.where(F.col("kind") == "boat").select("plan", "rank").where("rank is not null").distinct().withColumn("_boat", F.lit(True))
    ok = F.coalesce(F.col("status"), F.lit("ok")) == "ok"
    judged = areas.join(by_boat, ["plan", "rank"], "left").withColumn("_hit", F.coalesce(F.col("_boat"), F.lit(False)) & ok & ~F.coalesce(has_boat, F.lit(False))).drop("_boat")
    judged = judged.withColumns({"status": F.when(F.col("_hit"), "excluded").otherwise(F.col("status")), "reason": F.when(F.col("_hit"), NO_BOAT).otherwise(F.col("reason"))})
    plan = Window.partitionBy("plan")
    anew = F.row_number().over(plan.orderBy(~ok, "rank"))
    judged = materialize(judged.withColumn("_new", F.when(F.max("_hit").over(plan), anew).otherwise(F.col("rank")).cast(areas.schema["rank"].dataType)), "gated")
    remap = judged.select("plan", "rank", "_new")
    follow = lambda df: df.join(remap, ["plan", "rank"], "left").withColumn("rank", F.coalesce("_new", "rank")).drop("_new").select(*df.columns)
    gated = judged.withColumn("rank", F.col("_new")).select(*areas.columns)
    return {"areas": gated, "crossings": follow(crossings)} | {name: follow(df) for name, df in others.items()}

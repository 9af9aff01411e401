"""What stays of a plan inside a drawn ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least share of an area inside the ring (fixed value).
MIN_OVERLAP = 0.10


def stays(share: Column, least: float = MIN_OVERLAP) -> Column:
    """An area with enough of it inside; one whose share is unknown stays."""
    return F.coalesce(share >= least, F.lit(True))


def clip_areas(areas: DataFrame, least: float = MIN_OVERLAP) -> DataFrame:
    """areas (plan, rank, share, ..) that stay, with the ranks of each plan from 1 without gaps. A plan has few areas, so a window a plan is small."""
    order = Window.partitionBy("plan").orderBy("rank")
    return areas.where(stays(F.col("share"), least)).withColumn("rank", F.row_number().over(order).cast("int"))


def clip_points(points: DataFrame, inside: Column, parking: Column) -> DataFrame:
    """Points inside or of unknown place; where one leaves the car always stays."""
    return points.where(F.coalesce(inside, F.lit(True)) | F.coalesce(parking, F.lit(False)))


def clip_camps(camps: DataFrame, areas: DataFrame) -> DataFrame:
    """camps (plan, camp, ..) that an area of their plan still names; all of a plan's camps where none is named."""
    named = camps.join(areas.select("plan", "camp", F.lit(True).alias("_live")).distinct(), ["plan", "camp"], "left")
    some = F.coalesce(F.bool_or(F.coalesce("_live", F.lit(False))).over(Window.partitionBy("plan")), F.lit(False))
    return named.withColumn("_some", some).where(F.coalesce("_live", F.lit(False)) | ~F.col("_some")).drop("_live", "_some")

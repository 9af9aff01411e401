"""Stages by name over one cell table, run in order, with a store of finished results by content address."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.core import materialize, shared_dir
from cellweave.functions import algebra as A
from cellweave.operators import focal as O
from cellweave.operators import necks as N
from cellweave.operators import shapes as H

Stage = Callable[[DataFrame, dict], DataFrame]
STAGES: dict[str, Stage] = {}


def stage(f: Stage) -> Stage:
    STAGES[f.__name__] = f
    return f


@stage
def terrain(cells: DataFrame, p: dict) -> DataFrame:
    """slope, aspect, cool, tpi, wet, funnel from elev and cls."""
    sides, res = p["sides"], p["res"]
    d = O.slope_aspect(O.gaussian(cells, "elev", "smooth", sides, 1.0), "smooth", res)
    d = O.box_mean(d, "smooth", "mean", sides, O.odd(500, res)).withColumn("tpi", F.col("smooth") - F.col("mean")).withColumn("wet", A.wetness(F.col("tpi"), F.col("slope")))
    neck = N.constriction(cells, F.col("cls") == 80, res, sides).select("r", "c", F.col("strength").alias("neck"))
    d = d.join(neck, ["r", "c"])
    return d.withColumn("funnel", A.funnel_damped(F.col("neck"), F.lit(0.0), F.col("cls") == 90)).drop("smooth", "mean", "neck")


@stage
def habitat(cells: DataFrame, p: dict) -> DataFrame:
    """d_water, browse, browse_source, browse_agree, cover, edge, hsm, hsm_thermal, hsm_rut."""
    sides, res = p["sides"], p["res"]
    d = H.euclidean(cells, F.col("cls").isin(80, 90), "d_water", res)
    n = F.col("ndvi")
    satellite = A.blend(A.class_score(F.col("cls"), A.BROWSE_BY_CLASS), A.ndvi_browse(n))
    sources = [A.interp(p["year"] - F.col("cut"), A.CUT_CURVE), A.interp(p["year"] - F.col("burn"), A.BURN_CURVE), satellite]
    best, code = A.precedence(sources)
    d = d.withColumns({"browse": best, "browse_source": code, "browse_agree": A.corroboration(sources), "cover": A.blend(A.class_score(F.col("cls"), A.COVER_BY_CLASS), A.ndvi_cover(n)), "_t": (F.col("cls") == 10).cast("double"), "_o": F.col("cls").isin(20, 30, 90).cast("double")})
    size = O.odd(200, res)
    d = O.box_mean(O.box_mean(d, "_t", "_mt", sides, size), "_o", "_mo", sides, size)
    d = d.withColumn("edge", A.clip(4 * F.col("_mt") * F.col("_mo"))).drop("_t", "_o", "_mt", "_mo")
    d = d.withColumns({"_w": A.prox(F.col("d_water"), 150, 800), "_low": A.normalize(-F.col("tpi"), -15, 5)})
    d = materialize(d, "layers")  # the scores below name these columns many times
    water, low = F.col("_w"), F.col("_low")
    d = d.withColumns({
        "hsm": A.habitat(F.col("browse"), F.col("cover"), water, low, F.col("edge"), F.col("slope"), F.col("cls") == 80), "hsm_thermal": A.thermal_refuge(F.col("cover"), F.col("d_water"), low, F.col("cool"), F.col("slope")),
        "hsm_rut": A.rut_surface(F.col("edge"), water, F.col("funnel"), F.lit(0.0), F.lit(0.0)),
    })
    return d.drop("_w", "_low")


@stage
def behavior(cells: DataFrame, p: dict) -> DataFrame:
    """feed, refuge, cruise, midday_cool, midday_warm; null on water."""
    land = F.col("cls") != 80
    feed = A.feeding(F.col("browse"), F.col("edge"), A.prox(F.col("d_water"), 150, 640), F.lit(float(p.get("aquatic", 0.0))), A.normalize(-F.col("tpi"), -15, 5))
    d = cells.withColumns({"feed": F.when(land, feed), "refuge": F.when(land, F.col("hsm_thermal")), "cruise": F.when(land, A.cruise(F.col("hsm_rut"), F.col("funnel")))})
    cool, warm = A.midday(F.col("feed"), F.col("refuge"))
    return d.withColumns({"midday_cool": cool, "midday_warm": warm})


@stage
def access(cells: DataFrame, p: dict) -> DataFrame:
    """extraction, pressure, habitat_phase, huntability from d_road; without roads access is unknown, not impossible."""
    if "d_road" in cells.columns:
        ext, prs = A.reach_decay(F.col("d_road"), F.lit(float(p.get("walk_m", 9000.0)))), A.pressure(F.col("d_road"))
    else:
        ext, prs = F.lit(0.85), F.lit(0.0)
    phase = A.phase_blend(F.col("hsm"), [(0.6, F.col("cruise")), (0.4, F.col("feed"))])
    d = cells.withColumns({"extraction": ext, "pressure": prs, "habitat_phase": phase})
    return d.withColumn("huntability", A.huntability(F.col("habitat_phase"), F.col("extraction"), F.col("pressure")))


def run(cells: DataFrame, params: Mapping, names: Sequence[str] = ("terrain", "habitat", "behavior", "access")) -> DataFrame:
    """The stages one after the other, each written to the shared folder so that plans stay short and a lost executor costs one stage."""
    out = cells
    for name in names:
        out = materialize(STAGES[name](out, dict(params)), name)
    return out


def store_path(spark: SparkSession, box: Sequence[float], crs: str, res: float, stage_name: str) -> str:
    """Where results for a box (rounded to 4 places), system and resolution are kept."""
    text = "|".join([*(f"{round(float(v), 4)}" for v in box), crs, f"{round(float(res), 2)}"])
    import hashlib

    return f"{shared_dir(spark)}/store/{hashlib.sha1(text.encode()).hexdigest()[:16]}/{stage_name}"


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What is at path, made and written first if it is not there. A write that broke off leaves no _SUCCESS and is made again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

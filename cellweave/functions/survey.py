"""Forest survey, road and water codes to classes, and what is said of an area as a whole."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.decode import lookup

# Origins that are cuts and burns, treatments that are partial cuts, first characters of organic soils and of wet drainage.
CUT_ORIGINS = ("CT", "CTSP_T", "CTSP_U", "CPR", "CPRS_U", "CPT", "CPPTM_U", "RPS", "P", "PL", "PLR")
BURN_ORIGINS = ("BR",)
PARTIAL_CUTS = ("CP", "CJ", "CJB", "CJG", "CJPG", "CPS", "CPR_T", "CPR_U", "CEA", "EJ", "EC")
ORGANIC_DEPOSITS, HYDRIC_DRAINAGE = ("7",), ("4", "5", "6")
# Stand codes, and cover and browse of each where a species says nothing.
CONIFER, MIXED, DECIDUOUS, CUT, PARTIAL, BURN, PEAT = 1, 2, 3, 4, 5, 6, 7
STAND_NAMES = {1: "resineux", 2: "melange", 3: "feuillus", 4: "coupe_recente", 5: "coupe_partielle", 7: "tourbiere"}
STAND_COVER = {1: 0.85, 2: 0.55, 3: 0.25, 4: 0.05, 5: 0.35, 6: 0.10, 7: 0.00}
STAND_BROWSE = {1: 0.05, 2: 0.35, 3: 0.30, 4: 0.55, 5: 0.45, 6: 0.30, 7: 0.35}
# Waterways never to ford, and those that need a boat.
DANGER_WATER, BIG_WATER = ("rapids", "tidal_channel", "waterfall"), ("river", "canal")


def _code(text: Column) -> Column:
    return F.upper(F.trim(F.coalesce(text, F.lit(""))))


def stand_class(origin: Column, treatment: Column, cover: Column, deposit: Column, drainage: Column) -> Column:
    """Stand code: what made the stand, then how it was treated, then its cover; without any, peat where the soil is organic and wet, else null."""
    first = lambda x: F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, 1)
    peat = first(deposit).isin(*ORGANIC_DEPOSITS) & first(drainage).isin(*HYDRIC_DRAINAGE)
    by_cover = lookup({"R": CONIFER, "M": MIXED, "F": DECIDUOUS}, _code(cover))
    made = F.when(_code(origin).isin(*CUT_ORIGINS), CUT).when(_code(origin).isin(*BURN_ORIGINS), BURN).when(_code(treatment).isin(*PARTIAL_CUTS), PARTIAL)
    return F.coalesce(made, by_cover, F.when(peat, PEAT))


def stand_cut_year(stand: Column, origin_year: Column, treatment_year: Column) -> Column:
    """Year of a cut or partial cut; 0 for other stands and for years outside 1901 to 2099."""
    y = F.substring(F.when(stand == CUT, origin_year).when(stand == PARTIAL, treatment_year).cast("string"), 1, 4).try_cast("int")
    return F.when(y.between(1901, 2099), y).otherwise(0)


def class_constant(stand: Column, classes: Mapping[str, Mapping[str, float]], field: str, fallback: Mapping[int, float]) -> Column:
    """A field of the species' own class table, else the fallback of the code, within 0..1; null for a code without one."""
    table = {k: classes.get(STAND_NAMES.get(k, ""), {}).get(field) for k in fallback}
    return lookup({k: min(1.0, max(0.0, float(fallback[k] if v is None else v))) for k, v in table.items()}, stand)


# How forest road classes begin by what the road is built for, and words of the public classes.
ROAD_CLASSES, TRACK_CLASSES = ("CL1", "CL2", "CL3", "01", "02", "03"), ("CL4", "CL5", "04", "05")
ARTERY_WORDS, COLLECTOR, LOCAL = ("autoroute", "nationale", "régionale", "regionale"), "collectrice", "locale"


def official_road(forest_class: Column, route_class: Column) -> Column:
    """artery, road or track of the official network: the public class where it says so, then what the forest road is built for."""
    cf, cls = F.upper(F.coalesce(forest_class, F.lit(""))), F.lower(F.coalesce(route_class, F.lit("")))
    begins = lambda prefixes: functools.reduce(operator.or_, [cf.startswith(p) for p in prefixes])
    artery = functools.reduce(operator.or_, [cls.contains(word) for word in ARTERY_WORDS])
    return F.when(artery, "artery").when(cls.contains(COLLECTOR) | begins(ROAD_CLASSES), "road").when(begins(TRACK_CLASSES), "track").when(cls.contains(LOCAL), "road").otherwise("track")


def waterway(kind: Column) -> tuple[Column, Column]:
    """(class, drawn as): danger is never forded but drawn as a river."""
    k = F.coalesce(kind, F.lit(""))
    cls = F.when(k.isin(*DANGER_WATER), "danger").when(k.isin(*BIG_WATER), "river").otherwise("stream")
    return cls, F.when(cls == "danger", "river").otherwise(cls)


def overall_confidence(north: Column, burns: Column, greenness: Column, stands: Column, landcover: Column, roads: Column, image_age: Column, surveyed: Column) -> Column:
    """Additive over the sources that are there, 0.30 to 0.95, two decimals; image_age in growing seasons or null, surveyed null where density is unknown."""
    parts = F.when(north, 0.60).otherwise(0.66)
    for there, up, down in ((burns, 0.06, -0.05), (greenness, 0.04, -0.06), (stands, 0.08, 0.0), (landcover, 0.03, 0.0), (roads, 0.0, -0.04), (image_age >= 2, -0.06, 0.0)):
        parts = parts + F.when(F.coalesce(there, F.lit(False)), up).otherwise(down)
    parts = parts + F.when(surveyed, 0.05).when(~surveyed, -0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.30), F.least(F.lit(0.95), parts)), 2)


def midday_class(weight: Column) -> Column:
    """How hard heat drives animals into cover at noon."""
    return F.when(weight >= 0.66, "retreat").when(weight >= 0.33, "partial").when(weight.isNotNull(), "feeding")


def hour_label(hour: Column, warm: Column) -> Column:
    """What animals do at an hour of the day."""
    return (
        F.when(hour < 6, "bedded").when(hour < 9, "morning feeding").when(hour < 13, F.when(warm, "moving to shade").otherwise("loafing"))
        .when(hour < 16.5, F.when(warm, "refuge, then building").otherwise("building")).when(hour < 19, "evening feeding").otherwise("night travel")
    )


def wind_state(hour: Column, best_from: Column, wind_from: Column) -> Column:
    """2 while thermals rule (before 8:00, after 16:30), 1 or -1 for a wind within 45 degrees of the best or not, 0 where either is unknown."""
    from cellweave.functions.geo import angle_between

    fit = F.when(angle_between(best_from, wind_from) <= 45, 1).otherwise(-1)
    return F.when(wind_from.isNull(), 0).when((hour < 8) | (hour > 16.5), 2).when(best_from.isNull(), 0).otherwise(fit)

"""Codes and free text of source layers to what the models use, and the rules that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Browse value by two-letter species code, weight by position, the value of an unknown code.
SPECIES_BROWSE = {
    "BP": 1.00, "BG": 0.95, "BJ": 0.85, "PT": 1.00, "PE": 0.95, "PB": 0.90, "PA": 0.90, "SO": 0.95, "ER": 0.70, "ES": 0.65, "EA": 0.70, "EO": 0.70, "FN": 0.60, "FA": 0.60, "FP": 0.55, "FX": 0.70, "FI": 0.75,
    "FT": 0.60, "FH": 0.60, "CT": 0.55, "CR": 0.50, "CB": 0.50, "CC": 0.50, "OA": 0.55, "TA": 0.55, "SB": 0.35, "SE": 0.30, "PG": 0.10, "PI": 0.10, "PS": 0.10, "TO": 0.20, "PU": 0.20, "EN": 0.00, "EB": 0.05, "EP": 0.05,
    "EU": 0.05, "EV": 0.05, "ML": 0.05, "ME": 0.05, "MH": 0.05, "MJ": 0.05, "RX": 0.05,
}
POSITION_WEIGHTS, UNKNOWN_BROWSE = (0.5, 0.3, 0.2), 0.10
# Metres by height class, percent by slope class, canopy by density class, years by uneven-age class.
HEIGHT_M = {"1": 24.0, "2": 19.5, "3": 14.5, "4": 9.5, "5": 5.5, "6": 3.0, "7": 1.0}
SLOPE_PCT = {"A": 1.5, "B": 6.0, "C": 12.0, "D": 23.0, "E": 35.0, "F": 50.0}
CLOSURE = {"A": 0.90, "B": 0.70, "C": 0.50, "D": 0.32}
UNEVEN_AGE = {"JIN": 40, "JIR": 40, "VIN": 100, "VIR": 100}
# Lease purposes that are people on the ground (folded text, class).
LEASES = (("abri sommaire", "abri_sommaire"), ("pourvoirie sans droits", "pourvoirie_camp"), ("villegiature", "villegiature"), ("residence principale", "residence"))
ACCENTS = ("àâäáéèêëîïíôöóùûüúçñÀÂÄÁÉÈÊËÎÏÍÔÖÓÙÛÜÚÇÑ", "aaaaeeeeiiiooouuuucnAAAAEEEEIIIOOOUUUUCN")
# Tenure classes by description, and who may hunt where (residency, tenure, rule).
TENURE = {"pourvoirie à droits exclusifs": "pourvoirie_exclusive", "zone d'exploitation contrôlée": "zec", "réserve faunique": "reserve_faunique", "refuge faunique": "refuge_faunique"}
ACCESS = {
    "quebec_resident": {"crown": "yes", "zec": "yes", "reserve_faunique": "draw", "refuge_faunique": "verify", "pourvoirie_exclusive": "no", "pourvoirie_nonexclusive": "yes", "other": "verify"},
    "non_resident_canada": {"crown": "outfitter", "zec": "yes", "reserve_faunique": "draw", "refuge_faunique": "verify", "pourvoirie_exclusive": "outfitter", "pourvoirie_nonexclusive": "outfitter", "other": "verify"},
    "non_resident_foreign": {"crown": "outfitter", "zec": "yes", "reserve_faunique": "draw", "refuge_faunique": "verify", "pourvoirie_exclusive": "outfitter", "pourvoirie_nonexclusive": "outfitter", "other": "verify"},
}


def lookup(table: Mapping[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def species_browse(code: Column) -> Column:
    """Browse value of a run of two-letter codes, dominant first; 0 without a code."""
    s = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    n = F.least(F.lit(3), F.floor(F.length(s) / 2).cast("int"))
    total = F.lit(0.0)
    weight = F.lit(0.0)
    for i, w in enumerate(POSITION_WEIGHTS):
        here = n > i
        total = total + F.when(here, w * F.coalesce(lookup(SPECIES_BROWSE, F.substring(s, 2 * i + 1, 2)), F.lit(UNKNOWN_BROWSE))).otherwise(0.0)
        weight = weight + F.when(here, w).otherwise(0.0)
    return F.when(n > 0, total / weight).otherwise(0.0)


def stand_age(code: Column) -> Column:
    """Years of a stand: numbers as they are, of four digits the first two, uneven classes by table, else 0."""
    s = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    number = F.when(F.length(s) == 4, F.substring(s, 1, 2)).otherwise(s).try_cast("int")
    return F.coalesce(lookup(UNEVEN_AGE, s), F.when(s.rlike("^[0-9]+$"), number), F.lit(0))


def fold(text: Column) -> Column:
    """Without accents and case, blanks single."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), *ACCENTS)), r"\s+", " "))


def lease_kind(purpose: Column) -> Column:
    t = fold(purpose)
    return F.coalesce(*[F.when(t.contains(needle), kind) for needle, kind in LEASES])


def tenure_class(text: Column) -> Column:
    return F.coalesce(lookup(TENURE, F.lower(F.trim(F.coalesce(text, F.lit(""))))), F.lit("other"))


def access_rule(residency: Column, tenure: Column) -> Column:
    """yes, draw, outfitter, verify or no."""
    table = {f"{r}|{t}": v for r, row in ACCESS.items() for t, v in row.items()}
    return F.coalesce(lookup(table, F.concat_ws("|", residency, tenure)), F.lit("no"))


def road_role(highway: Column, artery: Sequence[str] = ("motorway", "trunk", "primary"), local: Sequence[str] = ("secondary", "tertiary", "unclassified", "residential"), track: Sequence[str] = ("track", "service")) -> Column:
    h = F.lower(F.coalesce(highway, F.lit("")))
    return F.when(h.isin(*artery), "artery").when(h.isin(*local), "road").when(h.isin(*track), "track").otherwise("road")


def unpaved(tags: Column) -> Column:
    return F.lower(F.coalesce(tags, F.lit(""))).rlike("gravel|dirt|ground|unpaved|compacted|earth|sand|\"tracktype\"")


def coverage(max_lat: Column, min_lat: Column, box_min: Column, box_max: Column) -> Column:
    """in, partial or out of a source's declared latitudes."""
    north = F.when(box_min >= max_lat, "out").when(box_max > max_lat, "partial")
    south = F.when(box_max <= min_lat, "out").when(box_min < min_lat, "partial")
    return F.coalesce(north, south, F.lit("in"))


def clamped(value: Column, default: float, lo: float, hi: float) -> Column:
    """A request value: null and garbage give the default, a stated zero stays a zero until it is clamped."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.coalesce(value.try_cast("double"), F.lit(float(default)))))


def reach_km(access_km: Column, hunt_km: Column, vehicle: Column, atv: Column) -> Column:
    a, h = F.coalesce(access_km, F.lit(6.0)), F.coalesce(hunt_km, F.lit(3.0))
    reach = F.when(vehicle, h).otherwise(a + h)
    return F.when(atv, reach * 2.5 + 5).otherwise(reach)


def capability(d_road: Column, camp_km: Column, reach: Column, camp_reach: Column, boat: Column, unknown: Column, far: float = 5e5) -> tuple[Column, Column]:
    """(ok, reason): can this party get in and get an animal out."""
    reason = F.when(camp_km.isNotNull(), F.when(camp_km > camp_reach, "beyond range of camp")).when(d_road.isNull() | unknown, F.lit(None)).when(d_road >= far, F.when(~boat, "water-locked")).when(d_road > reach * 1000, "beyond range of road")
    return reason.isNull(), reason


def density_prior(lat: Column) -> Column:
    return F.when(lat >= 52, 0.6).when(lat >= 49, 1.8).otherwise(3.2)


def density_class(per10: Column) -> Column:
    return F.when(per10 < 1.2, "low").when(per10 < 3.0, "moderate").otherwise("high")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.72, "high").when(score >= 0.5, "moderate").otherwise("low")


def area_confidence(north: Column, top_share: Column, water_share: Column, has_ndvi: Column) -> Column:
    """Additive, 0.30 to 0.95: the coverage north or south, a one-class or mixed cover, much water, greenness at hand."""
    base = F.when(north, 0.60).otherwise(0.82)
    mix = F.when(top_share.isNull(), -0.05).when(top_share > 0.85, -0.10).when(top_share < 0.55, 0.06).otherwise(0.0)
    wet = F.when(water_share > 0.30, -0.06).otherwise(0.0)
    return F.greatest(F.lit(0.30), F.least(F.lit(0.95), base + mix + wet + F.when(has_ndvi, 0.04).otherwise(0.0)))


def site_confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.35), F.least(F.lit(0.9), F.when(score.isNull(), 0.6).otherwise(0.55 + 0.30 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))))


def crossing(closed_m: Column, open_m: Column, bridge_m: Column, order: Column, flow: Column, hazard: Column, kind: Column, near: float = 30.0) -> tuple[Column, Column]:
    """(kind, basis) of a water crossing: official closures and bridges, mapped bridges, measured stream order, else the class alone."""
    hit = lambda d: F.coalesce(d <= near, F.lit(False))
    measured = F.when(F.coalesce(hazard, F.lit(False)), "boat").when((order >= 4) | ((order >= 3) & (flow == "P")), "boat").when(order.isNotNull(), "ford")
    use = kind.isin("stream", "river") & measured.isNotNull()
    out = F.when(hit(closed_m), "boat").when(hit(open_m), "bridge").when(hit(bridge_m), "bridge").when(use, measured).when(kind == "stream", "ford").otherwise("boat")
    basis = F.when(hit(closed_m) | hit(open_m) | hit(bridge_m) | use, "measured").otherwise("inferred")
    return out, basis


def site_count(base: Column, weight: Column, cap: int) -> Column:
    """Emphasis rounds up, the opposite down, one at least."""
    n = F.when(weight > 1, F.ceil(base * weight)).otherwise(F.greatest(F.lit(1), F.floor(base * weight)))
    return F.greatest(F.lit(1), F.least(F.lit(cap), n)).cast("int")


def sites_of(sites: Column, lat: Column, lon: Column, most: int = 4) -> Column:
    """Array of structs (lat, lon) of a request: of its first sites (arrays of text) those that are places on earth, else its own centre."""
    place = lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("lat"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("lon"))
    good = F.filter(F.transform(F.slice(sites, 1, most), place), lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))
    return F.when(F.coalesce(F.size(good), F.lit(0)) > 0, good).otherwise(F.array(F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))))


def windows_of(windows: Column, start: Column, end: Column, most: int = 4) -> Column:
    """Array of structs (start, end) of a request: of its first windows (arrays of text) those with both ends, else its own dates."""
    pair = lambda p: F.struct(F.try_element_at(p, F.lit(1)).alias("start"), F.try_element_at(p, F.lit(2)).alias("end"))
    good = F.filter(F.transform(F.slice(windows, 1, most), pair), lambda p: (F.length(p["start"]) > 0) & (F.length(p["end"]) > 0))
    return F.when(F.coalesce(F.size(good), F.lit(0)) > 0, good).otherwise(F.array(F.struct(start.alias("start"), end.alias("end"))))

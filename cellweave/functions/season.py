"""Calendar curves and weather rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The anchor date, spreads in days, phase windows and the emphasis that phases put on sites and tactics.
ANCHOR, BREED_SD, CALL_AT, CALL_SD, LATE_AT, LATE_SD, LATE_W = (10, 2), 6.5, -6.0, 8.0, 12.0, 6.0, 0.30
PHASES = (("seeking", -20, -4), ("peak", -3, 6), ("post", 7, 29))
PHASE_SITES = {
    "seeking": {"rut_calling": 1.4, "funnel": 1.4, "glassing": 1.0, "saline_blind": 0.7, "thermal_refuge": 0.8},
    "peak": {"rut_calling": 0.7, "funnel": 0.8, "glassing": 1.1, "saline_blind": 1.3, "thermal_refuge": 1.3},
    "post": {"rut_calling": 0.5, "funnel": 0.7, "glassing": 1.0, "saline_blind": 1.4, "thermal_refuge": 1.1},
    "outside": {"rut_calling": 0.4, "funnel": 0.7, "glassing": 1.0, "saline_blind": 1.4, "thermal_refuge": 1.0},
}
METHOD_SITES = {"rifle": {}, "bow": {"glassing": 0.4, "rut_calling": 1.25, "funnel": 1.3, "saline_blind": 1.15}, "muzzleloader": {"glassing": 0.8, "rut_calling": 1.1, "funnel": 1.1, "saline_blind": 1.05}}
PHASE_TACTICS = {"seeking": (1.35, 0.70, 0.8), "peak": (0.65, 1.30, 1.3), "post": (0.45, 1.20, 1.1), "outside": (0.30, 1.10, 1.0)}
PROFILES = {"low": (1.0, 0.3, 45), "moderate": (0.6, 0.6, 30), "high": (0.3, 1.0, 60)}


def days_from_anchor(d: Column, year: Column | None = None) -> Column:
    return F.datediff(d, F.make_date(F.year(d) if year is None else year, F.lit(ANCHOR[0]), F.lit(ANCHOR[1])))


def _bell(x: Column, sd: float) -> Column:
    return F.exp(-(x * x) / (2 * sd * sd))


def breeding(days: Column) -> Column:
    return _bell(days, BREED_SD)


def call_response(days: Column) -> Column:
    return F.least(F.lit(1.0), _bell(days - CALL_AT, CALL_SD) + LATE_W * _bell(days - LATE_AT, LATE_SD))


def phase(days: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, a, b in PHASES:
        out = out.when(days.between(a, b), name)
    return out.otherwise("outside")


def temperature_factor(t_max: Column, t_min: Column) -> Column:
    """Warm days damp the response, a frost lifts it."""
    f = F.when(t_max >= 20, 0.4).when(t_max >= 17, 0.6).when(t_max >= 14, 0.8).otherwise(1.0)
    return F.when(t_min <= 0, F.least(F.lit(1.0), f * 1.2)).otherwise(f)


def refresh_hours(t_max: Column, wind: Column) -> Column:
    t, w = F.coalesce(t_max, F.lit(10.0)), F.coalesce(wind, F.lit(10.0))
    return F.when((t > 15) | (w > 20), 2).when((t > 8) | (w > 12), 3).otherwise(4)


def rain_reset(mm: Column) -> Column:
    return F.coalesce(mm, F.lit(0.0)) >= 1.0

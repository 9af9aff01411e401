"""Spherical geometry, rings and wind on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.sin((p2 - p1) / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 north, 90 east."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))) + 360, F.lit(360.0))


def compass(deg: Column) -> Column:
    i = F.pmod(F.floor(F.pmod(deg, F.lit(360.0)) / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in COMPASS]), i + 1)


def angle_between(a: Column, b: Column) -> Column:
    """0 to 180 degrees."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def destination(lat: Column, lon: Column, deg: Column, km: Column) -> tuple[Column, Column]:
    """(lat, lon) after km along a bearing."""
    a, d, b = F.radians(lat), km / EARTH_KM, F.radians(deg)
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def sun(lat: Column, lon: Column, doy: Column, tz: float = -4.0) -> tuple[Column, Column]:
    """(sunrise, sunset) in local hours, approximately."""
    decl = 0.4093 * F.sin(F.lit(2 * math.pi / 365) * (doy - 81))
    h = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(F.radians(lat)) * F.tan(decl)))) * (180 / math.pi / 15)
    noon = 12 - (lon / 15 - tz)
    return noon - h, noon + h


def _pairs(ring: Column) -> Column:
    """Consecutive points of an array of structs (x, y)."""
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def ring_area(ring: Column) -> Column:
    """Planar area of a closed ring, positive."""
    return F.abs(F.aggregate(_pairs(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def line_km(points: Column) -> Column:
    """Length of an array of structs (x = lon, y = lat)."""
    return F.aggregate(_pairs(points), F.lit(0.0), lambda s, p: s + haversine_km(p["a"]["y"], p["a"]["x"], p["b"]["y"], p["b"]["x"]))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: does a ray to the east cross the ring an odd number of times."""

    def crosses(p):
        ay, by = p["a"]["y"], p["b"]["y"]
        at = p["a"]["x"] + (y - ay) * (p["b"]["x"] - p["a"]["x"]) / F.when(by != ay, by - ay)
        return ((ay > y) != (by > y)) & F.coalesce(x < at, F.lit(False))

    return F.aggregate(_pairs(ring), F.lit(False), lambda s, p: s != crosses(p))


def lambert(lat: Column, lon: Column, p1: float = 60.0, p2: float = 46.0, lat0: float = 44.0, lon0: float = -68.5, a: float = 6378137.0, f: float = 1 / 298.257222101) -> tuple[Column, Column]:
    """(x, y) of the conformal conic projection with two parallels (the working system of Quebec by default)."""
    e = math.sqrt(2 * f - f * f)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    r1, r2, r0 = (math.radians(x) for x in (p1, p2, lat0))
    n = (math.log(m(r1)) - math.log(m(r2))) / (math.log(t(r1)) - math.log(t(r2)))
    big = m(r1) / (n * t(r1) ** n)
    rho0 = a * big * t(r0) ** n
    s = F.sin(F.radians(lat))
    tt = F.tan(F.lit(math.pi / 4) - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    rho = a * big * F.pow(tt, F.lit(n))
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def lambert_inverse(x: Column, y: Column, p1: float = 60.0, p2: float = 46.0, lat0: float = 44.0, lon0: float = -68.5, a: float = 6378137.0, f: float = 1 / 298.257222101, rounds: int = 6) -> tuple[Column, Column]:
    """(lat, lon) from lambert's x, y; the latitude by fixed-point iteration."""
    e = math.sqrt(2 * f - f * f)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    r1, r2, r0 = (math.radians(v) for v in (p1, p2, lat0))
    n = (math.log(m(r1)) - math.log(m(r2))) / (math.log(t(r1)) - math.log(t(r2)))
    big = m(r1) / (n * t(r1) ** n)
    dy = a * big * t(r0) ** n - y
    tt = F.pow(F.hypot(x, dy) / (a * big), F.lit(1 / n))
    lat = F.lit(math.pi / 2) - 2 * F.atan(tt)
    for _ in range(rounds):
        lat = F.lit(math.pi / 2) - 2 * F.atan(tt * F.pow((1 - e * F.sin(lat)) / (1 + e * F.sin(lat)), F.lit(e / 2)))
    return F.degrees(lat), F.degrees(F.atan2(x, dy) / n) + lon0


def kml_colour(rgb: Column) -> Column:
    """#rrggbb to aabbggrr, opaque."""
    return F.lower(F.concat(F.lit("ff"), F.substring(rgb, 6, 2), F.substring(rgb, 4, 2), F.substring(rgb, 2, 2)))


def ring_km2(ring: Column) -> Column:
    """Area on the sphere of an open ring, an array of structs (x = lon, y = lat); 0 under three points."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, after, lambda p, q: F.radians(q["x"] - p["x"]) * (2 + F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"]))))
    total = F.aggregate(sides, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(total) * EARTH_KM**2 / 2)


#: Metres from a caller to the shooter and to the middle scent wick, and from that to the outer ones (fixed values).
SHOOTER_M, WICK_M, FLANK_M = 70.0, 45.0, 25.0


def scent_points(lat: Column, lon: Column, wind_from: Column, shooter_m: float = SHOOTER_M, wick_m: float = WICK_M, flank_m: float = FLANK_M) -> Column:
    """Array of structs (role, lat, lon) downwind of a caller: the shooter, the wick between the two and one to either side of it; a west wind where none is known."""
    down = F.pmod(F.coalesce(wind_from.cast("double"), F.lit(270.0)) + 180, F.lit(360.0))
    spot = lambda role, p: F.struct(F.lit(role).alias("role"), p[0].alias("lat"), p[1].alias("lon"))
    mid = destination(lat, lon, down, F.lit(wick_m / 1000))
    side = lambda turn: destination(mid[0], mid[1], F.pmod(down + turn, F.lit(360.0)), F.lit(flank_m / 1000))
    return F.array(spot("shooter", destination(lat, lon, down, F.lit(shooter_m / 1000))), spot("wick", mid), spot("right", side(90)), spot("left", side(270)))

"""Pointwise map algebra on nullable columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance and cost where nothing is in reach, and the least value that means so (fixed values).
FAR, FAR_TEST, WALL = 1e6, 5e5, 1e7

# Browse and cover scores by land-cover class, and curves (years since, browse).
BROWSE_BY_CLASS = {20: 1.0, 30: 0.7, 90: 0.6, 100: 0.3, 40: 0.5, 10: 0.2, 60: 0.05, 80: 0.0}
COVER_BY_CLASS = {10: 0.9, 20: 0.35, 90: 0.15}
BURN_CURVE = [(0, 0.05), (5, 0.05), (9, 0.35), (14, 0.85), (18, 1.00), (22, 1.00), (27, 0.80), (35, 0.45), (60, 0.15), (200, 0.10)]
CUT_CURVE = [(0, 0.05), (4, 0.15), (8, 0.55), (12, 0.95), (18, 1.00), (25, 0.85), (32, 0.50), (45, 0.30), (80, 0.15)]
HSM_WEIGHTS = {"browse": 0.30, "cover": 0.20, "water": 0.10, "terrain": 0.10, "edge": 0.30}


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """lo..hi, null kept (greatest and least alone would skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x)))


def normalize(x: Column, lo, hi, invert: bool = False) -> Column:
    """Linear to 0..1 between lo and hi; a degenerate range is widened by 1e-6."""
    lo, hi = num(lo), num(hi)
    t = clip((x - lo) / F.when(hi - lo < 1e-6, F.lit(1e-6)).otherwise(hi - lo))
    return 1 - t if invert else t


def prox(d: Column, optimal, falloff) -> Column:
    """1 within optimal, linear to 0 over falloff."""
    return clip(1 - (d - num(optimal)) / num(falloff))


def interp(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, constant outside."""
    out = F.when(x <= float(knots[0][0]), F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= float(x1), F.lit(float(y0)) + (x - float(x0)) * (float(y1 - y0) / float(x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(knots[-1][1]))))


def class_score(code: Column, scores: Mapping[int, float], default: float | None = 0.0) -> Column:
    """Score of a class by a literal map; null stays null."""
    table = F.create_map(*[F.lit(v) for kv in scores.items() for v in (int(kv[0]), float(kv[1]))])
    got = F.element_at(table, code.cast("int"))
    return F.when(code.isNotNull(), got if default is None else F.coalesce(got, F.lit(float(default))))


def fraction_score(fractions: Mapping[int, Column], scores: Mapping[int, float]) -> Column:
    """Sum of score times areal fraction over the classes at hand, 0..1."""
    return clip(reduce(lambda a, b: a + b, [F.coalesce(fractions[k], F.lit(0.0)) * v for k, v in scores.items() if k in fractions]))


def blend(base: Column, refined: Column, w_base: float = 0.6) -> Column:
    """w_base * base + (1 - w_base) * refined, the base alone where the refining source is missing."""
    return F.when(refined.isNull(), base).otherwise(w_base * base + (1 - w_base) * refined)


def precedence(sources: Sequence[Column]) -> tuple[Column, Column]:
    """(value, code): the first source present, and its number from 1 (0 for none)."""
    code = reduce(lambda acc, kv: acc.when(kv[1].isNotNull(), F.lit(kv[0])), enumerate(sources[1:], 2), F.when(sources[0].isNotNull(), F.lit(1))).otherwise(F.lit(0))
    return F.coalesce(*sources), code


def corroboration(sources: Sequence[Column]) -> Column:
    """1 - |winner - mean of the other sources present|; 0.5 where the winner stands alone, null where there is none."""
    seen = F.filter(F.array(*sources), lambda x: x.isNotNull())
    winner = F.coalesce(*sources)
    others = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) - winner
    return F.when(winner.isNotNull(), F.when(F.size(seen) > 1, 1 - F.abs(winner - others / (F.size(seen) - 1))).otherwise(F.lit(0.5)))


def weighted(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of weight times part."""
    return reduce(lambda a, b: a + b, [parts[k] * float(w) for k, w in weights.items()])


def weighted_present(parts: Sequence[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that are there."""
    top = reduce(lambda a, b: a + b, [F.coalesce(p * w, F.lit(0.0)) for w, p in parts])
    bottom = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for w, p in parts])
    return top / F.when(bottom > 0, bottom)


def habitat(browse: Column, cover: Column, water: Column, terrain: Column, edge: Column, slope: Column, on_water: Column, steep: float = 20.0) -> Column:
    """Weighted overlay, 0.3 of it on steep ground, null on water."""
    score = clip(weighted({"browse": browse, "cover": cover, "water": water, "terrain": terrain, "edge": edge}, HSM_WEIGHTS))
    return F.when(~F.coalesce(on_water, F.lit(False)), F.when(slope > steep, score * 0.3).otherwise(score))


def ndvi(nir: Column, red: Column) -> Column:
    """Vegetation index; zero reflectance is missing."""
    return F.when((nir > 0) & (red > 0), (nir - red) / (nir + red + 1e-6))


def ndvi_browse(n: Column) -> Column:
    n = clip(n, -0.2, 0.9)
    return clip((n - 0.15) / 0.5) * clip(1 - (n - 0.8) / 0.15)


def ndvi_cover(n: Column) -> Column:
    return clip((clip(n, -0.2, 0.9) - 0.5) / 0.4)


def stand_cover(cover: Column, closure: Column) -> Column:
    return clip(cover * (0.5 + 0.5 * closure))


def cow_bull(browse: Column, treefrac: Column) -> tuple[Column, Column]:
    return clip(browse * (0.15 + 0.85 * treefrac)), clip(browse * (0.30 + 0.70 * (1 - treefrac)))


def thermal_refuge(cover: Column, d_water: Column, low: Column, cool: Column, slope: Column) -> Column:
    """Dense cover ramp times the better of wet-cool and slope-gated aspect-cool."""
    dense = normalize(cover, 0.60, 0.85)
    wet = F.greatest(prox(d_water, 100, 350), 0.7 * low)
    return clip(dense * (0.12 + 0.88 * F.greatest(wet, cool * normalize(slope, 3, 12))))


def rut_surface(edge: Column, wet_prox: Column, funnel: Column, wallow: Column, hub: Column) -> Column:
    return clip(0.55 * edge * (0.5 + 0.5 * wet_prox) + 0.30 * funnel + 0.35 * wallow + 0.30 * hub)


def wetness(tpi: Column, slope: Column) -> Column:
    return normalize(-tpi, -5, 15) * normalize(slope, 0, 15, invert=True)


def feeding(browse: Column, edge: Column, water_prox: Column, aquatic: Column, low: Column, bonus: float = 0.2) -> Column:
    water = 0.35 + (0.30 + 0.35 * aquatic) * F.coalesce(water_prox, F.lit(0.4))
    raw = clip(browse * (0.5 + 0.5 * edge) * water * (1 + bonus * browse))
    return clip(raw * (0.85 + 0.15 * F.coalesce(low, F.lit(0.5))))


def midday(feed: Column, refuge: Column) -> tuple[Column, Column]:
    """(cool day, warm day)."""
    return clip(0.65 * feed + 0.35 * refuge), clip(0.15 * feed + 0.85 * refuge)


def cruise(rut: Column, funnel: Column) -> Column:
    return clip(rut * (0.55 + 0.45 * clip(funnel)))


def refuge_weight(t_max: Column, onset: float = 14.0, severe: float = 20.0) -> Column:
    """Share of midday in cover: a ramp from onset to severe; 0.5 where the temperature is unknown."""
    severe = severe if severe > onset else onset + 1
    return F.coalesce(clip((t_max - onset) / (severe - onset)), F.lit(0.5))


def aquatic_weight(mean_doy: Column) -> Column:
    """Season of aquatic feeding: 1 to day 212, 0 from day 263, 0 without dates."""
    return F.coalesce(clip((263 - mean_doy) / (263 - 212.0)), F.lit(0.0))


def friction(slope: Column, cls: Column) -> Column:
    base = 1 + clip(slope, 0, 60) / 6
    return base + F.when(cls == 90, 3.0).when(cls == 10, 0.5).otherwise(0.0)


def reach_decay(d_road: Column, walk_m: Column, d_water: Column | None = None, paddle: float | None = None) -> Column:
    """1 within the walk, falling to 0 over 0.6 of it; a boat adds paddle times the walk measured from water."""
    walk = F.greatest(F.lit(1000.0), walk_m)
    land = clip(1 - (d_road - walk) / (0.6 * walk))
    if d_water is None:
        return land
    far = walk * float(paddle)
    return F.greatest(land, clip(1 - (d_water - far) / (0.6 * far)))


def pressure(d_road: Column, camps: Column | None = None, decay_m: float = 1500.0) -> Column:
    p = F.exp(-d_road / decay_m)
    return p if camps is None else 1 - (1 - p) * (1 - camps)


def phase_blend(base: Column, parts: Sequence[tuple[float, Column]]) -> Column:
    signal = weighted_present(parts)
    return F.when(signal.isNull(), base).otherwise(0.4 * base + 0.6 * signal)


def huntability(phase: Column, extraction: Column, pressed: Column) -> Column:
    retrieval = extraction * (1 - 0.25 * pressed)
    return phase * clip(retrieval / 0.05) * (0.35 + 0.65 * retrieval)


def walk_cost(slope: Column, cls: Column, wet: Column, trail: Column, road: Column, water: Column) -> Column:
    """Friction on foot: bush, then trails and rail, then roads, then water, the later winning."""
    f = lambda x: F.coalesce(x, F.lit(False))
    bush = 1 + F.coalesce(slope, F.lit(0.0)) / 10 + F.when(cls == 90, 3.0).otherwise(0.0) + F.when(f(wet), 3.0).otherwise(0.0)
    return F.when(f(water) | F.coalesce(cls == 80, F.lit(False)), F.lit(WALL)).when(f(road), F.lit(0.05)).when(f(trail), F.lit(0.35)).otherwise(bush)


def water_cost(cls: Column) -> Column:
    return F.when(cls.isin(80, 90), 1.0).otherwise(60.0)


def glassing(prominence: Column, below_summit: Column, mean_browse: Column, full: float = 45.0) -> Column:
    return clip(prominence / full) * clip(1 - below_summit / 15) * clip(mean_browse / 0.40)


def camp_preference(d_road: Column, d_water: Column, hunt: Column) -> Column:
    """Set back from the road, near water, on good ground."""
    back = F.least(d_road / 400, F.lit(1.0)) * F.exp(-F.greatest(d_road - 400, F.lit(0.0)) / 900)
    return back * F.exp(-d_water / 500) * hunt


def near_water(hunt: Column, d_water: Column) -> Column:
    return hunt * F.exp(-d_water / 400)


def funnel_strength(half_width: Column, local_mean: Column) -> Column:
    """Narrow times pinch of a corridor from the distance to its barrier."""
    pinch = clip((local_mean - half_width) / (local_mean + 1e-6))
    return clip((600 - 2 * half_width) / 350) * (0.35 + 0.65 * pinch)


def funnel_damped(strength: Column, topo: Column, wet: Column) -> Column:
    return clip(strength * (1 + 0.30 * clip(topo)) * (1 - 0.55 * F.when(F.coalesce(wet, F.lit(False)), 1.0).otherwise(0.0)))


def band(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """names[i] for edges[i-1] <= x < edges[i]."""
    out = F.when(x < float(edges[0]), F.lit(names[0]))
    for e, n in zip(edges[1:], names[1:]):
        out = out.when(x < float(e), F.lit(n))
    return F.when(x.isNotNull(), out.otherwise(F.lit(names[-1])))


def edge_of(neighbourhood: Column, within: Column) -> Column:
    """Interspersion of a cell: what the neighbourhood shows or, a little less, the mixture inside the cell; null only where both are."""
    return clip(F.greatest(neighbourhood, 0.85 * within))

"""Operators on small grids with known answers, and against brute force; answers do not depend on tiling."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import algebra as A
from cellweave.functions import decode as D
from cellweave.functions import geo as G
from cellweave.functions import season as S
from cellweave.grid import GridSpec
from cellweave.operators import cost as K
from cellweave.operators import focal as O
from cellweave.operators import necks as N
from cellweave.operators import shapes as H
from cellweave.operators import vector as V
from cellweave.operators import zonal as Z
from cellweave.plans import extract as X
from cellweave.plans import merge as M


def grid(spark, a, name="v"):
    """A DataFrame of an array; NaN becomes null."""
    rows = [(r, c, None if isinstance(a[r, c], float) and math.isnan(a[r, c]) else a[r, c].item()) for r in range(a.shape[0]) for c in range(a.shape[1])]
    kind = {"b": "boolean", "i": "long", "f": "double"}[a.dtype.kind]
    return spark.createDataFrame(rows, f"r int, c int, {name} {kind}")


def array(df, name, shape, fill=np.nan):
    out = np.full(shape, fill, dtype=object if fill is None else float)
    for r in df.select("r", "c", name).collect():
        out[r.r, r.c] = np.nan if r[name] is None else r[name]
    return out


def one(spark, *cols, **values):
    """The values of columns over a single row."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return list(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head())


def padded(a, lo, hi):
    return np.pad(a, ((lo, hi), (lo, hi)), mode="symmetric")


@pytest.mark.parametrize("size", [3, 4, 5])
def test_box_mean_reflects(spark, size):
    a = np.random.default_rng(0).normal(size=(7, 9))
    lo, hi = size // 2, size - size // 2 - 1
    p = padded(a, lo, hi)
    want = np.array([[p[r : r + size, c : c + size].mean() for c in range(9)] for r in range(7)])
    assert np.allclose(array(O.box_mean(grid(spark, a), "v", "m", (7, 9), size), "m", (7, 9)), want)


def test_gaussian_and_gaps(spark):
    a = np.random.default_rng(1).normal(size=(8, 8))
    w = np.array(O.gauss_weights(1.0))
    k = len(w) // 2
    p = padded(a, k, k)
    want = np.array([[(p[r : r + 2 * k + 1, c : c + 2 * k + 1] * np.outer(w, w)).sum() for c in range(8)] for r in range(8)])
    assert np.allclose(array(O.gaussian(grid(spark, a), "v", "s", (8, 8), 1.0), "s", (8, 8)), want)
    flat = np.full((8, 8), 3.0)
    flat[2:4, 2:4] = np.nan
    assert np.allclose(array(O.gaussian_present(grid(spark, flat), "v", "s", (8, 8), 1.0), "s", (8, 8)), 3.0)


def test_gradient(spark):
    a = np.random.default_rng(2).normal(size=(6, 5))
    gy, gx = np.gradient(a, 40.0, 40.0)
    got = O.slope_aspect(grid(spark, a), "v", 40.0)
    assert np.allclose(array(got, "slope", a.shape), np.degrees(np.arctan(np.hypot(gx, gy))))
    assert np.allclose(array(got, "aspect", a.shape), (np.degrees(np.arctan2(gy, -gx)) + 360) % 360)


def test_distances(spark):
    rng = np.random.default_rng(3)
    m = rng.random((23, 37)) < 0.03
    seeds = np.argwhere(m)
    r, c = np.mgrid[:23, :37]
    d2 = ((r[..., None] - seeds[:, 0]) ** 2 + (c[..., None] - seeds[:, 1]) ** 2).min(-1)
    l1 = (abs(r[..., None] - seeds[:, 0]) + abs(c[..., None] - seeds[:, 1])).min(-1)
    df = grid(spark, m, "m")
    assert np.allclose(array(H.euclidean(df, F.col("m"), "d", 10.0), "d", m.shape), np.sqrt(d2) * 10)
    assert (array(H.city_block(df, F.col("m"), "d"), "d", m.shape) == l1).all()
    assert (array(H.euclidean(df, F.lit(False), "d"), "d", m.shape) == A.FAR).all()


def flood(m):
    out = np.zeros(m.shape, int)
    n = 0
    for s in zip(*np.nonzero(m)):
        if not out[s]:
            n += 1
            out[s] = n
            todo = [s]
            while todo:
                a, b = todo.pop()
                for x, y in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= x < m.shape[0] and 0 <= y < m.shape[1] and m[x, y] and not out[x, y]:
                        out[x, y] = n
                        todo.append((x, y))
    return out


@pytest.mark.parametrize("tile", [4, 64])
def test_labels_do_not_depend_on_tiles(spark, tile):
    m = np.random.default_rng(4).random((19, 21)) < 0.6
    want = flood(m)
    names = {k: min(r * 21 + c for r, c in zip(*np.nonzero(want == k))) for k in range(1, want.max() + 1)}
    got = {(x.r, x.c): x.l for x in H.labels(grid(spark, m, "m"), F.col("m"), "l", 21, tile).collect()}
    assert got == {(r, c): names[want[r, c]] for r, c in zip(*np.nonzero(m))}


def test_morphology(spark):
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[4, 4] = False
    m[0, 8] = True
    df = grid(spark, m, "m")
    ok = lambda d, n: array(d, n, m.shape) == 1
    solid = m.copy()
    solid[4, 4] = True
    assert (ok(H.filled(df, "m", "f", (9, 9)), "f") == solid).all()
    opened = ok(H.opened(df, "m", "o", 1, (9, 9)), "o")
    assert not opened[0, 8] and opened[3, 2]
    assert ok(H.closed(df, "m", "o", 1, (9, 9)), "o")[4, 4]


def dijkstra(cost, seeds):
    d = np.full(cost.shape, np.inf)
    todo = [(0.0, *s) for s in seeds]
    for _, r, c in todo:
        d[r, c] = 0
    while todo:
        x, r, c = heapq.heappop(todo)
        if x > d[r, c]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                i, j = r + a, c + b
                if (a or b) and 0 <= i < cost.shape[0] and 0 <= j < cost.shape[1] and np.isfinite(cost[i, j]):
                    n = x + math.hypot(a, b) * (cost[r, c] + cost[i, j]) / 2
                    if n < d[i, j] - 1e-12:
                        d[i, j] = n
                        heapq.heappush(todo, (n, i, j))
    return d


@pytest.mark.parametrize("tile", [5, 128])
def test_cost_field(spark, tile):
    rng = np.random.default_rng(5)
    cost = rng.integers(1, 9, (16, 18)).astype(float)
    cost[rng.random(cost.shape) < 0.25] = np.nan
    cost[0, 0] = 1
    got = array(K.cost_field(grid(spark, cost, "k"), "k", (F.col("r") == 0) & (F.col("c") == 0), "d", tile), "d", cost.shape, np.inf)
    want = dijkstra(np.where(np.isnan(cost), np.inf, cost), [(0, 0)])
    assert np.allclose(np.where(np.isnan(got), np.inf, got), want)


def lattice(spark, trail=True):
    cost = np.full((60, 60), 1.14)
    if trail:
        cost[10] = 0.05
    return grid(spark, cost, "walk").withColumn("net", F.col("r") == 10)


def test_travel_modes(spark):
    at = lambda r, c: (F.col("r") == r) & (F.col("c") == c)
    df = lattice(spark, False)
    out = K.mode_route(df, "walk", F.col("net"), 0.010, at(10, 2), at(30, 50)).head()
    assert out["mode"] == "vehicle" and out.r == 10 and abs(out.c - 50) <= 20 and out.total < out.walk_only
    far = K.mode_route(df, "walk", F.col("net"), 0.010, at(40, 2), at(50, 4)).head()
    assert far["mode"] == "foot" and far.r is None
    path = K.least_cost_path(lattice(spark), "walk", at(12, 2), at(12, 50)).collect()
    assert {p.r for p in path} >= {10} and path[0].step == 0
    steps = sorted((p.step, p.r, p.c) for p in path)
    assert all(max(abs(a[1] - b[1]), abs(a[2] - b[2])) == 1 for a, b in zip(steps, steps[1:]))


def test_travel_modes_off_the_network(spark):
    """A spur to the network, its bound, a ride all the way, and boats put in at launches: the total of each by brute force."""
    at = lambda r, c: (F.col("r") == r) & (F.col("c") == c)
    foot, net = np.full((60, 60), 1.14), np.zeros((60, 60), bool)
    net[10] = True
    df = lattice(spark, False)

    def want(start, end, anchors, seeds=None, water=None, ride=0.010):
        rr, cc = np.indices(foot.shape)
        on = net if water is None else water
        cost = np.where(on, ride, np.inf)
        for a, b in anchors:
            cost = np.where(~on & (np.hypot(rr - a, cc - b) * 40 <= 1500), 0.50, cost)
        there = dijkstra(cost, seeds or [start])
        both = np.where(on, there + dijkstra(foot, [end]), np.inf)
        return float(both.min()), np.unravel_index(int(both.argmin()), both.shape), there[end]

    camp = K.mode_route(df, "walk", F.col("net"), 0.010, at(14, 2), at(10, 55)).head()  # 160 m off the network
    total, place, _ = want((14, 2), (10, 55), [(14, 2)])
    assert (camp["mode"], camp.r, camp.c) == ("vehicle", *place) and abs(camp.total - total) < 1e-9
    far = K.mode_route(df, "walk", F.col("net"), 0.010, at(53, 2), at(53, 55)).head()  # 43 cells off, the spur ends at 37.5
    assert far["mode"] == "foot" and far.r is None and abs(far.total - 53 * 1.14) < 1e-9
    near = K.mode_route(df, "walk", F.col("net"), 0.010, at(47, 2), at(10, 55)).head()  # 37 cells
    assert near["mode"] == "vehicle" and abs(near.total - want((47, 2), (10, 55), [(47, 2)])[0]) < 1e-9

    ends = K.mode_route(df, "walk", F.col("net"), 0.010, at(13, 4), at(13, 12), end_drivable=True).head()
    assert (ends["mode"], ends.r, ends.c) == ("vehicle", 13, 12) and abs(ends.total - want((13, 4), (13, 12), [(13, 4), (13, 12)])[2]) < 1e-9

    water = np.zeros((60, 60), bool)
    water[30:40] = True
    lake = grid(spark, foot, "walk").withColumn("net", F.col("r").between(30, 39))
    boat = lambda launch: K.mode_route(lake, "walk", F.col("net"), 0.012, at(28, 3), at(42, 55), launch=launch).head()
    total, place, _ = want((28, 3), (42, 55), [], [(30, 2), (30, 3)], water, 0.012)
    put_in = boat(F.col("c").isin(2, 3) & (F.col("r") <= 30))  # cells off the water are no launches
    assert (put_in["mode"], put_in.r, put_in.c) == ("vehicle", *place) and abs(put_in.total - total) < 1e-9
    assert boat(F.lit(False))["mode"] == "foot"
    assert boat(at(39, 55))["mode"] == "foot"  # best left where it is put in


def test_isthmus_and_peninsula(spark):
    for spit, kept in ((False, True), (True, False)):
        ground = np.ones((60, 60), bool)
        if spit:
            ground[25:] = False
            ground[25:45, 28:32] = True
        else:
            ground[25:29] = False
            ground[25:29, 28:32] = True
        core = np.zeros_like(ground)
        core[26, 29] = True
        df = grid(spark, ground, "p").join(grid(spark, core, "k"), ["r", "c"])
        s = N.neck_sides(df, F.col("k"), F.col("p"), F.lit(2.0), 60, halo=30).select("second", N.linkage(F.col("second") * 0.0016).alias("l")).head()
        assert (s.l > 0) == kept


def test_fractions(spark):
    a = np.full((4, 4), 20)
    a[:, :2] = 10
    b = Z.blocks(grid(spark, a, "cls"), 4).groupBy("br", "bc").agg(F.avg((F.col("cls") == 10).cast("double")).alias("f")).head()
    assert b.f == 0.5


def test_polygons(spark):
    a = np.zeros((6, 6), int)
    a[1:5, 1:5] = 7
    a[2:4, 2:4] = 0
    p = V.polygonise(grid(spark, a, "l").where("l > 0"), "l").orderBy("hole").collect()
    assert [(x.hole, x.area) for x in p] == [(False, 16.0), (True, 4.0)]
    assert len(p[0].ring) == 5 and p[0].ring[0] == p[0].ring[-1]
    ring = [(0.0, 0.0), (0.01, 1.0), (0.0, 2.0), (3.0, 2.0), (3.0, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, [(x, y) for x, y in ring]), (2, None)], "id int, ring array<struct<x: double, y: double>>")
    got = {r.id: r.ring for r in V.simplify(df, 0.1).collect()}
    assert [tuple(x) for x in got[1]] == [ring[0], ring[2], ring[3], ring[4], ring[5]] and got[2] is None


def test_nearest_edges(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0)], "id int, x double, y double")
    t = spark.createDataFrame([(7, 1.0, 0.0), (5, -1.0, 0.0)], "id int, x double, y double")
    assert {r.id: (r.target, r.dist) for r in V.nearest(pts, t, 2.0).collect()} == {1: (5, 1.0), 2: (7, 899.0)}
    assert {r.target for r in V.nearest(pts, t.limit(0), 2.0).collect()} == {None}


def test_null_algebra(spark):
    n = F.lit(None).cast("double")
    assert one(spark, A.clip(n), A.normalize(n, 0, 1), A.prox(n, 1, 1), A.interp(n, A.BURN_CURVE), A.ndvi_browse(n)) == [None] * 5
    assert one(spark, A.blend(F.lit(0.5), n), A.corroboration([n, F.lit(0.4), n]), A.refuge_weight(n), A.weighted_present([(1, n)])) == [0.5, 0.5, 0.5, None]
    v, code = A.precedence([n, F.lit(0.2), F.lit(0.9)])
    assert one(spark, v, code) == [0.2, 2]
    assert one(spark, A.normalize(F.lit(3.0), 2, 2)) == [1.0]


def test_decisions(spark):
    b = lambda s: D.species_browse(F.lit(s))
    birch, mixed, spruce, unknown = one(spark, b("BPBP"), b("ENBP"), b("ENEN"), b("??"))
    assert birch == 1.0 and spruce == 0.0 and spruce < mixed < birch and unknown <= 0.10
    kinds = one(spark, *[D.lease_kind(F.lit(x)) for x in ("Abri sommaire en forêt", "VILLÉGIATURE", "Éolienne", None)])
    assert kinds == ["abri_sommaire", "villegiature", None, None]
    assert one(spark, *[D.clamped(F.lit(x), 6, 0.5, 25) for x in ("0", "x", None, "99")]) == [0.5, 6.0, 6.0, 25.0]
    for km, ok in ((0.0, True), (3.9, True), (4.1, False)):
        assert one(spark, D.capability(F.lit(None).cast("double"), F.lit(km), F.lit(9.0), F.lit(4.0), F.lit(False), F.lit(False))[0]) == [ok]
    cov = lambda a, b: D.coverage(F.lit(52.0), F.lit(None).cast("double"), F.lit(a), F.lit(b))
    assert one(spark, cov(47.0, 48.0), cov(51.5, 52.5), cov(52.0, 53.0)) == ["in", "partial", "out"]


def test_calendar_and_wind(spark):
    x = lambda d: S.days_from_anchor(F.lit(d).cast("date"))
    assert one(spark, S.phase(x("2026-09-20")), S.phase(x("2026-10-02")), S.phase(x("2026-10-20")), S.phase(x("2026-12-01"))) == ["seeking", "peak", "post", "outside"]
    early, peak = one(spark, S.call_response(x("2026-09-26")), S.call_response(x("2026-10-02")))
    assert early > peak
    assert one(spark, G.angle_between(F.lit(350.0), F.lit(10.0)), G.compass(F.lit(359.0)), G.compass(F.lit(180.0))) == [20.0, "N", "S"]


def test_extraction(spark):
    a = np.zeros((40, 40))
    a[5:15, 5:15] = 0.9
    a[28:36, 25:37] = 0.7
    got = X.focus_areas(grid(spark, a, "s"), (40, 40), "s", 0.26, 1.0, 5, 12, 10).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r")).orderBy("rank").collect()
    assert [g.r for g in got][:2] == [5, 28] and got[0].n >= 80
    none = X.focus_areas(grid(spark, np.zeros((12, 12)), "s"), (12, 12), "s", 0.26, 1.0, 3, 5, 4)
    assert none.count() == 0


def test_merge(spark):
    rows = [("a", 0, 1, 4.0, 0.5, "A"), ("b", 0, 1, 9.0, 0.5, "A"), ("a", 1, 1, 1.0, 0.2, None)]
    got = M.merge_areas(spark.createDataFrame(rows, "site string, win int, rank int, area_km2 double, habitat double, camp string")).orderBy("rank").collect()
    assert [(g.site, g.win, g.site_rank, g.camp) for g in got] == [("b", 0, 1, "B"), ("a", 0, 1, "A"), ("a", 1, 1, None)]
    assert one(spark, M.letters(F.lit(1)), M.letters(F.lit(26)), M.letters(F.lit(27)), M.letters(F.lit(53))) == ["A", "Z", "AA", "BA"]


def test_grid_spec(spark):
    g = GridSpec.over("EPSG:32198", 0.0, 0.0, 100.0, 79.0, 40.0)
    assert (g.w, g.h) == (3, 2) and g.cells(spark).count() == 6


def test_partitioning_does_not_matter(spark):
    rng = random.Random(0)
    rows = [(r, c, rng.random()) for r in range(15) for c in range(15)]
    outs = [sorted(tuple(x) for x in O.local_peaks(spark.createDataFrame(rows, "r int, c int, v double").repartition(n), "v", (15, 15), 2, F.lit(0.5)).select("r", "c").collect()) for n in (1, 7)]
    assert outs[0] == outs[1] and outs[0]


@pytest.mark.parametrize("size", [3, 7, 13, 31])
def test_windows_wider_than_the_grid(spark, size):
    """Edges are reflected again and again."""
    a = np.random.default_rng(size).random((5, 5))
    got = array(O.box_mean(grid(spark, a), "v", "m", (5, 5), size), "m", (5, 5))
    k = size // 2
    wide = np.pad(a, k, mode="symmetric")
    want = np.array([[wide[r : r + size, c : c + size].mean() for c in range(5)] for r in range(5)])
    assert np.allclose(got, want)


def test_slope_beside_nodata(spark):
    """Differences are one-sided at the edges of the grid only; beside a null or missing cell they are null."""
    a = np.arange(25.0).reshape(5, 5) ** 1.5
    a[2, 2] = np.nan
    want = np.gradient(a)
    for df in (grid(spark, a), grid(spark, a).where("v is not null")):
        for axis, w in zip(("r", "c"), want):
            got = array(O.derivative(df, "v", "d", axis), "d", (5, 5))
            there = ~np.isnan(a) if df.count() < 25 else np.ones((5, 5), bool)
            assert np.allclose(got[there], w[there], equal_nan=True)


def test_cost_and_nearest_have_no_cap(spark):
    """A target a thousand times as far as the first reach, and a route through many tiles, are found."""
    near = V.nearest(spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"), spark.createDataFrame([(7, 3000.0, 4000.0)], "id int, x double, y double"), 0.01).collect()
    assert [(r.id, r.target, r.dist) for r in near] == [(1, 7, 5000.0)]
    line = np.ones((1, 40))
    got = array(K.cost_field(grid(spark, line), "v", F.col("c") == 0, "d", tile=4), "d", (1, 40))
    assert np.allclose(got[0], np.arange(40.0))

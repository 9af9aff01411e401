"""Rings by list ranking, distances on the sphere, camp siting and the boat gate."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import sphere as S
from cellweave.operators import vector as V
from cellweave.plans import camps as C


def brute_rings(cells):
    """Every ring of a set of cells: edges with the cell on the right, right turns at pinch points."""
    heads = ((0, 1), (1, 0), (0, -1), (-1, 0))
    edges = set()
    for r, c in cells:
        for h, (dr, dc, a, b) in enumerate(((-1, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 1), (0, -1, 1, 0))):
            if (r + dr, c + dc) not in cells:
                edges.add((r + a, c + b, h))
    rings = []
    while edges:
        r, c, h = first = min(edges)
        ring = []
        while True:
            edges.discard((r, c, h))
            ring.append((r, c, h))
            r, c = r + heads[h][0], c + heads[h][1]
            options = [g for g in range(4) if (r, c, g) in edges or (r, c, g) == first]
            h = options[0] if len(options) == 1 else (h + 1) % 4
            if (r, c, h) == first:
                break
        turns = [p[:2] for i, p in enumerate(ring) if ring[i - 1][2] != p[2]]
        area = sum(p[1] * q[0] - q[1] * p[0] for p, q in zip(turns, turns[1:] + turns[:1])) / 2
        rings.append((area < 0, abs(area), [(float(c), float(r)) for r, c in turns + turns[:1]]))
    return rings


@pytest.mark.parametrize("tile", [5, 64])
def test_rings_over_tiles(spark, tile):
    rng = np.random.default_rng(9)
    labels = {1: {(r, c) for r in range(23) for c in range(31) if c % 4 != 3 or r in (0, 22)[: 1 + c % 8 // 4]}}  # a comb, teeth over many tiles
    labels[2] = {(r + 40, c) for r in range(16) for c in range(16) if rng.random() < 0.6}
    labels[3] = {(r + 60, c) for r in range(12) for c in range(12)} - {(r + 60, c) for r in range(3, 9) for c in range(3, 9)} | {(65, 5), (64, 4)}
    labels[4] = {(80, 0)}
    df = spark.createDataFrame([(k, *p) for k, v in labels.items() for p in v], "zone long, r int, c int")
    got = {}
    for x in V.polygonise(df, "zone", tile).collect():
        got.setdefault(x.zone, {})[x.ring_no] = (x.hole, x.area, [(p.x, p.y) for p in x.ring])
    assert set(got) == set(labels)
    for k, cells in labels.items():
        assert [got[k][i] for i in range(len(got[k]))] == brute_rings(cells), k
    assert V.polygonise(df.where("false"), "zone", tile).count() == 0


def km(p, q):
    a, b = math.radians(p[0]), math.radians(q[0])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_distances_over_the_date_line_and_the_poles(spark):
    rng = random.Random(11)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(120)] + [(rng.uniform(46, 47), rng.choice((-180, 180)) + rng.uniform(-1, 1)) for _ in range(30)]
    places += [(90.0, 0.0), (89.9, 179.0), (-90.0, 5.0), (-89.8, -100.0), (0.0, 180.0), (0.0, -180.0), (46.5, 179.99)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lat double, lon double")
    for reach in (15.0, 400.0, 3000.0, 25000.0):
        got = [(x.a, x.b) for x in S.within_km(df, df, reach).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, p in enumerate(places) for j, q in enumerate(places) if km(p, q) <= reach}
    some = places[:9]
    near = {x.id: (x.target, x.km) for x in S.nearest_km(df, spark.createDataFrame([(i, *p) for i, p in enumerate(some)], "id int, lat double, lon double"), 5.0).collect()}
    for i, p in enumerate(places):
        assert near[i][1] == pytest.approx(min(km(p, q) for q in some), abs=1e-6)
    assert {x.target for x in S.nearest_km(df.limit(3), df.where("false")).collect()} == {None}


def test_camps_are_shared_and_lettered(spark):
    areas = [(1, 47.0, -78.0), (2, 47.1, -78.0), (3, 47.2, -78.0), (4, 48.0, -78.0), (5, 49.0, -78.0), (6, 49.05, -78.0)]
    frame = spark.createDataFrame(areas, "rank int, lat double, lon double")
    roads = spark.createDataFrame([(10, 47.12, -78.01), (11, 48.3, -78.0), (12, 49.0, -78.2)], "id int, lat double, lon double")
    camps, packin = C.camp_sites(frame, roads)
    got = {x.camp: x for x in camps.collect()}
    assert {k: (v.areas, v.lat, v.lon, v.access) for k, v in got.items()} == {"A": (3, 47.12, -78.01, "road"), "B": (2, 49.0, -78.2, "road"), "C": (1, 48.3, -78.0, "road")}
    way = {x["rank"]: (x.camp, x.km) for x in packin.collect()}
    assert {k: v[0] for k, v in way.items()} == {1: "A", 2: "A", 3: "A", 4: "C", 5: "B", 6: "B"}
    assert way[1][1] == round(km((47.12, -78.01), (47.0, -78.0)), 1) and got["A"].max_packin_km == max(way[i][1] for i in (1, 2, 3))
    none, _ = C.camp_sites(frame, roads.where("false"))
    assert {x.camp: (round(x.lat, 3), x.access) for x in none.collect()}["A"] == (47.1, "water/centroid")
    own, packin = C.camp_sites(frame, roads, fixed=(47.5, -78.5))
    assert [(x.camp, x.lat, x.access, x.areas) for x in own.collect()] == [("A", 47.5, "yours", 6)]
    assert {x.km for x in packin.where("rank = 4").collect()} == {round(km((47.5, -78.5), (48.0, -78.0)), 1)}


def test_boat_gate_moves_all_tables(spark):
    areas = spark.createDataFrame([("p", 1, "ok", None), ("p", 2, "ok", None), ("p", 3, "excluded", "far"), ("p", 4, None, None), ("q", 1, "ok", None), ("q", 2, "excluded", "far"), ("q", 3, "ok", None)], "plan string, rank int, status string, reason string")
    crossings = spark.createDataFrame([("p", 1, "boat", "x"), ("p", 1, "boat", "y"), ("p", 2, "ford", "z"), ("p", None, "boat", "n"), ("p", 9, "boat", "u"), ("q", 1, "ford", "v"), ("q", 2, "boat", "w")], "plan string, rank int, kind string, id string")
    sites = spark.createDataFrame([("p", r, f"s{r}") for r in (1, 2, 3, 4, 7)] + [("q", 3, "t3")], "plan string, rank int, id string")
    out = C.boat_gate(areas, crossings, F.lit(False), {"sites": sites})
    a = {(x.plan, x["rank"]): (x.status, x.reason) for x in out["areas"].collect()}
    assert a == {("p", 1): ("ok", None), ("p", 2): (None, None), ("p", 3): ("excluded", C.NO_BOAT), ("p", 4): ("excluded", "far"), ("q", 1): ("ok", None), ("q", 2): ("excluded", "far"), ("q", 3): ("ok", None)}
    assert {x.id: x["rank"] for x in out["sites"].collect()} == {"s1": 3, "s2": 1, "s3": 4, "s4": 2, "s7": 7, "t3": 3}
    assert {x.id: x["rank"] for x in out["crossings"].collect()} == {"x": 3, "y": 3, "z": 1, "n": None, "u": 9, "v": 1, "w": 2}
    same = C.boat_gate(areas, crossings, F.lit(True), {})["areas"]
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, areas.collect()), key=str)


def test_clusters_on_the_sphere_link_squares(spark, monkeypatch):
    """Hops of less than km are found whole, over the date line and the poles too, and dense ground gives links of squares, not of points."""
    rng = random.Random(3)
    places = [(46 + rng.uniform(0, 1.3), rng.choice((-180, 180)) + rng.uniform(-1, 1)) for _ in range(90)] + [(rng.uniform(89, 90), rng.uniform(-180, 180)) for _ in range(25)]
    places += [(rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4)) for _ in range(25)] + [(90.0, 7.0), (-90.0, 1.0), (12.0, 12.0), (12.0, 12.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(999, None, 4.0)], "id int, lat double, lon double")
    for reach in (4.0, 15.0, 45.0):
        want = list(range(len(places)))
        for _ in want:
            after = [min(want[j] for j, q in enumerate(places) if j == i or km(p, q) < reach) for i, p in enumerate(places)]
            if after == want:
                break
            want = after
        got = {x.id: x.cluster for x in S.clusters_km(df, reach).collect()}
        assert got.pop(999) == 999
        assert got == dict(enumerate(want))
    seen = []
    links = S.components
    monkeypatch.setattr(S, "components", lambda x: seen.append(x.count()) or links(x))
    dense = spark.range(3000).selectExpr("id", "46 + (id * 37 % 1000) / 5000.0 lat", "-78 + (id * 61 % 997) / 5000.0 lon")
    assert {x.cluster for x in S.clusters_km(dense, 15.0).collect()} == {0}
    assert sum(seen) < 3000

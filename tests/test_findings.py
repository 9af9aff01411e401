"""Cases of review findings on the grid side."""

import math

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import focal as O
from cellweave.operators import vector as V
from cellweave.operators import zonal as Z
from cellweave.plans import nested as N


def _points(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_exact_mean_of_a_half(spark):
    """Ten tenths, 0.7 and 0.2 are 1.9; added as doubles they are not."""
    df = spark.createDataFrame([(0.1,)] * 10 + [(0.7,), (0.2,)], "v double")
    assert df.agg(Z.exact_mean(F.col("v"))).head()[0] == 1.9 / 12
    odd = spark.createDataFrame([(1e300,), (1e300,), (None,)], "v double")
    assert odd.agg(Z.exact_mean(F.col("v"))).head()[0] == 1e300


def test_means_in_order(spark):
    v = [0.1, 0.7, 0.3, 1e16, -1e16, 0.9, 0.6] * 9
    df = spark.createDataFrame([(1, i // 8, i % 8, x) for i, x in enumerate(v)] + [(2, 0, 0, None)], "z int, r int, c int, v double").repartition(5)
    total = 0.0
    for x in v:
        total += x
    assert {r.z: r.v for r in Z.ordered_means(df, "z", ["v"], ["r", "c"]).collect()} == {1: total / len(v), 2: None}


def test_quantile_is_rounded_once(spark):
    v = [0.5] * 3 + [0.7] * 62 + [0.8] * 7
    got = {r.k: r.q for r in Z.quantile(spark.createDataFrame([(1, x) for x in v] + [(2, 3.0), (2, None)], "k int, v double"), ["k"], "v", 0.9, "q").collect()}
    p = 71 * 0.9
    d = p - math.floor(p)
    lo, hi = sorted(v)[math.floor(p)], sorted(v)[math.ceil(p)]
    assert got == {1: math.fma(lo, 1 - d, hi * d), 2: 3.0}


def test_short_and_long_rings_hold_the_same_points(spark, monkeypatch):
    ring = lambda x, y, s: [{"x": x + a * s, "y": y + b * s} for a, b in ((0, -1), (1, 0), (0, 1), (-1, 0), (0, -1))]
    rings = spark.createDataFrame([(k, ring(k % 7, k % 5, 1.5 + k % 3)) for k in range(40)], "k int, ring array<struct<x: double, y: double>>")
    pts = _points(spark, [(i, i * 37 % 101 / 10 + 0.0137, i * 61 % 97 / 10 + 0.0071) for i in range(60)])
    hits = lambda: sorted((r.id, r.k) for r in V.point_in_ring(pts, rings, 2.0).collect())
    want = sorted((i, k) for i in range(60) for k in range(40) if abs(i * 37 % 101 / 10 + 0.0137 - k % 7) + abs(i * 61 % 97 / 10 + 0.0071 - k % 5) < 1.5 + k % 3)
    assert hits() == want
    monkeypatch.setattr(V, "SHORT_RING", 3)
    assert hits() == want


def test_crossings_without_a_shuffle_of_what_was_found(spark):
    line = lambda *p: [{"x": a, "y": b} for a, b in p]
    a = spark.createDataFrame([(k, line((0.0, float(k % 3)), (20.0, 10.0 + k % 3))) for k in range(6)], "id long, ring array<struct<x: double, y: double>>")
    b = spark.createDataFrame([(9, line((0.0, 9.0), (20.0, 3.0)))], "id long, ring array<struct<x: double, y: double>>")
    found = V.crossings(a, b, 2.0)
    assert sorted(r.a for r in found.collect()) == list(range(6))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    reps, members = V.equal_rings(a)
    assert sorted(r.id for r in reps.collect()) == [0, 1, 2] and sorted((r.id, r.rep) for r in members.collect()) == [(k, k % 3) for k in range(6)]


def test_cluster_and_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    xy = np.round(np.r_[rng.uniform(0, 12, (60, 2)), rng.uniform(16, 18, (30, 2)), [[40.0, 40.0]] * 3, [[25.0, 17.0]]], 2)
    pts = _points(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)])
    for d in (0.8, 2.0, 5.0):
        label = list(range(len(xy)))
        near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= d
        for _ in label:
            label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(xy))]
        assert [r.cluster for r in V.cluster(pts, d).orderBy("id").collect()] == label
    links = []
    whole, V.components = V.components, lambda e: links.append(e.count()) or whole(e)
    try:
        assert {r.cluster for r in V.cluster(_points(spark, [(i, i % 20 / 20, i % 31 / 31) for i in range(620)]), 8.0).collect()} == {0}
    finally:
        V.components = whole
    assert sum(links) < 10  # squares are linked, not 191,890 pairs of points
    asked = _points(spark, [(i, float(x) + 0.3, float(y)) for i, (x, y) in enumerate(xy)] + [(999, None, 1.0)])
    far = np.hypot(*((xy + [0.3, 0])[:, None] - xy[None]).transpose(2, 0, 1))
    got = {r.id: r.target for r in V.nearest(asked, pts, 50.0).collect()}
    assert got == {i: int(np.flatnonzero(far[i] == far[i].min())[0]) for i in range(len(xy))} | {999: None}


def test_wide_kernels_are_not_windows(spark):
    v = np.random.default_rng(3).random((9, 40))
    cells = spark.createDataFrame([(r, c, float(v[r, c])) for r in range(9) for c in range(40)], "r int, c int, v double")
    w = O.gauss_weights(20.0)
    k = len(w) // 2
    want = np.apply_along_axis(lambda x: np.convolve(np.pad(x, k, "symmetric"), w, "valid"), 1, v)
    want = np.apply_along_axis(lambda x: np.convolve(np.pad(x, k, "symmetric"), w, "valid"), 0, want)
    df = O.convolve(cells, "v", "s", (9, 40), w)
    assert max(abs(x.s - want[x.r, x.c]) for x in df.collect()) < 1e-12
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_store_has_files_by_put_and_not_by_area(spark, tmp_path):
    store = N.AreaStore(spark, f"file://{tmp_path}/store")
    store.put(spark.range(500).select(F.col("id").alias("area"), F.lit(1).alias("v")), "p")
    store.put(spark.range(2).select(F.col("id").alias("area"), F.lit(2).alias("v")), "p")
    assert store.get("p").agg(F.count("v"), F.sum("v")).head() == (500, 502)
    assert len(list((tmp_path / "store").rglob("*.parquet"))) < 100


def test_line_windows_are_running_ones(spark):
    """A frame from a row to the end of its line is added up anew for each row: quadratic in the side of the grid."""
    from cellweave.operators import shapes as S

    df = spark.range(400).selectExpr("cast(id div 20 as int) r", "cast(id % 20 as int) c", "id % 37 = 0 m")
    for out in (S.city_block(df, F.col("m"), "d"), S.euclidean(df, F.col("m"), "d"), S.opened(df, "m", "o", 1, (20, 20))):
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def test_chains_of_a_tile_are_those_of_all_its_labels(spark):
    """One call a tile and not one a label and tile; labels may share cells."""
    import pyarrow as pa

    rows = [(7, 1, 1), (8, 1, 2), (8, 2, 2), (9, 1, 2), (9, 1, 3)]
    got = V._chains((pa.scalar(0), pa.scalar(0)), pa.table(dict(zip(("zone", "r", "c"), zip(*rows)))), "zone", 8).to_pydict()
    assert sorted(got["zone"]) == [7, 8, 9] and set(got["xr"]) == {None}
    rings = V.polygonise(spark.createDataFrame(rows, "zone long, r int, c int"), "zone", 2).collect()
    assert {x.zone: (x.hole, x.area, len(x.ring)) for x in rings} == {7: (False, 1.0, 5), 8: (False, 2.0, 5), 9: (False, 2.0, 5)}


def test_tiles_settle_from_the_nearest_on(spark):
    """Distances are those of relaxing everything until nothing falls, bit by bit, also after news at the frame; a grid of 600 is one round."""
    from cellweave.operators import cost as K

    rng = np.random.default_rng(2)
    tile = K._Tile(0, 0, 24)
    tile.cost[1:-1, 1:-1] = np.where(rng.random((24, 24)) < 0.25, np.inf, rng.integers(0, 9, (24, 24)) * 0.7)
    tile.cost[0, 1:-1], tile.cost[1, 1] = 1.3, 0.7
    for at in ((1, 1), (0, 20)):
        tile.dist[at] = 0.5
        want = tile.dist.copy()
        while True:
            before = want.copy()
            for (a, b, _), length in zip(K._STEPS, tile.lengths):
                np.minimum(want[1:-1, 1:-1], want[1 + a : 25 + a, 1 + b : 25 + b] + length, out=want[1:-1, 1:-1])
            if (want == before).all():
                break
        tile.settle()
        assert (tile.dist == want).all()
    field = K.Field(spark.range(360_000).selectExpr("cast(id div 600 as int) r", "cast(id % 600 as int) c", "1.0 v"), "v", (F.col("r") == 0) & (F.col("c") == 0))
    assert field.rounds == 1 and field.settled().agg(F.count("dist")).head()[0] == 360_000
    field.close()


def test_no_grid_of_areas_is_broadcast(spark):
    """What an explode makes counts as large as what it is made of; the fine cells of all areas went through the driver."""
    cells = spark.range(900).selectExpr("cast(id div 30 as int) r", "cast(id % 30 as int) c", "cast(id * 37 % 101 as double) v")
    areas = spark.createDataFrame([(1, 10, 10), (2, 1, 29)], "area int, r int, c int")
    df = N.rerun(cells, "v", areas, 3, 3, 1, (30, 30), 200.0, F.col("v") < 25)
    assert len(df.collect()) == 2 * 21 * 21
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_surfaces_and_necks_of_areas_are_those_of_single_steps(spark):
    """Fine cells made where the working cells are have the values of interpolation point by point, also where cells are missing; windows and distances are those of whole grids."""
    from cellweave.operators import necks as K

    cells = spark.range(900).where("id % 7 != 3 and not (id div 30 between 8 and 10 and id % 30 between 9 and 12)").selectExpr("cast(id div 30 as int) r", "cast(id % 30 as int) c", "cast(id * 37 % 101 as double) v")
    areas = spark.createDataFrame([(1, 10, 10), (2, 1, 29), (3, 26, 2)], "area int, r int, c int")
    corners = N.boxes(areas, 3, (30, 30))
    for k in (1, 2, 3):
        fine, sides = N.nested(corners, 3, k, 1)
        want = {(x.area, x.r, x.c): x for x in N.interpolated(fine, cells, "v").collect()}
        made, _ = N.surfaces(corners, cells, "v", 3, k, 1)
        got = made.collect()
        assert len(got) == len(want) == 3 * sides[0] * sides[1] and any(x.v is None for x in got)
        for x in got:
            w = want[x.area, x.r, x.c]
            assert (x.pr, x.pc, x.inner) == (w.pr, w.pc, w.inner) and (x.fr, x.fc) == (w.fr, w.fc)
            assert x.v is None if w.v is None else abs(x.v - w.v) < 1e-12
        water = F.coalesce((F.col("v") < 25) & (F.col("area") != 3), F.lit(False))  # area 3 has none
        necks = {(x.area, x.r, x.c): x for x in N.fine_necks(made, water, 200.0, k, sides).collect()}
        whole = {(x.area, x.r, x.c): x for x in K.constriction(made, water, 200.0 / k, sides, 200.0, by=("area",)).collect()}
        assert len(necks) == 3 * (7 * k) ** 2
        assert all(x.db == whole[at].db and abs(x.strength - whole[at].strength) < 1e-9 for at, x in necks.items())


def _odd_events(spark, folder):
    """Some events without a user; a user whose mean is a last bit below a half, in more than twelve decimals."""
    rows = [(i, None if i % 7 == 0 else i % 3, "view", 20.0 + i % 11, f'{{"k": {i % 13}}}') for i in range(90)]
    rows.append((90, 50, "click", 52.199999999999996, '{"k": 5}'))
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")


def _same_as_sql(spark, folder, name):
    import duckdb

    from cellweave import core
    import cellweave.queries  # noqa: F401

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got, rel = core.QUERIES[name](spark, str(folder)), con.sql(core.SQL[name])
    order = got.columns
    assert sorted(order) == sorted(rel.columns)
    rows = [tuple(dict(zip(rel.columns, x))[c] for c in order) for x in rel.fetchall()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    return rows


def test_explain_area_keeps_cells_of_no_zone(spark, tmp_path):
    _odd_events(spark, tmp_path)
    assert None in {x[0] for x in _same_as_sql(spark, tmp_path, "explain_area")}


def test_expected_midday_rounds_as_its_sql(spark, tmp_path):
    _odd_events(spark, tmp_path)
    assert {x[0]: x[1] for x in _same_as_sql(spark, tmp_path, "expected_midday")}[50] == 13.1

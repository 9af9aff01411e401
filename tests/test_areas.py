"""Cost fields and routes over tiles, scans along tracks, camp anchors, matched null models and nested grids."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import cost as K
from cellweave.operators import zonal as Z
from cellweave.operators.scan import Tracks, smoothed
from cellweave.plans import anchors as A
from cellweave.plans import nested as N
from cellweave.plans import validate as V


def grid(spark, v, name="v"):
    rows = [(int(r), int(c), None if np.isnan(v[r, c]) else float(v[r, c])) for r, c in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, f"r int, c int, {name} double")


def dijkstra(cost, seeds):
    best = {s: 0.0 for s in seeds}
    todo = [(0.0, s) for s in seeds]
    while todo:
        d, (r, c) = heapq.heappop(todo)
        if d > best[r, c]:
            continue
        for a, b in [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]:
            n = (r + a, c + b)
            if 0 <= n[0] < cost.shape[0] and 0 <= n[1] < cost.shape[1] and not np.isnan(cost[n]):
                e = d + math.hypot(a, b) * (cost[r, c] + cost[n]) / 2
                if e < best.get(n, math.inf):
                    best[n] = e
                    heapq.heappush(todo, (e, n))
    return best


def walked(cost, path):
    return sum(math.dist(p, q) * (cost[p] + cost[q]) / 2 for p, q in zip(path, path[1:]))


@pytest.mark.parametrize("kind", ["uniform", "random", "comb"])
def test_routes_over_many_tiles(spark, kind):
    """On uniform ground the corridor is a quarter of the map; a route's tasks still hold one tile each."""
    rng = np.random.default_rng(4)
    cost = np.ones((22, 30)) if kind == "uniform" else rng.integers(1, 9, (22, 30)).astype(float)
    ends = [(7, 21, 29), (8, 21, 0), (9, 0, 0), (10, 10, 15)]
    if kind == "comb":
        for c in (5, 15):
            cost[(slice(1, None) if c == 5 else slice(None, -1)), c] = np.nan
        cost[11:14, 20:23] = np.nan
        cost[12, 21] = 1.0
        ends[3:] = [(10, 10, 16), (11, 12, 21)]  # walled in: no route
    want = dijkstra(cost, [(0, 0)])
    field = K.Field(grid(spark, cost), "v", (F.col("r") == 0) & (F.col("c") == 0), tile=8)
    got = {(x.r, x.c): x.dist for x in field.settled().collect()}
    assert {k: v for k, v in got.items() if v is not None} == want
    paths = {}
    for x in field.routes(spark.createDataFrame(ends, "route long, r int, c int")).collect():
        paths.setdefault(x.route, []).append((x.step, x.r, x.c))
    assert set(paths) == {e for e, r, c in ends if (r, c) in want}
    for e, r, c in ends:
        if e in paths:
            steps = sorted(paths[e])
            assert [s for s, _, _ in steps] == list(range(len(steps)))
            path = [p[1:] for p in steps]
            assert path[0] == (0, 0) and path[-1] == (r, c)
            assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in zip(path, path[1:]))
            assert walked(cost, path) == pytest.approx(want[r, c])
    field.close()


def test_rounds_write_what_fell(spark):
    """Along a corridor of tiles each round touches the next tile only."""
    field = K.Field(grid(spark, np.ones((4, 64))), "v", F.col("c") == 0, tile=8)
    written = [spark.read.parquet(f"{field.steps.folder}/fallen/round={k}").where("own").count() for k in range(field.rounds)]
    assert sum(written) == 4 * 64 and max(written) == 4 * 8
    none = K.Field(grid(spark, np.ones((4, 4))), "v", F.lit(False), tile=8)
    assert none.rounds == 0 and none.settled().where("dist is not null").count() == 0
    assert none.routes(spark.createDataFrame([(1, 0, 0)], "route long, r int, c int")).count() == 0
    empty = K.cost_field(grid(spark, np.ones((2, 2))).where("false"), "v", F.col("c") == 0, "d")
    assert empty.count() == 0


def fold(track):
    out = track[:1]
    for i in range(1, len(track)):
        out.append(out[-1] if i < len(track) - 1 and out[-1] == track[i + 1] and out[-1] != track[i] else track[i])
    return out


def test_tracks_of_any_length(spark):
    rng = random.Random(2)
    tracks = {u: [rng.randint(0, 1) for _ in range(n)] for u, n in ((1, 4000), (2, 1), (3, 2), (4, 37), (5, 3))}
    tracks[6] = [i % 2 for i in range(900)]  # flickers all the way, over several ranges
    rows = [(u, i, s) for u, t in tracks.items() for i, s in enumerate(t)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else so few rows are one range
    t = Tracks(spark.createDataFrame(rows, "u int, i int, s int"), ["u"], ["i"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    t = smoothed(t, "s", "on")
    assert t.rows.select("_p").distinct().count() > 4
    t.rows = t.rows.drop("_after")
    got = {}
    for x in t.beside(prev=("on", -1), after=("i", 1)).running(F.col("s"), "total").rows.collect():
        got.setdefault(x.u, {})[x.i] = x
    for u, track in tracks.items():
        want = fold(track)
        assert [got[u][i].on for i in range(len(track))] == want
        assert [got[u][i].prev for i in range(len(track))] == [None, *want[:-1]]
        assert [got[u][i].after for i in range(len(track))] == [*range(1, len(track)), None]
        assert [got[u][i].total for i in range(len(track))] == np.cumsum(track).tolist()
    t.close()


def test_first_rows_without_ranks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(float(a), int(b), i) for i, (a, b) in enumerate(zip(np.round(rng.normal(0, 1, 3000), 1), rng.integers(0, 4, 3000)))]
    rows += [(5.0, 1, 3000 + i) for i in range(500)] + [(1e9, 0, 4000), (-1e9, 0, 4001)]
    df = spark.createDataFrame(rows, "a double, b int, i int").select(F.struct("a", "b").alias("k"), "i", "a")
    for most in (1 << 16, 5):
        monkeypatch.setattr(Z, "IN_ORDER", most)
        for n in (0, 1, 2, 17, 1500, 3200, 3501, 3502, 9999):
            got = sorted(x.i for x in Z.first_n(df, ["k", "i"], n).collect())
            assert got == sorted(r[2] for r in sorted(rows)[:n]), (most, n)


def test_floods_overlap_and_camps(spark):
    rng = np.random.default_rng(7)
    areas = {1: {(5, 5), (5, 6), (9, 5)}, 2: {(6, 9), (7, 9)}, 3: {(0, 0)}}
    frame = spark.createDataFrame([(k, *p) for k, v in areas.items() for p in v] + [(1, 5, 5)], "rank int, r int, c int")
    got = {k: set() for k in areas}
    for x in A.flooded(frame, 3).collect():
        run = {(x.r, c) for c in range(x.c0, x.c1 + 1)}
        assert not run & got[x.rank]
        got[x.rank] |= run
    want = {k: {(r, c) for r in range(-4, 14) for c in range(-4, 14) if min(abs(r - a) + abs(c - b) for a, b in v) <= 3} for k, v in areas.items()}
    assert got == want
    score = np.round(rng.random((12, 12)), 1)
    score[:5, :5] = 0
    cells = grid(spark, score, "score")
    best = {x.rank: (x.r, x.c) for x in A.camps(frame, cells, "score", 3).collect()}
    inside = {k: [p for p in v if 0 <= p[0] < 12 and 0 <= p[1] < 12 and score[p] > 0] for k, v in want.items()}
    assert best == {k: min(v, key=lambda p: (-score[p], p)) for k, v in inside.items() if v} and 3 not in best
    stages = spark.createDataFrame([(2, 2), (11, 11)], "r int, c int")
    for style, legends in (("vehicle", {"parking"}), ("spike", {"parking", "base_camp"})):
        pins, starts = A.anchors(frame, cells, stages, style, 3, 12, 40.0)
        assert {x.legend for x in pins.collect()} == legends
        assert {x.rank: (x.r, x.c) for x in starts.collect()} == (best if style == "spike" else {1: (2, 2), 2: (11, 11), 3: (2, 2)})
        assert {x.is_camp for x in pins.where("legend = 'parking'").collect()} == {style == "vehicle"}
    pins, starts = A.anchors(frame, cells, stages, "fixed", 3, 12, 40.0, (4, 4))
    assert pins.count() == 0 and {tuple(x) for x in starts.collect()} == {(k, 4, 4) for k in areas}
    with pytest.raises(ValueError):
        A.anchors(frame, cells, stages, "fixed", 3, 12, 40.0)
    far = spark.createDataFrame([(9000.0,), (None,), (float("nan"),)], "d double")
    assert A.access_kind(far, "d").head().kind == "water" and A.access_kind(far.where("false"), "d").head().kind == "water"


def test_benchmark_of_a_good_and_a_scattered_choice(spark):
    """A blob on the only hill captures what there is; a draw at random captures nothing."""
    n = 40
    y, x = np.mgrid[:n, :n]
    hill = np.exp(-((y - 25) ** 2 + (x - 14) ** 2) / 60)
    df = grid(spark, hill).withColumn("road", F.col("c") * 40.0)
    df = df.withColumn("good", (F.col("r") - 25) ** 2 + (F.col("c") - 14) ** 2 <= 36).withColumn("poor", (F.col("r") * 13 + F.col("c") * 7) % 8 == 0)
    cells = V.pool(df, (n, n), 400.0, F.lit(True))
    assert cells.where("pool").count() == 30 * 30
    rand = [((F.col("r") * 7919 + F.col("c") * 104729) % 100003).alias("x")]
    good, poor = (V.benchmark(cells, "v", "road", p, rand, (n, n)).head() for p in ("good", "poor"))
    assert good.capture > 0.95 and good.beats_random and good.patches_selected == 1 and good.oracle <= good.ceiling
    assert abs(poor.capture) < 0.2 and not poor.beats_random and poor.beats_road
    flat = V.benchmark(V.pool(df.withColumn("v", F.lit(0.5)), (n, n), 400.0, F.lit(True)), "v", "road", "good", rand, (n, n)).head()
    assert flat.capture is None and flat.beats_random is None


def test_nested_grids(spark):
    rng = np.random.default_rng(8)
    v = rng.random((30, 30))
    cells = grid(spark, v)
    areas = spark.createDataFrame([(1, 10, 10), (2, 1, 29)], "area int, r int, c int")
    corners = {x.area: (x.r0, x.c0) for x in N.boxes(areas, 3, (30, 30)).collect()}
    assert corners == {1: (7, 7), 2: (0, 23)}
    fine, sides = N.nested(N.boxes(areas, 3, (30, 30)), 3, 3, 1)
    assert sides == (27, 27)
    rows = N.interpolated(fine, cells, "v").collect()
    assert len(rows) == 2 * 27 * 27
    for x in rows:
        r0, c0 = corners[x.area]
        fr, fc = r0 - 1 + (x.r + 0.5) / 3 - 0.5, c0 - 1 + (x.c + 0.5) / 3 - 0.5
        assert (x.pr, x.pc, x.inner) == (r0 - 1 + x.r // 3, c0 - 1 + x.c // 3, 3 <= x.r < 24 and 3 <= x.c < 24)
        w = {(math.floor(fr) + a, math.floor(fc) + b): abs(1 - a - (fr - math.floor(fr))) * abs(1 - b - (fc - math.floor(fc))) for a in (0, 1) for b in (0, 1)}
        w = {p: k for p, k in w.items() if 0 <= p[0] < 30 and 0 <= p[1] < 30 and k > 0}
        assert x.v is None if not w else x.v == pytest.approx(sum(k * v[p] for p, k in w.items()) / sum(w.values()))


def test_fine_grid_reads_a_neck_more_exactly(spark):
    """Land between two lakes, 5 fine cells wide: 3 x 3 fine cells a working cell see its width within a fine cell."""
    n, k, res = 13, 3, 60.0
    df = grid(spark, np.zeros((n, n)))
    areas = spark.createDataFrame([(1, 6, 6)], "area int, r int, c int")
    widths = {}
    for step in (1, k):
        fine, sides = N.nested(N.boxes(areas, 5, (n, n)), 5, step, 1)
        at = F.col("fc") * res  # metres from the centre of the first column
        water = (F.abs(at - 6 * res) > 50) & (F.abs(F.col("fr") * res - 6 * res) < 150)
        found = N.fine_necks(fine.withColumn("v", F.lit(0.0)), water, res, step, sides)
        widths[step] = N.folded(found).agg(F.min("width")).head()[0]
    assert widths[k] is not None and abs(widths[k] - 120) <= 20 + 1e-9
    assert df.count() == n * n


def test_store_replaces_the_areas_that_come(spark, tmp_path):
    store = N.AreaStore(spark, f"file://{tmp_path}/store")
    rows = lambda areas, v: spark.createDataFrame([(a, i, v) for a in areas for i in range(3)], "area int, i int, v string")
    store.put(rows([1, 2, 3], "first"), "p")
    store.put(rows([2], "second"), "p")
    store.put(rows([2], "other plan"), "q")
    assert sorted({(x.area, x.v) for x in store.get("p").collect()}) == [(1, "first"), (2, "second"), (3, "first")]
    assert {x.v for x in store.get("p", [2]).collect()} == {"second"} and store.get("p").count() == 9
    assert "PartitionFilters: [isnotnull(plan" in store.get("p", [2])._jdf.queryExecution().toString()
    again = N.rerun(grid(spark, np.ones((20, 20))), "v", spark.createDataFrame([(1, 9, 9), (2, 12, 12)], "area int, r int, c int"), 3, 3, 1, (20, 20), 40.0, F.col("v") < 0, only=[2])
    assert {x.area for x in again.select("area").distinct().collect()} == {2} and again.count() == 21 * 21


def test_fine_source_where_it_covers_enough(spark):
    rows = [(a, r, c, True, 10.0, (12.0 if a == 1 and r < 3 else 99.0 if a == 2 and (r, c) == (0, 0) else None)) for a in (1, 2) for r in range(6) for c in range(6)]
    fine = spark.createDataFrame(rows, "area int, r int, c int, inner boolean, v double, flown double")
    got = {(x.area, x.r, x.c): x.v for x in N.with_fine_source(fine, "v", "flown").collect()}
    assert {v for (a, _, _), v in got.items() if a == 1} == {12.0}  # the rest is moved by the difference
    assert {v for (a, _, _), v in got.items() if a == 2} == {10.0}  # 1 of 36 cells is not enough

"""Survey codes, fractions, networks, clips, routes and control tables on small fixtures; nulls, empty tables and ties among them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cellweave.functions import decode as D
from cellweave.functions import geo as G
from cellweave.functions import survey as S
from cellweave.operators import network as N
from cellweave.operators import vector as V
from cellweave.operators import zonal as Z
from cellweave.plans import clip as P
from cellweave.plans import control as K
from cellweave.plans import merge as M
from cellweave.plans import routes as R
from cellweave.sources import readers as B


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    "given, stand",
    [(("CT", "CP", "R", "7E", "5"), 4), (("BR", "CP", "R", None, None), 6), ((None, " cp ", "R", None, None), 5), ((None, None, "m", "7E", "5"), 2), ((None, None, None, "7T", "40"), 7),
     ((None, None, None, "7E", "20"), None), ((None, None, "", "1A", "5"), None), ((None,) * 5, None)],
)
def test_stand_class(spark, given, stand):
    assert one(spark, S.stand_class(*map(text, given)).alias("s")) == (stand,)


def test_cut_year_and_constants(spark):
    year = lambda s, a, b: S.stand_cut_year(F.lit(s).cast("int"), text(a), text(b))
    assert one(spark, year(4, "20041", "1").alias("a"), year(5, "x", "1999").alias("b"), year(4, "1900", None).alias("c"), year(1, "2004", "2004").alias("d"), year(None, "2004", None).alias("e")) == (2004, 1999, 0, 0, 0)
    got = one(spark, *[S.class_constant(F.lit(k), {"resineux": {"browse": -3.0}, "melange": {"browse": 7}}, "browse", S.STAND_BROWSE).alias(f"b{k}") for k in (1, 2, 3, 9)])
    assert got == (0.0, 1.0, 0.30, None)


def test_hours_and_winds(spark):
    state = lambda h, b, w: S.wind_state(F.lit(h), F.lit(b).cast("double"), F.lit(w).cast("double")).alias(f"x{h}{b}{w}".replace(".", "_"))
    assert one(spark, state(7.9, 10, 10), state(8.0, 350, 35), state(12.0, 350, 36), state(12.0, None, 10), state(12.0, 10, None), state(17.0, 10, None)) == (2, 1, -1, 0, 0, 0)
    assert one(spark, S.midday_class(F.lit(None).cast("double")).alias("a"), S.midday_class(F.lit(0.66)).alias("b"), S.midday_class(F.lit(0.65)).alias("c")) == (None, "retreat", "partial")


def grid(spark, value, side=4):
    return spark.createDataFrame([(r, c, value(r, c)) for r in range(side) for c in range(side)], "r int, c int, cls int")


def fractions(df, *a):
    return {(x.r, x.c, x.cls): x.fraction for x in Z.area_fractions(df, "cls", *a).collect()}


def test_fractions(spark):
    assert fractions(grid(spark, lambda r, c: 10 if c < 2 else 20), 4.0) == pytest.approx({(0, 0, 10): 0.5, (0, 0, 20): 0.5})
    few = fractions(grid(spark, lambda r, c: 10 if r == c == 1 else 20), 4.0)
    assert few[0, 0, 10] == pytest.approx(1 / 16)
    rng = random.Random(3)
    df = grid(spark, lambda r, c: rng.choice([10, 20, 30, 80]), 40)
    whole = fractions(df, 3.7, 0.4, -1.1)
    assert whole == pytest.approx(fractions(df.repartition(13, "c"), 3.7, 0.4, -1.1))
    for at in {k[:2] for k in whole}:
        assert sum(v for k, v in whole.items() if k[:2] == at) == pytest.approx(1)
    assert fractions(grid(spark, lambda r, c: 10 * r + c, 2), 0.5)[3, 0, 10] == pytest.approx(1)  # finer than the source
    assert fractions(df.where("false"), 2.0) == {}
    thin = Z.area_fractions(grid(spark, lambda r, c: 1, 1), "cls", 10.0)
    assert thin.count() == 0 and Z.area_fractions(grid(spark, lambda r, c: 1, 2), "cls", 10.0).count() == 1


def test_page_policies(spark):
    df = spark.createDataFrame([(1, 1, 5, 0.2), (1, 2, 0, 0.9), (1, 3, None, None), (2, 1, None, None)], "k int, seq int, stand int, closure double")
    assert {tuple(x) for x in Z.latest_values(df, ["k"], "seq", ["stand"], ["closure"]).collect()} == {(1, 5, 0.9), (2, 0, 0.0)}


def test_member_point_lies_inside(spark):
    ring = spark.createDataFrame([(r, c, 1) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)], "r int, c int, z int")
    assert [tuple(x) for x in Z.member_point(ring, "z").collect()] == [(1, 0, 2)]


def test_water_barrier(spark):
    df = grid(spark, lambda r, c: 0, 7).withColumn("n", F.lit(None).cast("boolean"))
    wet = lambda res: {(x.r, x.c) for x in N.water_barrier(df, F.col("n"), (F.col("r") == 3) & (F.col("c") == 3), F.col("n"), res).where("barrier").collect()}
    assert len(wet(40.0)) == 5 and len(wet(10.0)) == 9 and len(wet(5.0)) == 29
    assert N.water_barrier(df, F.col("n"), F.col("n"), F.col("n"), 10.0).where("barrier").count() == 0


def test_fine_step(spark):
    step = lambda res, h, w: N.fine_step(F.lit(res), F.lit(h), F.lit(w)).alias(f"s{h}")
    assert one(spark, step(40.0, 100, 100), step(40.0, 1000, 1001), step(40.0, 4000, 4000), step(3.0, 10, 10)) == (7, 1, 1, 1)


def test_networks(spark):
    pt = lambda x, y: (float(x), float(y))
    lines = spark.createDataFrame([(1, "official_trail", [pt(0.5, 9.5), pt(3.5, 9.5)]), (2, "trail", [pt(2.5, 9.5), pt(5.5, 9.5)]), (3, None, [pt(0.5, 0.5), pt(1.5, 0.5)])], "id int, source string, ring array<struct<x: double, y: double>>")
    got = {(x.r, x.c): x.motor for x in N.linear_layers(lines, 0.0, 10.0, 1.0, 10, 10).collect()}
    assert got == {(0, 0): True, (0, 1): True, (0, 2): True, (0, 3): True, (0, 4): False, (0, 5): False, (9, 0): False, (9, 1): False}
    kit = spark.createDataFrame([("a", True, True, None), ("b", False, None, True), ("c", None, True, True)], "party string, atv boolean, boat boolean, engine boolean")
    cells = spark.createDataFrame([(0, 0, True, None), (0, 1, False, True)], "r int, c int, road boolean, lake boolean")
    none = F.lit(None).cast("boolean")
    net = {tuple(x) for x in N.vehicle_networks(cells, kit, F.col("road"), none, none, F.col("lake")).collect()}
    assert net == {("a", "atv", 0, 0), ("a", "canoe", 0, 1), ("c", "motor", 0, 1)}


def test_manual_areas_and_parts(spark):
    df = grid(spark, lambda r, c: 4, 10).withColumn("v", F.when(F.col("c") > 0, F.col("r").cast("double")))
    box = lambda a, b, n: [(a, b), (a + n, b), (a + n, b + n), (a, b + n), (a, b)]
    rings = spark.createDataFrame([(1, box(0.0, 360.0, 80.0)), (2, box(0.0, 0.0, 40.0)), (3, box(0.0, 0.0, 9.0)[:2]), (4, box(5000.0, 0.0, 9.0))], "id int, ring array<struct<x: double, y: double>>")
    assert [tuple(x) for x in V.manual_areas(df, rings, "v", 0.0, 400.0, 40.0, 10, 10).collect()] == [(1, 1, 0.0, 0.0)]
    shapes = spark.createDataFrame([(1, [[[1, 2], [3]], [], [[4]]]), (2, None), (3, [])], "id int, g array<array<array<int>>>")
    assert [tuple(x) for x in V.exterior_rings(shapes, "g").collect()] == [(1, 0, [1, 2]), (1, 2, [4])]


def test_clip(spark):
    areas = spark.createDataFrame([(1, 1, 0.5, "A"), (1, 2, 0.09, "B"), (1, 3, None, "C"), (1, 4, 0.10, "A"), (2, 1, 0.0, "Z")], "plan int, rank int, share double, camp string")
    kept = P.clip_areas(areas)
    assert sorted((x.rank, x.camp) for x in kept.collect()) == [(1, "A"), (2, "C"), (3, "A")]
    camps = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (2, "Z"), (3, "Q")], "plan int, camp string")
    assert sorted(tuple(x) for x in P.clip_camps(camps, kept).select("plan", "camp").collect()) == [(1, "A"), (1, "C"), (2, "Z"), (3, "Q")]
    points = spark.createDataFrame([(1, True, False), (2, False, False), (3, False, True), (4, None, None)], "id int, i boolean, p boolean")
    assert {x.id for x in P.clip_points(points, F.col("i"), F.col("p")).collect()} == {1, 3, 4}


def test_routes(spark):
    areas = "area int, camp_r int, camp_c int, stage_r int, stage_c int, d_road double"
    sites = spark.createDataFrame([(1, "rut_calling", i, i, 0) for i in range(5)] + [(1, "thermal_refuge", 1, 9, 9), (1, "glassing", 1, 8, 8), (2, "thermal_refuge", 1, 1, 1)], "area int, legend string, seq int, r int, c int")
    got = lambda d: sorted(tuple(x) for x in R.plan_routes(spark.createDataFrame([(1, 0, 0, 5, 5, d), (2, 1, 1, 1, 1, None)], areas), sites).collect())
    assert got(10.0) == [(1, "route_access", 1, 0, 0), (1, "route_best", 2, 1, 0), (1, "route_midday_hot", 1, 9, 9)]
    assert got(5000.0)[-1] == (1, "route_paddle", 1, 0, 0) and got(None)[-1] == (1, "route_paddle", 1, 0, 0)
    legs = spark.createDataFrame([(1, 1, "atv", 3.0, "x"), (1, 2, "foot_bush", 1.0, "y"), (2, 1, "foot", 1.0, "a"), (2, 2, "canoe", 2.0, "b"), (2, 3, "foot_trail", 0.5, "c"), (2, 4, "foot_trail", 0.25, "d"), (3, 1, "foot", 2.0, "e")], "route int, seq int, mode string, km double, end string")
    out = {x.route: x for x in R.route_properties(legs).collect()}
    assert (out[1].walk_km, out[1].carry_km, out[1].ride_mode, out[1].vehicle_left_at) == (1.0, 7.0, "atv", "x")
    assert out[2].km_by_mode == {"canoe": 2.0, "foot_trail": 0.25, "portage": 1.5} and out[2].carry_km == pytest.approx(8 * 1.5 + 7 * 0.25, abs=0.06) and out[2].vehicle_left_at == "b"
    assert out[3].ride_mode is None and out[3].ride_km == 0.0
    seats = R.seats(sites, F.lit(1)).select("area", "role", "n", "seat").collect()
    assert sorted(map(tuple, seats)) == [(1, "caller", 1, 1), (1, "caller", 2, 2)]


def test_control(spark):
    a = spark.createDataFrame([(1, "p", "x", 60, 1), (1, "q", "x", 50, 2), (1, "q", "y", 10, 3), (1, "r", "x", 40, 4)], "store int, plan string, name string, bytes long, used int")
    asked = spark.createDataFrame([(1, "p", "x"), (1, "q", "y"), (1, "r", "x"), (1, "r", "y"), (2, "p", "x")], "store int, plan string, name string")
    state = lambda b: [x.state for x in K.artefact_state(asked, a, b).orderBy("store", "plan", "name").collect()]
    assert state(100) == ["evicted", "present", "present", "absent", "absent"]
    assert state(39) == ["evicted", "evicted", "evicted", "absent", "absent"] and state(160)[0] == "present"
    requests = spark.createDataFrame([("h", "u", False), ("h", None, True), ("i", "u", True), ("j", "u", None)], "host string, user string, draining boolean")
    running = spark.createDataFrame([("h", "running"), ("h", "running"), ("j", "running"), ("j", "done")], "host string, state string")
    assert [(x.answer, x.retry_s) for x in K.admitted(requests, running).orderBy("host", "user").collect()] == [(401, None), (503, 180), (503, 120), (202, None)]
    revisions = spark.createDataFrame([(1, "a"), (3, "c"), (2, "b")], "rev int, note string")
    plans = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "id int, rev int")
    assert [x.notes for x in K.changes_since(plans, revisions).orderBy("id").collect()] == [["c", "b"], [], []]
    assert [x.notes for x in K.changes_since(plans, revisions.where("false")).collect()] == [[], [], []]
    counts = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None)], "area int, kind string")
    assert [tuple(x) for x in K.counts_by_key(counts, ["area"], "kind").collect()] == [(1, {"a": 1, "b": 2})]


def test_requests_and_merge(spark):
    sites = lambda rows: F.array(*[F.array(*[text(v) for v in p]) for p in rows]) if rows else F.lit(None).cast("array<array<string>>")
    of = lambda rows: one(spark, D.sites_of(sites(rows), F.lit(1.0), F.lit(2.0)).alias("s"))[0]
    assert [tuple(p) for p in of([("5", "6"), ("x", "6"), ("95", "0"), ("7",), ("8", "9")])] == [(5.0, 6.0)]
    assert [tuple(p) for p in of([])] == [(1.0, 2.0)] == [tuple(p) for p in of([(None, "2")])]
    w = one(spark, D.windows_of(sites([("a", "b"), ("", "b"), ("c",)]), F.lit("s"), F.lit("e")).alias("w"))[0]
    assert [tuple(p) for p in w] == [("a", "b")]
    plans = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True)], "site int, win int, ok boolean")
    items = spark.createDataFrame([(1, 1, "areas", 0, "no"), (2, 1, "areas", 0, "c"), (1, 2, "areas", 0, "a"), (1, 2, "areas", 1, "b"), (2, 1, "legend", 0, "no")], "site int, win int, key string, pos int, json string")
    assert [(x.pos, x.json) for x in M.merge_lists(items, plans).orderBy("pos").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert tuple(M.scaffolding(plans).head()) == (1, 2)


def test_sphere(spark):
    ring = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    a, b = one(spark, G.ring_km2(ring([(0, 0), (1, 0), (1, 1), (0, 1)])).alias("a"), G.ring_km2(ring([(0, 0), (1, 0)])).alias("b"))
    assert a == pytest.approx(12364, rel=0.001) and b == 0.0
    spots = one(spark, G.scent_points(F.lit(48.0), F.lit(-78.0), F.lit(None).cast("double")).alias("p"))[0]
    assert [p.role for p in spots] == ["shooter", "wick", "right", "left"] and spots[0].lon > spots[1].lon > -78.0 and spots[2].lat < 48.0 < spots[3].lat


def pages(page, size):
    return [{"id": page * size + i} for i in range(size if page < 5 else 3 if page == 5 else 0)]


def nowhere(page, size):
    raise B.NoCoverage


def endless(page, size):
    time.sleep(0.05)
    return [{"id": 1}] * size


def test_pages_end_by_themselves(spark):
    got = [x.id for x in B.read_pages(spark, "id long", f"{__name__}.pages", page_size=10, lanes=3).collect()]
    assert sorted(got) == list(range(53))
    assert B.read_pages(spark, "id long", f"{__name__}.nowhere").count() == 0
    with pytest.raises(Exception, match="budget"):
        B.read_pages(spark, "id long", f"{__name__}.endless", page_size=5, lanes=1, budget_s=0.2).count()


def test_global_rank(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, 1.0, 2.0, 3.5]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "v double, i int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = Z.global_rank(df, [F.desc("v"), "i"], "n")
        got = {x.i: x.n for x in ranked.collect()}
        assert ranked.rdd.getNumPartitions() > 1
        sums = {x.i: x.s for x in Z.running_sum(df, "v", ["i"], "s").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert got == {i: n for n, (_, i) in enumerate(want, 1)}
    total = 0.0
    for v, i in data:
        total += v or 0.0
        assert sums[i] == total
    assert Z.global_rank(df.where("false"), ["v", "i"], "n").count() == 0

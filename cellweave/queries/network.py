"""Fractions at any ratio, water barriers, vehicle networks, drawn areas and rings."""

from pyspark.sql import functions as F

from cellweave.core import query, table
from cellweave.functions import algebra as A
from cellweave.functions.geo import ring_area
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.operators import focal as O
from cellweave.operators import network as N
from cellweave.operators import vector as V
from cellweave.operators import zonal as Z
from cellweave.plans import clip as P
from cellweave.queries.chains import _LN
from cellweave.queries.focal import box_sql
from cellweave.queries.layers import LAYERS_SQL, cl, layers

C, L = f"WITH {CELLS_SQL}", f"WITH {LAYERS_SQL}"


def _span(x, start):
    return f"unnest(generate_series(CAST(floor(({x} - {start}::DOUBLE) / 2.5::DOUBLE) AS BIGINT), CAST(ceil(({x} + 1 - {start}::DOUBLE) / 2.5::DOUBLE) AS BIGINT) - 1))"


def _part(x, t, start):
    return f"(least({x} + 1, {start}::DOUBLE + ({t} + 1) * 2.5::DOUBLE) - greatest({x}, {start}::DOUBLE + {t} * 2.5::DOUBLE))"


@query(f"""{C}, a AS (SELECT r, c, cls, {_span('r', '0.3')} AS tr FROM cells), b AS (SELECT *, {_span('c', '0.7')} AS tc FROM a), s AS (SELECT tr, tc, cls, sum({_part('r', 'tr', '0.3')} * {_part('c', 'tc', '0.7')}) / 6.25::DOUBLE AS part FROM b GROUP BY 1, 2, 3), k AS (SELECT *, sum(part) OVER (PARTITION BY tr, tc) AS covered FROM s)
SELECT CAST(tr AS INTEGER) AS r, CAST(tc AS INTEGER) AS c, cls, round(part / covered, 9) AS fraction, round(covered, 9) AS covered FROM k WHERE covered > 0.01""")
def area_fractions(spark, sf_dir):
    """Class fractions on a grid of 2.5 source cells that begins between them."""
    f = Z.area_fractions(demo_cells(spark, sf_dir)[0], "cls", 2.5, 0.3, 0.7)
    return f.select("r", "c", "cls", F.round("fraction", 9).alias("fraction"), F.round("covered", 9).alias("covered"))


@query(f"""{C}, p AS (SELECT r, c, (k % 10) / 10.0::DOUBLE AS t, (k * 7 % 10) / 10.0::DOUBLE * (1 - (k % 10) / 10.0::DOUBLE) AS o FROM cells), t AS (SELECT r, c, t AS v FROM p), o AS (SELECT r, c, o AS v FROM p), {box_sql('t', 'mt', 2, 2)}, {box_sql('o', 'mo', 2, 2)}
SELECT p.r, p.c, round({cl('greatest(4 * mt.v * mo.v, 0.85 * 4 * p.t * p.o)')}, 9) AS edge FROM p JOIN mt USING (r, c) JOIN mo USING (r, c)""")
def edge_mixture(spark, sf_dir):
    """Interspersion from the neighbourhood or from inside the cell, whichever shows more."""
    df, side = demo_cells(spark, sf_dir)
    t = (F.col("k") % 10) / 10.0
    df = df.select("r", "c", t.alias("t"), (F.col("k") * 7 % 10 / 10.0 * (1 - t)).alias("o"))
    df = O.box_mean(O.box_mean(df, "t", "mt", (side, side), 5), "o", "mo", (side, side), 5)
    return df.select("r", "c", F.round(A.edge_of(4 * F.col("mt") * F.col("mo"), 4 * F.col("t") * F.col("o")), 9).alias("edge"))


@query(f"""{L}, b AS (SELECT *, zone % 7 = 0 AS closed FROM l) SELECT cls, count(*) AS cells, round(100.0 * count(*) FILTER (WHERE closed) / count(*), 1) AS blocked_pct, coalesce(string_agg(DISTINCT CAST(zone AS VARCHAR), ',' ORDER BY CAST(zone AS VARCHAR)) FILTER (WHERE closed), '') AS names FROM b GROUP BY 1""")
def legal_audit(spark, sf_dir):
    """How much of each cover is closed, and by whom."""
    b = layers(spark, sf_dir)[0].withColumn("closed", F.col("zone") % 7 == 0)
    name = F.when(F.col("closed"), F.col("zone").cast("string"))
    return b.groupBy("cls").agg(F.count(F.lit(1)).alias("cells"), F.round(100.0 * F.count(name) / F.count(F.lit(1)), 1).alias("blocked_pct"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names"))


@query("""WITH e AS (SELECT l_partkey AS cell, ((l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS seq, CAST(l_quantity AS INTEGER) % 8 AS stand, CAST(l_quantity AS INTEGER) * 3 % 5 AS height, l_suppkey % 4 AS age, l_discount AS closure, CASE WHEN l_linenumber % 3 = 0 THEN year(l_shipdate) END AS cut_year FROM lineitem)
SELECT cell, coalesce(arg_max(stand, seq) FILTER (WHERE stand > 0), 0) AS stand, coalesce(arg_max(height, seq) FILTER (WHERE height > 0), 0) AS height, coalesce(arg_max(age, seq) FILTER (WHERE age > 0), 0) AS age, greatest(coalesce(max(closure), 0), 0) AS closure, CAST(greatest(coalesce(max(cut_year), 0), 0) AS INTEGER) AS cut_year FROM e GROUP BY 1""")
def page_policies(spark, sf_dir):
    """Overlapping pages merged: the latest value or the largest, by attribute."""
    q = F.col("l_quantity").cast("int")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cell"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")) * 100 + q).alias("seq"), (q % 8).alias("stand"), (q * 3 % 5).alias("height"), (F.col("l_suppkey") % 4).alias("age"), F.col("l_discount").alias("closure"), F.when(F.col("l_linenumber") % 3 == 0, F.year("l_shipdate")).alias("cut_year"))
    return Z.latest_values(e, ["cell"], "seq", ["stand", "height", "age"], ["closure", "cut_year"])


@query(f"""{C}, m AS (SELECT zone, avg(r) AS mr, avg(c) AS mc FROM cells GROUP BY 1), d AS (SELECT cells.zone, r, c, round((r - mr) * (r - mr) + (c - mc) * (c - mc), 9) AS d FROM cells JOIN m USING (zone)), n AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY d, r, c) AS n FROM d) SELECT zone, r, c FROM n WHERE n = 1""")
def member_points(spark, sf_dir):
    """One cell that stands for each zone and lies in it."""
    return Z.member_point(demo_cells(spark, sf_dir)[0], "zone")


@query(f"""{C}, b AS (SELECT r, c, cls = 80 AS water, k % 17 = 0 AS river, k % 23 = 0 AS lake FROM cells), n AS (SELECT DISTINCT r + a AS r, c + d AS c FROM b, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(d) WHERE river)
SELECT b.r, b.c, water OR lake OR n.r IS NOT NULL AS barrier FROM b LEFT JOIN n ON n.r = b.r AND n.c = b.c""")
def water_barrier(spark, sf_dir):
    """Open water, lakes and rivers 15 m to a side on a grid of 10 m."""
    df = demo_cells(spark, sf_dir)[0]
    return N.water_barrier(df, F.col("cls") == 80, F.col("k") % 17 == 0, F.col("k") % 23 == 0, 10.0).select("r", "c", "barrier")


@query("""WITH g AS (SELECT c_custkey, (5 + c_custkey % 96)::DOUBLE AS res, 100 + c_custkey * 7 % 2900 AS h, 100 + c_custkey * 11 % 2900 AS w FROM customer), m AS (SELECT *, CAST(least(floor(sqrt(9000000.0::DOUBLE / (CAST(h AS DOUBLE) * w))), floor(res / 5)) AS INTEGER) AS m FROM g), s AS (SELECT *, greatest(1, CASE WHEN m % 2 = 0 THEN m - 1 ELSE m END) AS step FROM m)
SELECT c_custkey, step, round(res / step, 9) AS fine_res FROM s""")
def fine_steps(spark, sf_dir):
    """How fine a grid necks are measured on."""
    k = F.col("c_custkey")
    res = (5 + k % 96).cast("double")
    step = N.fine_step(res, 100 + k * 7 % 2900, 100 + k * 11 % 2900)
    return table(spark, sf_dir, "customer").select("c_custkey", step.alias("step"), F.round(res / step, 9).alias("fine_res"))


_SOURCES = ["official_trail", "trail", "official_rail", "rail"]
_TOUCH = f"""{_LN}, k AS (SELECT *, CAST(unnest(generate_series(CAST(floor(u1) AS BIGINT), CAST(floor(u2) AS BIGINT))) AS INTEGER) AS c FROM s), y AS (SELECT id, c, v1 + (greatest(u1, c) - u1) * (v2 - v1) / (u2 - u1) AS a, v1 + (least(u2, c + 1) - u1) * (v2 - v1) / (u2 - u1) AS b FROM k),
f AS (SELECT id, c, CAST(unnest(generate_series(CAST(floor(least(a, b)) AS BIGINT), CAST(floor(greatest(a, b)) AS BIGINT))) AS INTEGER) AS r FROM y), lin AS (SELECT r, c, bool_or(id % 4 IN (0, 2)) AS motor, TRUE AS foot FROM f WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 99 GROUP BY 1, 2)"""


def _lines(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = k * 37 % 1000 / 10.0, k * 61 % 1000 / 10.0
    source = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (k % 4).cast("int") + 1)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), source.alias("source"), F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 9.3).alias("x"), (y + 7.1).alias("y"))).alias("ring"))


@query(f"WITH {_TOUCH} SELECT r, c, motor, foot FROM lin")
def linear_layers(spark, sf_dir):
    """Cells of trails and rails: what feet can use, and what a machine can."""
    return N.linear_layers(_lines(spark, sf_dir), 0.0, 100.0, 1.0, 100, 100)


@query(f"""WITH {CELLS_SQL}, {_TOUCH}, b AS (SELECT cells.r, cells.c, k % 19 = 0 OR coalesce(motor, FALSE) AS land, cls = 80 OR k % 23 = 0 AS wet FROM cells LEFT JOIN lin ON lin.r = cells.r AND lin.c = cells.c),
kit AS (SELECT n_nationkey AS party, 'atv' AS mode, TRUE AS land FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'motor' ELSE 'canoe' END, FALSE FROM nation WHERE n_nationkey % 4 < 2)
SELECT party, mode, count(*) AS cells, CAST(sum(r) AS BIGINT) AS rows_sum, CAST(sum(c) AS BIGINT) AS cols_sum FROM kit q JOIN b ON CASE WHEN q.land THEN b.land ELSE b.wet END GROUP BY 1, 2""")
def vehicle_networks(spark, sf_dir):
    """Ground that each party's vehicles can use."""
    df = demo_cells(spark, sf_dir)[0].join(N.linear_layers(_lines(spark, sf_dir), 0.0, 100.0, 1.0, 100, 100), ["r", "c"], "left")
    n = F.col("n_nationkey")
    kit = table(spark, sf_dir, "nation").select(n.alias("party"), (n % 3 == 0).alias("atv"), (n % 4 < 2).alias("boat"), (n % 2 == 0).alias("engine"))
    net = N.vehicle_networks(df, kit, F.col("k") % 19 == 0, F.col("motor"), F.col("cls") == 80, F.col("k") % 23 == 0)
    return net.groupBy("party", "mode").agg(F.count(F.lit(1)).alias("cells"), F.sum("r").alias("rows_sum"), F.sum("c").alias("cols_sum"))


@query(f"""{C}, a AS (SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 10.0::DOUBLE + 0.13 AS x, s_suppkey * 61 % 1000 / 10.0::DOUBLE + 0.17 AS y FROM supplier),
i AS (SELECT id, r, c, elev FROM a JOIN cells ON c + 0.5 BETWEEN x AND x + 7.2 AND 100 - (r + 0.5) BETWEEN y AND y + 5.1 WHERE k % 9 > 0) SELECT id, count(*) AS cells, round(count(*) * 0.0016::DOUBLE, 1) AS km2, round(avg(elev), 6) AS score FROM i GROUP BY 1""")
def manual_areas(spark, sf_dir):
    """Drawn areas in place of found ones."""
    df, side = demo_cells(spark, sf_dir)
    k = F.col("s_suppkey")
    x, y = k * 37 % 1000 / 10.0 + 0.13, k * 61 % 1000 / 10.0 + 0.17
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    scaled = lambda v: v * 40.0
    corners = [(x, y), (x + 7.2, y), (x + 7.2, y + 5.1), (x, y + 5.1), (x, y)]
    rings = table(spark, sf_dir, "supplier").select(k.alias("id"), F.array(*[p(scaled(a), scaled(b)) for a, b in corners]).alias("ring"))
    found = V.manual_areas(df.withColumn("v", F.when(F.col("k") % 9 > 0, F.col("elev"))), rings, "v", 0.0, 4000.0, 40.0, side, side)
    return found.select("id", "cells", "km2", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_partkey % 50 AS b FROM lineitem WHERE l_linenumber % 5 > 0), o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, a, b) - 1 AS i, a, b FROM p)
SELECT l_orderkey, CAST(i AS INTEGER) AS part, 4 AS points, round(a * b / 2, 6) AS area FROM o""")
def outer_rings(spark, sf_dir):
    """Parts of areas of several parts, holes left out."""
    pt = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    o, a, b = F.lit(0), F.col("l_quantity"), F.col("l_partkey") % 50
    shape = F.array(F.array(pt(o, o), pt(a, o), pt(o, b), pt(o, o)), F.array(pt(o, o), pt(a / 9, o), pt(o, b / 9), pt(o, o)))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber % 5 > 0").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", b.alias("b"), shape.alias("p")))).alias("g"))
    parts = V.exterior_rings(lines.select("l_orderkey", F.transform("g", lambda x: x["p"]).alias("g")), "g")
    return parts.select("l_orderkey", "part", F.size("ring").alias("points"), F.round(ring_area(F.col("ring")), 6).alias("area"))


@query(f"""{C}, s AS (SELECT zone, zone % 7 AS plan, zone % 3 AS camp, CASE WHEN zone % 10 > 0 THEN avg(CASE WHEN r < w // 7 THEN 1.0 ELSE 0.0 END) END AS share FROM cells, g GROUP BY 1, 2, 3), a AS (SELECT plan, zone, camp, CAST(row_number() OVER (PARTITION BY plan ORDER BY zone) AS INTEGER) AS rank FROM s WHERE coalesce(share >= 0.10, TRUE)),
m AS (SELECT DISTINCT plan, camp + (plan % 2) * 2 AS camp FROM s), v AS (SELECT m.*, EXISTS (SELECT 1 FROM a WHERE a.plan = m.plan AND a.camp = m.camp) AS live FROM m), n AS (SELECT *, bool_or(live) OVER (PARTITION BY plan) AS anylive FROM v)
SELECT 'area' AS kind, plan, zone AS id, rank FROM a UNION ALL SELECT 'camp', plan, camp, NULL FROM n WHERE live OR NOT anylive UNION ALL SELECT 'point', zone % 7, CAST(r AS BIGINT) * w + c, NULL FROM cells, g WHERE r < w // 7 OR cls = 30""")
def ring_clip(spark, sf_dir):
    """Areas, camps and points that stay inside a drawn ring."""
    df, side = demo_cells(spark, sf_dir)
    df = df.withColumn("inside", F.col("r") < side // 7).withColumn("plan", F.col("zone") % 7)
    s = V.overlap_share(df, "zone", "inside").select("zone", (F.col("zone") % 7).alias("plan"), (F.col("zone") % 3).alias("camp"), F.col("zone").alias("rank"), F.when(F.col("zone") % 10 > 0, F.col("share")).alias("share"))
    areas = P.clip_areas(s)
    camps = P.clip_camps(s.select("plan", (F.col("camp") + F.col("plan") % 2 * 2).alias("camp")).distinct(), areas)
    points = P.clip_points(df, F.col("inside"), F.col("cls") == 30)
    none = F.lit(None).cast("int")
    out = areas.select(F.lit("area").alias("kind"), "plan", F.col("zone").alias("id"), "rank").unionByName(camps.select(F.lit("camp").alias("kind"), "plan", F.col("camp").alias("id"), none.alias("rank")))
    return out.unionByName(points.select(F.lit("point").alias("kind"), "plan", (F.col("r").cast("long") * side + F.col("c")).alias("id"), none.alias("rank")))

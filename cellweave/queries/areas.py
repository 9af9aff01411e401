"""Camp anchors, matched null models and nested grids over areas."""

import uuid

from pyspark.sql import functions as F

from cellweave.core import query, shared_dir
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.plans import anchors as A
from cellweave.plans import nested as N
from cellweave.plans import validate as V
from cellweave.queries.layers import LAYERS_SQL, cl, layers
from cellweave.queries.shapes import components_sql

_REACH, _FIXED = 6, (3, 4)

#: Areas of the demonstration grid: what is passable in blocks of 24 cells.
_RANK = "CAST((r // 24) * 1000 + c // 24 AS BIGINT)"


def block_areas(df):
    return df.where("k % 11 >= 4").select(F.expr("cast((r div 24) * 1000 + c div 24 as bigint)").alias("rank"), "r", "c")


@query(f"""WITH {LAYERS_SQL}, a AS (SELECT {_RANK} AS rank, r, c FROM l WHERE k % 11 >= 4),
o AS (SELECT i.i AS dr, j.i AS dc FROM range(-{_REACH}, {_REACH + 1}) i(i), range(-{_REACH}, {_REACH + 1}) j(i) WHERE abs(i.i) + abs(j.i) <= {_REACH}),
f AS (SELECT DISTINCT rank, a.r + dr AS r, a.c + dc AS c FROM a, o),
kind AS (SELECT CASE WHEN min(d_road) < 5000 THEN 'road' ELSE 'water' END AS kind FROM l),
s AS (SELECT r, c, round((CASE WHEN kind = 'road' THEN least(1.0, greatest(0.0, d_road / 400)) * exp(-greatest(0.0, d_road - 400) / 900) ELSE exp(-d_water / 500) END) * exp(-d_water / 500) * browse, 12) AS score FROM l, kind),
camp AS (SELECT rank, arg_max({{'r': r, 'c': c}}, {{'s': score, 'r': -r, 'c': -c}}) AS spot FROM f JOIN s USING (r, c) WHERE score > 0 GROUP BY rank),
m AS (SELECT rank, avg(r) AS mr, avg(c) AS mc FROM a GROUP BY 1), mp AS (SELECT a.rank, arg_min({{'r': r, 'c': c}}, {{'d': round(power(r - mr, 2) + power(c - mc, 2), 9), 'r': r, 'c': c}}) AS spot FROM a JOIN m USING (rank) GROUP BY 1),
st AS (SELECT r, c FROM l WHERE k < 3), pk AS (SELECT rank, arg_min({{'r': r, 'c': c}}, {{'d': power(r - mp.spot.r, 2) + power(c - mp.spot.c, 2), 'r': r, 'c': c}}) AS spot, min(sqrt(power(r - mp.spot.r, 2) + power(c - mp.spot.c, 2))) AS walk FROM mp, st GROUP BY rank),
pins AS (SELECT style, rank, 'parking' AS legend, spot.r AS r, spot.c AS c, style = 'vehicle' AS is_camp, round(walk * 40 / 1000, 2) AS walk_km FROM pk, (VALUES ('vehicle'), ('spike')) v(style)
  UNION ALL SELECT 'spike', rank, 'base_camp', spot.r, spot.c, TRUE, NULL FROM camp
  UNION ALL SELECT 'fixed', rank, 'start', {_FIXED[0]}, {_FIXED[1]}, NULL, NULL FROM (SELECT DISTINCT rank FROM a) UNION ALL SELECT 'vehicle', rank, 'start', spot.r, spot.c, NULL, NULL FROM pk UNION ALL SELECT 'spike', rank, 'start', spot.r, spot.c, NULL, NULL FROM camp)
SELECT style, rank, legend, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, is_camp, CAST(walk_km AS DOUBLE) AS walk_km FROM pins""")
def camp_anchors(spark, sf_dir):
    """For each area and style of hunt the camp and parking pins and the cell where its routes begin."""
    df, side = layers(spark, sf_dir)
    areas, stages = block_areas(df), df.where("k < 3").select("r", "c")
    kind = A.access_kind(df, "d_road")
    score = F.round(A.camp_score(F.col("kind"), F.col("d_road"), F.col("d_water"), F.col("browse")), 12)
    cells = df.crossJoin(F.broadcast(kind)).select("r", "c", score.alias("score"))  # one row
    out = None
    for style in A.STYLES:
        pins, starts = A.anchors(areas, cells, stages, style, _REACH, side, 40.0, _FIXED if style == "fixed" else None)
        starts = starts.select("rank", F.lit("start").alias("legend"), "r", "c", F.lit(None).cast("boolean").alias("is_camp"), F.lit(None).cast("double").alias("walk_km"))
        both = pins.unionByName(starts).withColumn("style", F.lit(style))
        out = both if out is None else out.unionByName(both)
    return out.select("style", "rank", "legend", "r", "c", "is_camp", "walk_km")


_PICKED = "(r // 8 + c // 8) % 7 = 0"
_RANDOM = "((r * 7919 + c * 104729 + 20260807) % 1000003)"


@query(f"""WITH RECURSIVE {LAYERS_SQL}, p AS MATERIALIZED (SELECT r, c, browse AS v, d_water AS road, {_PICKED} AS picked, {_RANDOM} AS rand, r BETWEEN 5 AND w - 6 AND c BETWEEN 5 AND w - 6 AND cls <> 80 AS pool FROM l, g),
gr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY road, r, c) AS i_road, row_number() OVER (ORDER BY v DESC, r, c) AS i_best, row_number() OVER (ORDER BY rand, r, c) AS i_rand, row_number() OVER (ORDER BY v, r, c) AS i_v, row_number() OVER (ORDER BY -road, r, c) AS i_near FROM p WHERE pool),
n AS (SELECT count(*) FILTER (WHERE picked) AS n FROM gr), sg AS (SELECT greatest(2.0::DOUBLE, sqrt(n / pi()) / 2) AS s FROM n), kr AS (SELECT CAST(floor(4 * s + 0.5) AS INTEGER) AS k, s FROM sg),
kw AS (SELECT i, exp(-0.5::DOUBLE * power(i / s, 2)) AS e FROM kr, range(-200, 201) t(i) WHERE abs(i) <= k), kn AS (SELECT i, e / (SELECT sum(e) FROM kw) AS wt FROM kw),
tap AS MATERIALIZED (SELECT x, i, wt, CASE WHEN y < 0 THEN -1 - y WHEN y >= w THEN 2 * w - 1 - y ELSE y END AS src FROM (SELECT x, i, wt, w, (((x + i) % (2 * w)) + 2 * w) % (2 * w) AS y FROM kn, g, range(0, 100000) t(x) WHERE x < w)),
b0 AS MATERIALIZED (SELECT r, c, CASE WHEN pool THEN v ELSE 0.0 END AS v FROM p),
b1 AS MATERIALIZED (SELECT b0.r, tap.x AS c, sum(wt * v) AS v FROM b0 JOIN tap ON tap.src = b0.c GROUP BY 1, 2), b2 AS MATERIALIZED (SELECT tap.x AS r, b1.c, sum(wt * v) AS v FROM b1 JOIN tap ON tap.src = b1.r GROUP BY 1, 2),
top AS (SELECT arg_max({{'r': gr.r, 'c': gr.c}}, {{'s': round(b2.v, 9), 'r': -gr.r, 'c': -gr.c}}) AS spot FROM gr JOIN b2 USING (r, c)),
bl AS (SELECT gr.*, row_number() OVER (ORDER BY power(r - spot.r, 2) + power(c - spot.c, 2), r, c) AS i_blob FROM gr, top),
{components_sql('(r, c) IN (SELECT (r, c) FROM gr WHERE picked)', 'cp')}, {components_sql('(r, c) IN (SELECT (r, c) FROM gr, n WHERE i_rand <= n)', 'cr')},
m AS (SELECT count(*) AS cells, max(n) AS n, avg(v) FILTER (WHERE picked) AS selected, avg(v) FILTER (WHERE i_rand <= n) AS random, avg(v) FILTER (WHERE i_best <= n) AS ceiling, avg(v) FILTER (WHERE i_blob <= n) AS oracle,
  CAST(count(*) FILTER (WHERE picked AND i_road <= n) AS DOUBLE) / max(n) AS overlap_road, corr(i_v, i_near) AS rho FROM bl, n)
SELECT cells, n, round(selected, 9) AS selected, round(random, 9) AS random, round(ceiling, 9) AS ceiling, round(oracle, 9) AS oracle, round(oracle - random, 9) AS headroom, round(CASE WHEN oracle - random >= 0.02 THEN (selected - random) / (oracle - random) END, 9) AS capture,
  round(overlap_road, 9) AS overlap_road, round(rho, 9) AS spearman_road, (SELECT count(DISTINCT lab) FROM cp) AS patches_selected, (SELECT count(DISTINCT lab) FROM cr) AS patches_random, overlap_road < 0.75 AND abs(rho) < 0.75 AS beats_road,
  CASE WHEN oracle - random >= 0.02 THEN (selected - random) / (oracle - random) >= 0.25 AND (SELECT count(DISTINCT lab) FROM cp) * 5 < greatest(1, (SELECT count(DISTINCT lab) FROM cr)) END AS beats_random FROM m""")
def matched_null(spark, sf_dir):
    """Selected ground against equal areas drawn at random, near roads, of the best cells and of the best blob, all from the recorded pool."""
    df, side = layers(spark, sf_dir)
    cells = V.pool(df.select("r", "c", F.col("browse").alias("v"), F.col("d_water").alias("road"), F.expr(_PICKED.replace("//", "div")).alias("picked"), "cls"), (side, side), 400.0, F.col("cls") != 80)
    m = V.benchmark(cells, "v", "road", "picked", [F.expr(_RANDOM).alias("x")], (side, side))
    r9 = lambda x: F.round(x, 9).alias(x)
    return m.select(
        "cells", "n", r9("selected"), r9("random"), r9("ceiling"), r9("oracle"), r9("headroom"), r9("capture"), r9("overlap_road"), r9("spearman_road"), "patches_selected", "patches_random", "beats_road", "beats_random",
    )


_BOX, _HALO, _RES = 5, 2, 200.0
_WIDE = 2 * _BOX + 1 + 2 * _HALO


@query(f"""WITH {CELLS_SQL}, ar AS (SELECT DISTINCT {_RANK} AS area, (r // 24) * 24 + 12 AS cr, (c // 24) * 24 + 12 AS cc FROM cells, g WHERE (r // 24) * 24 + 12 < w AND (c // 24) * 24 + 12 < w),
bx AS (SELECT area, greatest(0, least(cr - {_BOX}, w - {2 * _BOX + 1})) AS r0, greatest(0, least(cc - {_BOX}, w - {2 * _BOX + 1})) AS c0 FROM ar, g),
fc AS MATERIALIZED (SELECT area, k, y.i AS r, x.i AS c, r0 - {_HALO} + y.i // k AS pr, c0 - {_HALO} + x.i // k AS pc, r0 - {_HALO} + (y.i + 0.5::DOUBLE) / k - 0.5::DOUBLE AS fr, c0 - {_HALO} + (x.i + 0.5::DOUBLE) / k - 0.5::DOUBLE AS fc,
  y.i BETWEEN {_HALO} * k AND ({_WIDE} - {_HALO}) * k - 1 AND x.i BETWEEN {_HALO} * k AND ({_WIDE} - {_HALO}) * k - 1 AS inside FROM bx, (VALUES (1), (3)) v(k), range(0, {3 * _WIDE}) y(i), range(0, {3 * _WIDE}) x(i) WHERE y.i < {_WIDE} * k AND x.i < {_WIDE} * k),
four AS (SELECT area, f.k, f.r, f.c, elev, (CASE WHEN a = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN b = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS wt FROM fc f, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b), cells s WHERE s.r = floor(fr) + a AND s.c = floor(fc) + b),
it AS (SELECT area, k, r, c, sum(wt * elev) / CASE WHEN sum(wt) > 0 THEN sum(wt) END AS v FROM four GROUP BY 1, 2, 3, 4),
ba AS MATERIALIZED (SELECT f.*, coalesce(v < 25, FALSE) AS barrier FROM fc f LEFT JOIN it USING (area, k, r, c)),
db AS MATERIALIZED (SELECT a.area, a.k, a.r, a.c, sqrt(CAST(min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS DOUBLE)) * ({_RES}::DOUBLE / a.k) AS db FROM ba a JOIN ba b ON a.area = b.area AND a.k = b.k AND b.barrier GROUP BY 1, 2, 3, 4),
t0 AS MATERIALIZED (SELECT b.area, b.k, b.r, b.c, coalesce(db, 1e6) AS db FROM ba b LEFT JOIN db USING (area, k, r, c)),
tap AS MATERIALIZED (SELECT k, x.i AS x, CASE WHEN x.i + d.i < 0 THEN -1 - (x.i + d.i) WHEN x.i + d.i >= {_WIDE} * k THEN 2 * {_WIDE} * k - 1 - (x.i + d.i) ELSE x.i + d.i END AS src FROM (VALUES (1, 1), (3, 4)) v(k, h), range(0, {3 * _WIDE}) x(i), range(-4, 5) d(i) WHERE x.i < {_WIDE} * k AND abs(d.i) <= h),
t1 AS MATERIALIZED (SELECT area, t.k, t.r, tap.x AS c, max(db) AS top, avg(db) AS mid FROM t0 t JOIN tap ON tap.k = t.k AND tap.src = t.c GROUP BY 1, 2, 3, 4), t2 AS (SELECT area, t.k, tap.x AS r, t.c, max(top) AS top, avg(mid) AS mid FROM t1 t JOIN tap ON tap.k = t.k AND tap.src = t.r GROUP BY 1, 2, 3, 4),
s AS (SELECT b.area, b.k, pr, pc, t0.db, CASE WHEN t0.db >= top - 1e-6 AND NOT barrier AND t0.db > {_RES}::DOUBLE / b.k AND 2 * t0.db < 600 THEN {cl('(600 - 2 * t0.db) / 350')} * (0.35 + 0.65 * {cl('(mid - t0.db) / (mid + 1e-6)')}) ELSE 0 END AS strength FROM ba b JOIN t0 USING (area, k, r, c) JOIN t2 USING (area, k, r, c) WHERE inside),
fo AS (SELECT area, k, pr, pc, count(*) AS n, max(strength) AS strength, min(CASE WHEN strength > 0 THEN 2 * db END) AS width, count(*) FILTER (WHERE strength > 0) AS ridge FROM s GROUP BY 1, 2, 3, 4)
SELECT area, CAST(k AS INTEGER) AS step, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(ridge) AS BIGINT) AS candidates, count(width) AS working_cells, round(min(width), 6) AS narrowest, round(sum(strength), 6) AS strength FROM fo GROUP BY 1, 2""")
def nested_necks(spark, sf_dir):
    """The neck detector on the working grid and on one three times as fine, area by area, put into a store of areas and read from it."""
    df, side = demo_cells(spark, sf_dir)
    at = lambda x: (F.expr(f"{x} div 24") * 24 + 12).cast("int")
    areas = df.select(F.expr("cast((r div 24) * 1000 + c div 24 as bigint)").alias("area"), at("r").alias("r"), at("c").alias("c")).distinct().where(f"r < {side} and c < {side}")
    store = N.AreaStore(spark, f"{shared_dir(spark)}/cellweave-areas-{uuid.uuid4().hex}")
    out = None
    for k in (1, 3):
        store.put(N.rerun(df.select("r", "c", "elev"), "elev", areas, _BOX, k, _HALO, (side, side), _RES, F.col("elev") < 25), f"step {k}")
        found = store.get(f"step {k}")
        per = found.groupBy("area").agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("strength") > 0, 1)).alias("candidates"))
        fold = N.folded(found).groupBy("area").agg(F.count("width").alias("working_cells"), F.round(F.min("width"), 6).alias("narrowest"), F.round(F.sum("strength"), 6).alias("strength"))
        one = per.join(fold, "area").select(F.col("area").cast("long").alias("area"), F.lit(k).alias("step"), "cells", "candidates", "working_cells", "narrowest", "strength")
        out = one if out is None else out.unionByName(one)
    return out

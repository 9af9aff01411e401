"""Necks and funnels."""

from pyspark.sql import functions as F

from cellweave.core import query
from cellweave.functions import algebra as A
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.operators import necks as N
from cellweave.operators.zonal import quantile
from cellweave.queries.focal import box_sql
from cellweave.queries.layers import LAYERS_SQL, cl, layers
from cellweave.queries.shapes import components_sql


@query(f"""WITH {CELLS_SQL}, b AS (SELECT r AS sr, c AS sc FROM cells WHERE k < 4), d AS (SELECT r, c, bool_or(k < 4) AS barrier, sqrt(CAST(min((r - sr) * (r - sr) + (c - sc) * (c - sc)) AS DOUBLE)) * 40 AS v FROM cells, b GROUP BY r, c),
e AS (SELECT r, c, v FROM d), {box_sql('e', 'top', 1, 1, 'max(v)')}, {box_sql('e', 'mid', 7, 7)}
SELECT d.r, d.c, round(d.v, 6) AS db, round(CASE WHEN d.v >= top.v - 1e-6 AND NOT barrier AND d.v > 40 AND 2 * d.v < 600 THEN {cl('(600 - 2 * d.v) / 350')} * (0.35 + 0.65 * {cl('(mid.v - d.v) / (mid.v + 1e-6)')}) ELSE 0 END, 8) AS strength
FROM d JOIN top USING (r, c) JOIN mid USING (r, c)""")
def funnel_strength(spark, sf_dir):
    """Ridges of narrow ground between barriers."""
    df, side = demo_cells(spark, sf_dir)
    return N.constriction(df, F.col("k") < 4, 40.0, (side, side)).select("r", "c", F.round("db", 6).alias("db"), F.round("strength", 8).alias("strength"))


@query(f"""WITH RECURSIVE {CELLS_SQL}, {components_sql('k = 0 AND cls <> 80', 'core')},
named AS (SELECT r, c, lab FROM core JOIN core_m USING (id)), box AS (SELECT lab, min(r) - 11 AS r0, max(r) + 11 AS r1, min(c) - 11 AS c0, max(c) + 11 AS c1 FROM named GROUP BY lab),
cut AS (SELECT DISTINCT n.lab, x.r, x.c FROM named n JOIN cells x ON abs(n.r - x.r) + abs(n.c - x.c) <= 3),
ring AS (SELECT DISTINCT n.lab, x.r, x.c FROM named n JOIN cells x ON abs(n.r - x.r) + abs(n.c - x.c) <= 4),
m AS (SELECT lab, r, c, lab * 1000000000 + CAST(r AS BIGINT) * w + c AS id FROM box, cells, g WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 AND cls <> 80 AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.lab = box.lab AND cut.r = cells.r AND cut.c = cells.c)),
e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.lab = b.lab AND ((a.r = b.r AND abs(a.c - b.c) = 1) OR (a.c = b.c AND abs(a.r - b.r) = 1))),
p(id, piece) USING KEY (id) AS (SELECT id, id FROM m UNION SELECT e.b, min(p.piece) FROM p JOIN e ON p.id = e.a JOIN recurring.p x ON x.id = e.b WHERE p.piece < x.piece GROUP BY e.b),
q AS (SELECT m.lab, p.piece, count(*) AS n, bool_or(ring.lab IS NOT NULL) AS touched FROM m JOIN p USING (id) LEFT JOIN ring ON ring.lab = m.lab AND ring.r = m.r AND ring.c = m.c GROUP BY 1, 2),
s AS (SELECT box.lab, count(q.piece) AS pieces, count(*) FILTER (WHERE touched) AS t, list_sort(list(n) FILTER (WHERE touched), 'DESC') AS ns FROM box LEFT JOIN q USING (lab) GROUP BY 1)
SELECT lab AS label, pieces, CASE WHEN pieces > 1 AND t > 1 THEN ns[1] ELSE 0 END AS first, CASE WHEN pieces > 1 AND t > 1 THEN ns[2] ELSE 0 END AS second, round(CASE WHEN CASE WHEN pieces > 1 AND t > 1 THEN ns[2] ELSE 0 END * 0.01 < 0.5 THEN 0.0 ELSE least(1.0, ns[2] * 0.01 / 5.0) END, 9) AS linkage FROM s""")
def neck_linkage(spark, sf_dir):
    """What a cut across each neck parts, in a window around it."""
    df, side = demo_cells(spark, sf_dir)
    s = N.neck_sides(df, (F.col("k") == 0) & (F.col("cls") != 80), F.col("cls") != 80, F.lit(1.0), side, halo=8, margin=2, ring=1)
    return s.select("label", "pieces", "first", "second", F.round(N.linkage(F.col("second") * 0.01), 9).alias("linkage"))


_SIDE = lambda f, c: f"CASE WHEN {f} < 0.2 AND {c} < 0.2 THEN 'open' WHEN abs({f} - {c}) < 0.1 THEN 'mixed' WHEN {f} > {c} THEN 'food' ELSE 'cover' END"


@query(f"""WITH {LAYERS_SQL}, z AS (SELECT zone // 2 AS neck, zone % 2 AS side, quantile_cont(browse * edge, 0.9) AS f, quantile_cont(cover * closure, 0.9) AS cv FROM l GROUP BY 1, 2),
n AS (SELECT a.neck, a.f AS fa, a.cv AS ra, b.f AS fb, b.cv AS rb FROM z a JOIN z b ON a.neck = b.neck AND a.side = 0 AND b.side = 1),
d AS (SELECT neck, {cl('greatest(greatest(least(fa, rb), least(fb, ra)), 0.6 * least(greatest(fa, ra), greatest(fb, rb)))')} AS dest, {_SIDE('fa', 'ra')} AS a, {_SIDE('fb', 'rb')} AS b FROM n)
SELECT neck, round(0.6 + 0.4 * dest, 9) AS weight, CASE WHEN a = b THEN 'same: ' || a WHEN a IN ('food', 'cover') AND b IN ('food', 'cover') THEN 'food to cover' ELSE a || ' to ' || b END AS joins FROM d""")
def funnel_destination(spark, sf_dir):
    """Weight of a neck by what its two sides hold at their best."""
    df, _ = layers(spark, sf_dir)
    df = df.select(F.expr("zone div 2").alias("neck"), (F.col("zone") % 2).alias("side"), F.expr("browse * edge").alias("f"), F.expr("cover * closure").alias("cv"))
    sides = quantile(df, ["neck", "side"], "f", 0.9, "f").join(quantile(df, ["neck", "side"], "cv", 0.9, "cv"), ["neck", "side"], "full")
    z = sides.groupBy("neck").agg(*[F.max(F.when(F.col("side") == s, F.col(v))).alias(n) for s, v, n in ((0, "f", "fa"), (0, "cv", "ra"), (1, "f", "fb"), (1, "cv", "rb"))])
    w, text = N.destination(F.col("fa"), F.col("ra"), F.col("fb"), F.col("rb"))
    return z.where("fa is not null and fb is not null").select("neck", F.round(w, 9).alias("weight"), text.alias("joins"))


@query(f"""WITH {LAYERS_SQL} SELECT r, c, round({cl(f"funnel * (1 + 0.3 * {cl('closure * 2 - 0.5')}) * (1 - 0.55 * CASE WHEN cls = 90 THEN 1 ELSE 0 END)")}, 9) AS funnel FROM l""")
def funnel_damped(spark, sf_dir):
    """A saddle makes a neck more compelling, wet ground less; neither makes one."""
    return layers(spark, sf_dir)[0].select("r", "c", F.round(A.funnel_damped(F.col("funnel"), F.col("closure") * 2 - 0.5, F.col("cls") == 90), 9).alias("funnel"))

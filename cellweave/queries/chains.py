"""Stage chains, zones, sites and comparisons of detectors."""

from pyspark.sql import functions as F

from cellweave.core import materialize, query, table
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.operators import focal as O
from cellweave.operators import shapes as H
from cellweave.operators import vector as V
from cellweave.operators import zonal as Z
from cellweave.plans import extract
from cellweave.queries.focal import box_sql
from cellweave.queries.layers import LAYERS_SQL, layers
from cellweave.queries.shapes import components_sql


_LN = "s AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1000) / 10.0::DOUBLE AS u1, 100 - (s_suppkey * 61 % 1000) / 10.0::DOUBLE AS v1, (s_suppkey * 37 % 1000) / 10.0::DOUBLE + 9.3::DOUBLE AS u2, 100 - ((s_suppkey * 61 % 1000) / 10.0::DOUBLE + 7.1::DOUBLE) AS v2 FROM supplier)"


@query(f"""WITH {_LN}, k AS (SELECT *, CAST(unnest(generate_series(CAST(floor(u1) AS BIGINT), CAST(floor(u2) AS BIGINT))) AS INTEGER) AS c FROM s),
y AS (SELECT id, c, v1 + (greatest(u1, c) - u1) * (v2 - v1) / (u2 - u1) AS a, v1 + (least(u2, c + 1) - u1) * (v2 - v1) / (u2 - u1) AS b FROM k),
f AS (SELECT id, c, CAST(unnest(generate_series(CAST(floor(least(a, b)) AS BIGINT), CAST(floor(greatest(a, b)) AS BIGINT))) AS INTEGER) AS r FROM y) SELECT r, c, count(DISTINCT id) AS lines FROM f WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 99 GROUP BY 1, 2""")
def line_rasterise(spark, sf_dir):
    """Cells that lines touch."""
    x, y = F.col("s_suppkey") * 37 % 1000 / 10.0, F.col("s_suppkey") * 61 % 1000 / 10.0
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 9.3).alias("x"), (y + 7.1).alias("y"))).alias("ring"))
    return V.touched(lines, 0.0, 100.0, 1.0, 100, 100).groupBy("r", "c").agg(F.count(F.lit(1)).alias("lines"))


@query()
def simplify_lines(spark, sf_dir):
    """Lines of orders thinned to what deviates by half a unit."""
    key = F.struct("l_linenumber", "l_partkey", F.col("l_suppkey").cast("double").alias("x"), (F.col("l_partkey") % 10).cast("double").alias("y"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(key)).alias("p"))
    lines = lines.select("id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return V.simplify(lines, 0.5).select(F.col("id").alias("l_orderkey"), F.size("ring").alias("n"))


_SITE = f"""WITH {LAYERS_SQL}, e AS (SELECT r, c, CASE WHEN zone % 10 = 3 THEN -1 ELSE round(edge * funnel * 1e6) * 1e6 - (r * 1000 + c) END AS v FROM l), {box_sql('e', 'm', 3, 3, 'max(v)')},
p AS (SELECT l.zone % 10 AS area, l.r, l.c, l.edge * l.funnel AS score FROM m JOIN e USING (r, c) JOIN l USING (r, c) WHERE e.v = m.v AND l.edge * l.funnel > 0.3 AND l.zone % 10 <> 3), q AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY round(score * 1e6) DESC, r, c) AS site FROM p)
SELECT area, CAST(site AS INTEGER) AS site, r, c, round(score, 9) AS score FROM q WHERE site <= 4"""


@query(_SITE)
def site_placement(spark, sf_dir):
    """The four best spaced spots of each area."""
    df, side = layers(spark, sf_dir)
    v = F.round(F.col("edge") * F.col("funnel") * 1e6)
    p = extract.best_sites(df.select("r", "c", v.alias("v")), (side, side), df.where("zone % 10 <> 3").select((F.col("zone") % 10).alias("rank"), "r", "c"), "v", 3, 300000.0, 4)
    p = p.join(df.select("r", "c", (F.col("edge") * F.col("funnel")).alias("score")), ["r", "c"])
    return p.select(F.col("rank").alias("area"), "site", "r", "c", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE {LAYERS_SQL}, {components_sql('k % 11 >= 4')}, z AS (SELECT r, c, lab FROM comp JOIN comp_m USING (id)),
s AS (SELECT lab, count(*) AS n, avg(browse) AS score, mode() WITHIN GROUP (ORDER BY cls) AS dummy FROM z JOIN l USING (r, c) GROUP BY 1), t AS (SELECT lab, cls, count(*) AS n FROM z JOIN l USING (r, c) GROUP BY 1, 2), m AS (SELECT lab, arg_max(cls, n * 1000 - cls) AS cls, max(n) / sum(n) AS share FROM t GROUP BY 1),
k AS (SELECT s.lab, s.n, s.score, m.cls, m.share, row_number() OVER (PARTITION BY m.cls ORDER BY round(s.score, 9) DESC, s.n DESC, s.lab) AS rank FROM s JOIN m USING (lab) WHERE s.n >= CASE WHEN s.score >= 0.75 THEN 2 ELSE 8 END)
SELECT lab AS zone, n AS cells, round(score, 9) AS score, cls, round(share, 9) AS share, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8""")
def browse_zones(spark, sf_dir):
    """Patches of good browse; small ones pass when they are excellent, and the best of each class are shown."""
    df, side = layers(spark, sf_dir)
    z = H.labels(df, F.col("k") % 11 >= 4, "zone_id", side).join(df.select("r", "c", "browse", "cls"), ["r", "c"])
    z = materialize(z, "zones")
    m = Z.mode_share(z, "zone_id", "cls").join(z.groupBy("zone_id").agg(F.round(F.avg("browse"), 9).alias("score")), "zone_id")
    m = m.where(F.col("n") >= F.when(F.col("score") >= 0.75, 2).otherwise(8))
    m = Z.topk(m.withColumnRenamed("top", "cls"), ["cls"], [F.desc("score"), F.desc("n"), F.col("zone_id")], 8)
    return m.select(F.col("zone_id").alias("zone"), F.col("n").alias("cells"), "score", "cls", F.round("share", 9).alias("share"), "rank")


@query(f"""WITH RECURSIVE {LAYERS_SQL}, {components_sql('k % 5 = 0 AND 2026 - (1980 + k % 45) BETWEEN 10 AND 40')}, z AS (SELECT r, c, lab FROM comp JOIN comp_m USING (id))
SELECT lab AS zone, count(*) AS cells, CAST(min(cut) AS INTEGER) AS first_year, CAST(max(cut) AS INTEGER) AS last_year, round(median(2026 - cut), 6) AS age FROM z JOIN l USING (r, c) GROUP BY 1 HAVING count(*) >= 2""")
def cut_zones(spark, sf_dir):
    """Patches of dated cuts with the years that put them there."""
    df, side = layers(spark, sf_dir)
    z = H.labels(df, (F.col("cut").isNotNull()) & (2026 - F.col("cut")).between(10, 40), "zone_id", side).join(df.select("r", "c", "cut"), ["r", "c"])
    return z.groupBy(F.col("zone_id").alias("zone")).agg(F.count(F.lit(1)).alias("cells"), F.min("cut").alias("first_year"), F.max("cut").alias("last_year"), F.round(F.median(2026 - F.col("cut")), 6).alias("age")).where("cells >= 2")


@query(f"""WITH RECURSIVE {CELLS_SQL}, {components_sql('k < 40 AND NOT (k % 3 = 0)')}, z AS (SELECT r, c, lab FROM comp JOIN comp_m USING (id)), s AS (SELECT lab, count(*) AS n, median(elev) AS width FROM z JOIN cells USING (r, c) GROUP BY 1), q AS (SELECT *, row_number() OVER (ORDER BY n DESC, lab) AS rank FROM s)
SELECT CAST(rank AS INTEGER) AS rank, lab AS label, n, round(width, 6) AS width FROM q WHERE rank <= 10""")
def detector_ab(spark, sf_dir):
    """The ten largest patches that one mask has and the other lacks."""
    df, side = demo_cells(spark, sf_dir)
    only = df.where("k < 40").join(df.where("k % 3 = 0").select("r", "c"), ["r", "c"], "left_anti")
    z = H.labels(only, F.lit(True), "label", side).join(df.select("r", "c", "elev"), ["r", "c"])
    s = z.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("elev"), 6).alias("width"))
    return Z.topk(s, [], [F.desc("n"), F.col("label")], 10).select("rank", "label", "n", "width")


@query(f"""WITH {LAYERS_SQL}, d AS (SELECT r, c, CASE WHEN ndvi IS NOT NULL THEN ndvi * 100 - elev END AS dv, elev, ndvi FROM l), e AS (SELECT r, c, coalesce(dv, 0) AS v FROM d), k AS (SELECT r, c, CASE WHEN dv IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM d), {box_sql('e', 'a', 2, 2)}, {box_sql('k', 'b', 2, 2)}
SELECT d.r, d.c, round(coalesce(ndvi * 100, elev + CASE WHEN b.v > 1e-9 THEN a.v / b.v ELSE 0 END), 6) AS elev FROM d JOIN a USING (r, c) JOIN b USING (r, c)""")
def elevation_blend(spark, sf_dir):
    """A finer source where it was flown; elsewhere the base moved by the mean difference around, so that no seam shows."""
    df, side = layers(spark, sf_dir)
    d = df.select("r", "c", "elev", "ndvi", (F.col("ndvi") * 100 - F.col("elev")).alias("dv")).withColumns({"e": F.coalesce("dv", F.lit(0.0)), "k": F.col("dv").isNotNull().cast("double")})
    d = O.box_mean(O.box_mean(d, "e", "a", (side, side), 5), "k", "b", (side, side), 5)
    return d.select("r", "c", F.round(F.coalesce(F.col("ndvi") * 100, F.col("elev") + F.when(F.col("b") > 1e-9, F.col("a") / F.col("b")).otherwise(0.0)), 6).alias("elev"))

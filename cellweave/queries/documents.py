"""Areas, plans and the documents made of them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.core import query, table
from cellweave.functions.algebra import HSM_WEIGHTS
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.operators.zonal import global_rank
from cellweave.plans import extract as X
from cellweave.plans import merge as M
from cellweave.queries.focal import box_sql, gauss_sql


@query(f"""WITH RECURSIVE {CELLS_SQL}, e AS (SELECT r, c, elev AS v FROM cells), {gauss_sql('e', 's', 2.0)}, sk AS (SELECT r, c, v * 1e7 - (r * 0.002 + c * 0.000001) AS v FROM s), {box_sql('sk', 'm', 6, 6, 'max(v)')},
p AS (SELECT CAST(s.r AS BIGINT) * w + s.c AS peak, s.r AS pr, s.c AS pc, s.v AS top FROM s JOIN sk USING (r, c) JOIN m USING (r, c), g WHERE sk.v = m.v AND s.v > 30),
n AS (SELECT peak, pr, pc, s.r, s.c, peak * 1000000 + CAST(s.r AS BIGINT) * w + s.c AS id FROM p, s JOIN cells USING (r, c), g WHERE power(s.r - pr, 2) + power(s.c - pc, 2) <= 64 AND s.v >= greatest(30 * 0.72, top * 0.82 * 0.80) AND elev >= 30 * 0.70),
f(id) AS (SELECT id FROM n WHERE r = pr AND c = pc UNION SELECT b.id FROM f JOIN n a ON a.id = f.id JOIN n b ON b.peak = a.peak AND abs(a.r - b.r) + abs(a.c - b.c) = 1)
SELECT peak, count(*) AS cells, round(avg(elev), 6) AS mean, CAST(row_number() OVER (ORDER BY count(*) * round(avg(elev), 9) DESC, peak) AS INTEGER) AS rank FROM f JOIN n USING (id) JOIN cells ON cells.r = n.r AND cells.c = n.c GROUP BY peak HAVING count(*) >= 4""")
def focus_areas(spark, sf_dir):
    """Areas at one bar: smoothed peaks, grown over related ground, ranked."""
    from cellweave.core import materialize
    from cellweave.operators.focal import gaussian, local_peaks

    df, side = demo_cells(spark, sf_dir)
    cells = materialize(gaussian(df.select("r", "c", "elev"), "elev", "smooth", (side, side), 2.0), "smooth")
    p = local_peaks(cells, "smooth", (side, side), 6, F.lit(30.0)).withColumn("peak", F.col("r").cast("long") * side + F.col("c"))
    grown = X.grow(cells, p, "smooth", "elev", 30.0, 0.82, 8, closing=0).join(cells, ["r", "c"])
    per = grown.groupBy("peak").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("elev"), 9).alias("m")).where("cells >= 4")
    ranked = global_rank(per.withColumn("_worth", -(F.col("cells") * F.col("m"))), ["_worth", "peak"], "rank")
    return ranked.select("peak", "cells", F.round("m", 6).alias("mean"), F.col("rank").cast("int").alias("rank"))


@query()
def focus_area_ladder(spark, sf_dir):
    """The full extraction: closing, holes, relaxation and the percentile ladder."""
    df, side = demo_cells(spark, sf_dir)
    a = X.focus_areas(df.select("r", "c", (F.col("elev") / 500).alias("s")), (side, side), "s", 0.12, 2.0, 6, 8, 20)
    return a.groupBy("rank").agg(F.count(F.lit(1)).alias("cells"), F.min("peak").alias("peak"))


_AREAS = "a AS (SELECT event_type AS site, day(ts) // 16 AS win, user_id AS unit, count(*) AS n, round(sum(value) / 100, 6) AS km2, round(least(1.0, avg(value) / 100), 6) AS habitat FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY site, win ORDER BY km2 DESC, unit) AS rank, chr(CAST(65 + unit % 3 AS INTEGER)) AS camp FROM a), t AS (SELECT * FROM r WHERE rank <= 5)"


def plan_areas(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), F.expr("cast(day(ts) div 16 as bigint)").alias("win"), F.col("user_id").alias("unit"), "value")
    a = e.groupBy("site", "win", "unit").agg(F.round(F.sum("value") / 100, 6).alias("area_km2"), F.round(F.least(F.lit(1.0), F.avg("value") / 100), 6).alias("habitat"))
    a = a.withColumn("rank", F.row_number().over(Window.partitionBy("site", "win").orderBy(F.desc("area_km2"), "unit")).cast("int")).where("rank <= 5")
    return a.withColumn("camp", F.char((65 + F.col("unit") % 3).cast("int")))


@query(f"""WITH {_AREAS}, c AS (SELECT site, win, camp, row_number() OVER (ORDER BY site, win, camp) AS n FROM (SELECT DISTINCT site, win, camp FROM t)),
l AS (SELECT site, win, camp, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) ELSE chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 27) % 26 AS INTEGER)) END AS letter FROM c)
SELECT site, win, unit, CAST(rank AS INTEGER) AS site_rank, CAST(row_number() OVER (ORDER BY km2 * habitat DESC, site, win, rank) AS INTEGER) AS rank, letter AS camp FROM t JOIN l USING (site, win, camp)""")
def plan_merge(spark, sf_dir):
    """Areas of all plans ranked together, camps lettered anew."""
    return M.merge_areas(plan_areas(spark, sf_dir)).select("site", F.col("win"), "unit", "site_rank", "rank", "camp")


@query(f"""WITH {_AREAS}, m AS (SELECT *, row_number() OVER (ORDER BY km2 * habitat DESC, site, win, rank) AS overall FROM t), p AS (SELECT DISTINCT event_type AS site FROM events UNION SELECT 'failed')
SELECT p.site, p.site <> 'failed' AS ok, count(unit) AS areas, round(max(habitat), 3) AS best_habitat, round(sum(km2), 1) AS total_km2, CAST(min(overall) AS INTEGER) AS best_rank FROM p LEFT JOIN m USING (site) GROUP BY 1""")
def plan_rollup(spark, sf_dir):
    """Each site's share of the merged plan; failed sites stay visible."""
    areas = M.merge_areas(plan_areas(spark, sf_dir))
    plans = table(spark, sf_dir, "events").select(F.col("event_type").alias("site")).distinct().withColumn("ok", F.lit(True)).unionByName(spark.createDataFrame([("failed", False)], "site string, ok boolean"))
    return M.rollup(areas, plans, "site").select("site", "ok", "areas", "best_habitat", "total_km2", "best_rank")


@query("""WITH p AS (SELECT s_suppkey, s_name, -78 + (s_suppkey % 100) / 1000.0 AS lon, round(47 + (s_suppkey // 100) / 1000.0, 3) AS lat FROM supplier) SELECT s_suppkey, '<wpt lat="' || CAST(CAST(lat AS DOUBLE) AS VARCHAR) || '" lon="' || CAST(CAST(round(lon, 3) AS DOUBLE) AS VARCHAR) || '"><name>' || replace(s_name, '&', '&amp;') || '</name></wpt>' AS gpx, 'ff' || 'bbaa' || lpad(CAST(s_suppkey % 10 AS VARCHAR), 2, '0') AS colour FROM p""")
def waypoint_markup(spark, sf_dir):
    """Points as GPX; colours in the byte order of KML."""
    from cellweave.functions.geo import kml_colour

    p = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.round(-78 + F.col("s_suppkey") % 100 / 1000.0, 3).alias("lon"), F.round(47 + F.expr("s_suppkey div 100") / 1000.0, 3).alias("lat"))
    rgb = F.concat(F.lit("#"), F.lpad((F.col("s_suppkey") % 10).cast("string"), 2, "0"), F.lit("AABB"))
    return p.select("s_suppkey", M.gpx_points(F.col("s_name"), F.col("lat"), F.col("lon")).alias("gpx"), kml_colour(rgb).alias("colour"))


@query("""WITH l AS (SELECT l_orderkey, list(struct_pack(x := l_partkey % 1000 / 1000.0, y := l_suppkey / 1000.0) ORDER BY l_linenumber, l_partkey, l_suppkey) AS pts FROM lineitem GROUP BY 1) SELECT l_orderkey, len(pts) AS n, round(list_sum([CAST(p.x AS DOUBLE) for p in pts]), 6) AS sx, round(list_sum([CAST(p.y AS DOUBLE) for p in pts]), 6) AS sy FROM l""")
def line_export(spark, sf_dir):
    """Lines rounded for export, in the order of their points."""
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_partkey") % 1000 / 1000.0, 5).alias("lon"), F.round(F.col("l_suppkey") / 1000.0, 5).alias("lat"))
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("p"))  # noqa: E741
    total = lambda f: F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x[f]), 6)
    return l.select("l_orderkey", F.size("p").cast("long").alias("n"), total("lon").alias("sx"), total("lat").alias("sy"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def contract_rows(spark, sf_dir):
    """One JSON row a feature."""
    d = M.contract(None, nations=table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))["nations"]
    return d.select(F.get_json_object("json", "$.n_nationkey").cast("int").alias("n_nationkey"), "json")


@query("SELECT 'browse 30%, edge 30%, cover 20%, terrain 10%, water 10%' AS text")
def methodology(spark, sf_dir):
    return M.methodology(spark.createDataFrame(list(HSM_WEIGHTS.items()), "name string, weight double"))


@query("""WITH r AS (SELECT c_nationkey AS area, c_acctbal / 1000 AS carry, c_custkey FROM customer), b AS (SELECT area, min(carry) AS carry FROM r GROUP BY 1), a AS (SELECT n_nationkey AS area, n_nationkey * 0.7 AS road FROM nation)
SELECT a.area, round(coalesce(carry / 2, CASE WHEN road > 0 THEN 7 * road / 2 * 1.6 END), 6) AS hours, round(coalesce(carry / 2, CASE WHEN road > 0 THEN 7 * road / 2 * 1.6 END) / 8, 6) AS days FROM a LEFT JOIN b USING (area)""")
def packout(spark, sf_dir):
    """Hours under load: the least carry of an area's routes, or loads over the way to the road."""
    r = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.min(F.col("c_acctbal") / 1000).alias("carry"))
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), (F.col("n_nationkey") * 0.7).alias("road"))
    h = F.coalesce(F.col("carry") / 2, F.when(F.col("road") > 0, 7 * F.col("road") / 2 * 1.6))
    return a.join(r, "area", "left").select("area", F.round(h, 6).alias("hours"), F.round(h / 8, 6).alias("days"))


@query("""WITH a AS (SELECT c_nationkey AS area, sum(c_acctbal) / 10000 AS km2, avg(c_acctbal) / 10000 AS h, max(c_acctbal) / 2000 AS far, count(*) AS stands FROM customer GROUP BY 1)
SELECT area, round(km2, 6) AS km2, round(h, 6) AS habitat, stands, (CASE WHEN h < 0.30 THEN 'modest;' ELSE '' END) || (CASE WHEN km2 < 5 THEN 'small;' ELSE '' END) || (CASE WHEN far > 3 THEN 'far;' ELSE '' END) AS caveats FROM a""")
def camp_verdict(spark, sf_dir):
    """A camp as a whole: ground, quality, stands and what is thin about it."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("area")).agg((F.sum("c_acctbal") / 10000).alias("km2"), (F.avg("c_acctbal") / 10000).alias("h"), (F.max("c_acctbal") / 2000).alias("far"), F.count(F.lit(1)).alias("stands"))
    say = lambda cond, word: F.when(cond, word).otherwise("")
    return a.select("area", F.round("km2", 6).alias("km2"), F.round("h", 6).alias("habitat"), "stands", F.concat(say(F.col("h") < 0.30, "modest;"), say(F.col("km2") < 5, "small;"), say(F.col("far") > 3, "far;")).alias("caveats"))



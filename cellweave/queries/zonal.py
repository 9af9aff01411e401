"""Zonal, block and ranking queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.core import materialize, query
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.operators import zonal as Z
from cellweave.queries.layers import LAYERS_SQL, layers

C = f"WITH {CELLS_SQL}"
L = f"WITH {LAYERS_SQL}"


def r9(x, name):
    return F.round(x, 9).alias(name)


@query(f"{C} SELECT zone, count(elev) AS n, round(sum(elev), 4) AS total, round(avg(elev), 9) AS mean, min(elev) AS low, max(elev) AS high, round(median(elev), 9) AS median, round(quantile_cont(elev, 0.9), 9) AS p90 FROM cells GROUP BY zone")
def zonal_stats(spark, sf_dir):
    z = Z.zonal(demo_cells(spark, sf_dir)[0], "zone", "elev")
    return z.select("zone", "n", F.round("total", 4).alias("total"), r9(F.col("mean"), "mean"), "low", "high", r9(F.col("median"), "median"), r9(F.col("p90"), "p90"))


@query(f"{C}, n AS (SELECT zone, cls, count(*) AS n FROM cells GROUP BY 1, 2) SELECT zone, arg_max(cls, n * 1000 - cls) AS top, round(max(n) / sum(n), 9) AS share, CAST(sum(n) AS BIGINT) AS n, max(n) / sum(n) >= 0.35 AS named FROM n GROUP BY zone")
def zonal_mode_share(spark, sf_dir):
    m = Z.mode_share(demo_cells(spark, sf_dir)[0], "zone", "cls")
    return m.select("zone", "top", r9(F.col("share"), "share"), "n", (F.col("share") >= 0.35).alias("named"))


@query(f"{C} SELECT zone, round(avg(CASE WHEN cls = 80 THEN 1.0 ELSE 0.0 END), 9) AS water_share, round(count(*) * 1600 / 1e6, 9) AS area_km2, round(sum(elev * k) / sum(k), 9) AS weighted, min(cls) AS first_cls, count(DISTINCT cls) AS n_cls, array_to_string(list_sort(list(DISTINCT cls)), ',') AS classes FROM cells GROUP BY zone")
def zonal_shares(spark, sf_dir):
    """Shares, areas, weighted means and distinct classes of zones."""
    df, _ = demo_cells(spark, sf_dir)
    return df.groupBy("zone").agg(
        r9(F.avg((F.col("cls") == 80).cast("double")), "water_share"), r9(F.count(F.lit(1)) * 1600 / 1e6, "area_km2"), r9(F.sum(F.col("elev") * F.col("k")) / F.sum("k"), "weighted"), F.min("cls").alias("first_cls"),
        F.countDistinct("cls").alias("n_cls"), F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("classes"),
    )


@query(f"{C}, q AS (SELECT unnest(quantile_cont(elev, [0.80, 0.84, 0.88, 0.92, 0.96])) AS bar, unnest([80, 84, 88, 92, 96]) AS p FROM cells WHERE cls <> 80) SELECT p, round(bar, 9) AS bar FROM q")
def percentile_ladder(spark, sf_dir):
    rungs = (0.80, 0.84, 0.88, 0.92, 0.96)
    q = demo_cells(spark, sf_dir)[0].where("cls <> 80").agg(F.percentile("elev", F.array(*[F.lit(x) for x in rungs])).alias("q"))
    return q.select(F.posexplode("q").alias("i", "bar")).select((80 + 4 * F.col("i")).cast("int").alias("p"), r9(F.col("bar"), "bar"))


@query(f"{C} SELECT r // 3 AS br, c // 3 AS bc, {', '.join(f'round(avg(CASE WHEN cls = {k} THEN 1.0 ELSE 0.0 END), 9) AS f{k}' for k in (10, 20, 30, 80, 90))} FROM cells GROUP BY 1, 2")
def block_fraction(spark, sf_dir):
    b = Z.blocks(demo_cells(spark, sf_dir)[0], 3)
    return b.groupBy("br", "bc").agg(*[r9(F.avg((F.col("cls") == k).cast("double")), f"f{k}") for k in (10, 20, 30, 80, 90)])


@query(f"{L} SELECT r // 2 AS br, c // 2 AS bc, max(ndvi) AS high, min(ndvi) AS low, round(avg(CASE WHEN ndvi IS NULL THEN 0.0 ELSE 1.0 END), 9) AS valid, CASE WHEN avg(CASE WHEN ndvi IS NULL THEN 0.0 ELSE 1.0 END) >= 0.5 THEN round(avg(ndvi), 9) END AS mean FROM l GROUP BY 1, 2")
def block_minmax(spark, sf_dir):
    """Coarser cells: extremes, valid share and the mean where half or more is valid."""
    b = Z.blocks(layers(spark, sf_dir)[0], 2)
    valid = F.avg(F.col("ndvi").isNotNull().cast("double"))
    return b.groupBy("br", "bc").agg(F.max("ndvi").alias("high"), F.min("ndvi").alias("low"), r9(valid, "valid"), F.when(valid >= 0.5, F.round(F.avg("ndvi"), 9)).alias("mean"))


@query(f"{L} SELECT r // 4 AS br, c // 4 AS bc, CASE WHEN abs(max(tpi)) >= abs(min(tpi)) THEN max(tpi) ELSE min(tpi) END AS peak FROM l GROUP BY 1, 2")
def signed_peak(spark, sf_dir):
    return Z.blocks(layers(spark, sf_dir)[0], 4).groupBy("br", "bc").agg(Z.signed_peak(F.col("tpi")).alias("peak"))


@query(f"{L} SELECT r, c, coalesce(ndvi, CASE WHEN burn IS NOT NULL THEN 0.9 END, CASE WHEN cut IS NOT NULL THEN 0.8 END, browse)::DOUBLE AS v FROM l")
def mosaic_first_valid(spark, sf_dir):
    df = layers(spark, sf_dir)[0].withColumn("a", F.when(F.col("burn").isNotNull(), 0.9)).withColumn("b", F.when(F.col("cut").isNotNull(), 0.8))
    return df.select("r", "c", Z.first_valid(["ndvi", "a", "b", "browse"]).alias("v"))


@query("SELECT event_id % 400 AS cell, count(*) FILTER (WHERE v IS NOT NULL) AS n, round(median(v), 9) AS v FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY 1")
def nanmedian_composite(spark, sf_dir):
    """Median over scenes of what each scene saw."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 400).alias("cell"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return e.groupBy("cell").agg(F.count("v").alias("n"), r9(F.median("v"), "v"))


@query("""WITH y AS (SELECT o_orderkey % 2500 AS cell, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderkey, o_orderstatus FROM orders)
SELECT cell, max(yr) AS newest, arg_max(o_orderstatus, CAST(yr AS BIGINT) * 1000000000 + o_orderkey) AS status, min(yr) AS oldest, CAST(median(yr) AS DOUBLE) AS mid FROM y GROUP BY cell""")
def newest_disturbance(spark, sf_dir):
    """Paint order: the newest dated layer wins its cell and brings its attribute along."""
    y = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 2500).alias("cell"), F.year("o_orderdate").alias("yr"), "o_orderkey", "o_orderstatus")
    return y.groupBy("cell").agg(F.max("yr").alias("newest"), F.max_by("o_orderstatus", F.struct("yr", "o_orderkey")).alias("status"), F.min("yr").alias("oldest"), F.median("yr").alias("mid"))


@query(f"{C}, s AS (SELECT zone, cls, sum(elev) AS score, count(*) AS n FROM cells GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(score, 4) DESC, n DESC, zone) AS rank FROM s) SELECT cls, CAST(rank AS INTEGER) AS rank, zone, round(score, 4) AS score, n FROM r WHERE rank <= 4")
def topk_by_class(spark, sf_dir):
    s = demo_cells(spark, sf_dir)[0].groupBy("zone", "cls").agg(F.round(F.sum("elev"), 4).alias("score"), F.count(F.lit(1)).alias("n"))
    return Z.topk(s, ["cls"], [F.desc("score"), F.desc("n"), F.col("zone")], 4).select("cls", "rank", "zone", "score", "n")


@query("""WITH p AS (SELECT p_partkey, p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS rank FROM part), c AS (SELECT p_type, count(*) AS total FROM part GROUP BY 1)
SELECT p.p_type, p_partkey, CAST(rank AS INTEGER) AS rank, least(total, 60) AS shown, total, total > 60 AS truncated FROM p JOIN c USING (p_type) WHERE rank <= 60""")
def capped_lists(spark, sf_dir):
    """A cap per group that says how much it left out."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    total = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("total"))
    top = Z.topk(p, ["p_type"], [F.desc("p_size"), F.col("p_partkey")], 60).select("p_type", "p_partkey", "rank")
    return top.join(total, "p_type").select("p_type", "p_partkey", "rank", F.least("total", F.lit(60)).alias("shown"), "total", (F.col("total") > 60).alias("truncated"))


@query("""WITH a AS (SELECT p_partkey, p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS old FROM part)
SELECT p_type, p_partkey, CAST(old AS INTEGER) AS old_rank, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey % 3 = 0, old) AS INTEGER) AS new_rank, p_partkey % 3 = 0 AS excluded FROM a""")
def rerank_gate(spark, sf_dir):
    """What a gate excludes goes last; both parts keep their order."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    old = p.withColumn("old_rank", F.row_number().over(Window.partitionBy("p_type").orderBy("p_size", "p_partkey")).cast("int")).withColumn("excluded", F.col("p_partkey") % 3 == 0)
    return Z.rerank(old, ["p_type"], F.col("excluded"), "old_rank").select("p_type", "p_partkey", "old_rank", "new_rank", "excluded")


@query(f"{L}, x AS (SELECT row_number() OVER (ORDER BY elev, r, c) AS ra, row_number() OVER (ORDER BY browse, r, c) AS rb FROM l) SELECT round(corr(ra, rb), 9) AS rho, count(*) AS n FROM x")
def spearman(spark, sf_dir):
    return Z.spearman(layers(spark, sf_dir)[0], "elev", "browse", ["r", "c"]).select(r9(F.col("rho"), "rho"), "n")


_RAND = "((r * 7919 + c * 104729 + 20260807) % 1000003)"


@query(f"""{L}, t AS (SELECT *, row_number() OVER (ORDER BY browse DESC, elev DESC, r, c) AS i_model, row_number() OVER (ORDER BY {_RAND}, r, c) AS i_rand, row_number() OVER (ORDER BY elev DESC, r, c) AS i_best, row_number() OVER (ORDER BY d_road, r, c) AS i_road FROM l WHERE cls <> 80),
n AS (SELECT count(*) // 10 AS n FROM t), m AS (SELECT avg(elev) FILTER (WHERE i_model <= n) AS model, avg(elev) FILTER (WHERE i_rand <= n) AS random, avg(elev) FILTER (WHERE i_best <= n) AS oracle,
 CAST(count(*) FILTER (WHERE i_model <= n AND i_road <= n) AS DOUBLE) / max(n) AS overlap_road FROM t, n)
SELECT round(model, 9) AS model, round(random, 9) AS random, round(oracle, 9) AS oracle, round((model - random) / (oracle - random), 9) AS capture, round(overlap_road, 9) AS overlap_road, (model - random) / (oracle - random) >= 0.25 AS concentrates, overlap_road < 0.75 AS beats_road FROM m""")
def null_model_capture(spark, sf_dir):
    """How much of what the surface can tell apart ends up in the selected ground, against as many random, best and near-road cells."""
    df = materialize(layers(spark, sf_dir)[0].where("cls <> 80").select("r", "c", "elev", "browse", "d_road", (-F.col("elev")).alias("low"), (-F.col("browse")).alias("poor"), F.expr(_RAND).alias("rand")), "pool")
    n = df.count() // 10
    chosen = {"model": ["poor", "low", "r", "c"], "random": ["rand", "r", "c"], "oracle": ["low", "r", "c"]}
    first = {k: Z.first_n(df, order, n) for k, order in chosen.items()}
    m = None
    for k, ground in first.items():
        one = ground.agg(F.avg("elev").alias(k))
        m = one if m is None else m.crossJoin(one)  # one row each
    both = first["model"].join(Z.first_n(df, ["d_road", "r", "c"], n).select("r", "c"), ["r", "c"], "left_semi")
    m = m.crossJoin(both.agg((F.count(F.lit(1)) / F.lit(n)).alias("o")))
    cap = (F.col("model") - F.col("random")) / (F.col("oracle") - F.col("random"))
    return m.select(r9(F.col("model"), "model"), r9(F.col("random"), "random"), r9(F.col("oracle"), "oracle"), r9(cap, "capture"), r9(F.col("o"), "overlap_road"), (cap >= 0.25).alias("concentrates"), (F.col("o") < 0.75).alias("beats_road"))


@query(f"{L} SELECT CAST(CASE WHEN GROUPING(zone) = 0 THEN zone END AS BIGINT) AS site, CAST(CASE WHEN GROUPING(d) = 0 THEN d END AS VARCHAR) AS window_day, count(*) AS n, round(max(browse), 9) AS best, round(sum(elev), 4) AS total FROM l GROUP BY GROUPING SETS ((zone), (d))")
def site_window_rollup(spark, sf_dir):
    df = layers(spark, sf_dir)[0].select("*", F.col("zone").alias("site"), F.col("d").cast("string").alias("window_day"))
    sets = df.groupingSets([[F.col("site")], [F.col("window_day")]], F.col("site"), F.col("window_day"))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("browse"), 9).alias("best"), F.round(F.sum("elev"), 4).alias("total"))


@query(f"{C} SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, arg_max(CAST(r AS BIGINT) * 100000 + c, elev * 1e6 - r - c / 1e5) AS best_cell, round(avg(CASE WHEN cls IN (80, 90) THEN 1.0 ELSE 0.0 END), 9) AS barrier_share, count(DISTINCT zone) AS zones FROM cells")
def grid_extent(spark, sf_dir):
    """Extent, argmax cell and barrier share of a layer."""
    df, _ = demo_cells(spark, sf_dir)
    key = F.expr("cast(r as bigint) * 100000 + c")
    return df.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max_by(key, F.col("elev") * 1e6 - F.col("r") - F.col("c") / 1e5).alias("best_cell"), r9(F.avg(F.col("cls").isin(80, 90).cast("double")), "barrier_share"), F.countDistinct("zone").alias("zones"))


@query(f"{L}, b AS (SELECT quantile_cont(browse, 0.8) AS bar FROM l) SELECT zone, count(*) AS n, CAST(sum(CASE WHEN browse >= bar THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN browse >= bar AND d_road > 3000 THEN 1 ELSE 0 END) AS BIGINT) AS locked FROM l, b GROUP BY zone")
def locked_ground(spark, sf_dir):
    """Good ground by the 80th percentile, and how much of it is out of reach."""
    df, _ = layers(spark, sf_dir)
    b = df.agg(F.percentile("browse", F.lit(0.8)).alias("bar"))
    good = F.col("browse") >= F.col("bar")
    return df.crossJoin(F.broadcast(b)).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(good, 1).otherwise(0)).alias("good"), F.sum(F.when(good & (F.col("d_road") > 3000), 1).otherwise(0)).alias("locked"))


@query(f"""{L}, z AS (SELECT zone, avg(browse) AS b, avg(cover) AS cv, avg(slope) AS sl, avg(d_road) AS dr, avg(CASE WHEN cls = 80 THEN 1.0 ELSE 0.0 END) AS wf, min(d_road) AS near FROM l GROUP BY zone)
SELECT zone, CASE WHEN b > 0.5 THEN 'strong browse' WHEN b < 0.3 THEN 'thin browse' END AS browse_note, cv >= 0.5 AS has_cover, sl > 15 AS steep, near > 100 AS remote, wf > 0.2 AS wet, CAST((b > 0.5)::INT + (cv >= 0.5)::INT + (sl <= 15)::INT AS INTEGER) AS pros FROM z""")
def explain_area(spark, sf_dir):
    """Reasons for and against an area from its zonal means."""
    df, _ = layers(spark, sf_dir)
    rest = [F.min("d_road").alias("near"), F.avg((F.col("cls") == 80).cast("double")).alias("wf")]
    z = Z.ordered_means(df, "zone", ["browse", "cover", "slope"], ["r", "c"], rest).withColumnsRenamed({"browse": "b", "cover": "cv", "slope": "sl"})
    i = lambda x: x.cast("int")
    return z.select(
        "zone", F.when(F.col("b") > 0.5, "strong browse").when(F.col("b") < 0.3, "thin browse").alias("browse_note"), (F.col("cv") >= 0.5).alias("has_cover"), (F.col("sl") > 15).alias("steep"),
        (F.col("near") > 100).alias("remote"), (F.col("wf") > 0.2).alias("wet"), (i(F.col("b") > 0.5) + i(F.col("cv") >= 0.5) + i(F.col("sl") <= 15)).alias("pros"),
    )


@query(f"""{L}, y AS (SELECT zone, count(*) AS n, median(2026 - cut) FILTER (WHERE cut IS NOT NULL) AS ca, count(cut) AS nc, median(2026 - burn) FILTER (WHERE burn IS NOT NULL) AS ba, count(burn) AS nb, mode(cls) AS dummy FROM l GROUP BY zone),
a AS (SELECT zone, n, least(CASE WHEN nc / CAST(n AS DOUBLE) >= 0.2 THEN ca END, CASE WHEN nb / CAST(n AS DOUBLE) >= 0.2 THEN ba END) AS age FROM y)
SELECT zone, CAST(age AS DOUBLE) AS age, CASE WHEN age IS NULL THEN 'undated' WHEN age < 10 THEN 'new' WHEN age <= 25 THEN 'prime' WHEN age <= 40 THEN 'closing' ELSE 'old' END AS kind FROM a""")
def browse_kind(spark, sf_dir):
    """Kind of a zone by the median age of the disturbance that covers enough of it."""
    df, _ = layers(spark, sf_dir)
    a = df.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.median(2026 - F.col("cut")).alias("ca"), F.count("cut").alias("nc"), F.median(2026 - F.col("burn")).alias("ba"), F.count("burn").alias("nb"))
    age = F.least(F.when(F.col("nc") / F.col("n") >= 0.2, F.col("ca")), F.when(F.col("nb") / F.col("n") >= 0.2, F.col("ba"))).cast("double")
    a = a.withColumn("age", age)
    kind = F.when(F.col("age").isNull(), "undated").when(F.col("age") < 10, "new").when(F.col("age") <= 25, "prime").when(F.col("age") <= 40, "closing").otherwise("old")
    return a.select("zone", "age", kind.alias("kind"))


@query(f"{C}, t AS (SELECT zone, r // 20 AS tr, sum(elev) AS s, count(*) AS n FROM cells GROUP BY 1, 2) SELECT tr, zone, round(s / n, 9) AS mean, CAST(n AS BIGINT) AS n FROM t WHERE n >= 5")
def tile_means(spark, sf_dir):
    df, _ = demo_cells(spark, sf_dir)
    t = df.groupBy("zone", F.expr("cast(r div 20 as int)").alias("tr")).agg(F.avg("elev").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return t.select("tr", "zone", r9(F.col("m"), "mean"), "n")


@query(f"{L}, f AS (SELECT r // 10 AS br, c // 10 AS bc, avg(ndvi) AS v FROM l GROUP BY 1, 2) SELECT br, string_agg(CAST(CAST(coalesce(round(v * 1000), -1) AS BIGINT) AS VARCHAR), ',' ORDER BY bc) AS flat, count(*) AS n FROM f GROUP BY 1")
def flat_grid(spark, sf_dir):
    """A resampled grid, a line of text a row of it: what is there is averaged, -1 where nothing is."""
    b = Z.blocks(layers(spark, sf_dir)[0], 10).groupBy("br", "bc").agg(F.avg("ndvi").alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("bc", F.coalesce(F.round(F.col("v") * 1000), F.lit(-1)).cast("long").cast("string").alias("t"))))
    return b.groupBy("br").agg(F.array_join(F.transform(rows, lambda x: x["t"]), ",").alias("flat"), F.count(F.lit(1)).alias("n"))



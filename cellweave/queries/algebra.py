"""Pointwise queries: rescaling, curves, overlays, precedence and cost surfaces over whole layers."""

from pyspark.sql import functions as F

from cellweave.core import query
from cellweave.functions import algebra as A
from cellweave.grid import CELLS_SQL, GridSpec, bbox, demo_cells, half_width_km, resolution, ring_bbox
from cellweave.queries.layers import LAYERS_SQL, cl, knots, layers, nz, pr

L = f"WITH {LAYERS_SQL} "


def r9(x, name):
    return F.round(x, 9).alias(name)


@query(f"WITH {CELLS_SQL} SELECT r, c, elev, cls, k, zone FROM cells")
def grid_build(spark, sf_dir):
    return demo_cells(spark, sf_dir)[0].select("r", "c", "elev", "cls", "k", "zone")


@query("""WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM events)
SELECT CAST(i // w AS INTEGER) AS r, CAST(i % w AS INTEGER) AS c, round(1000 + (i % w + 0.5) * 40, 3) AS x, round(9000 - (i // w + 0.5) * 40, 3) AS y FROM g, range((SELECT w * w FROM g)) t(i)""")
def grid_coordinates(spark, sf_dir):
    side = demo_cells(spark, sf_dir)[1]
    g = GridSpec("EPSG:32198", 1000.0, 9000.0, 40.0, side, side)
    return g.cells(spark).select("r", "c", F.round(g.x(F.col("c")), 3).alias("x"), F.round(g.y(F.col("r")), 3).alias("y"))


@query(f"{L}, f AS (SELECT max(d) AS m FROM l) SELECT zone, best_ground.rank AS rank, best_ground.n_cells AS n_cells, best_ground.mean_score AS mean_score FROM (SELECT zone, count(*) AS n_cells, round(avg(s), 9) AS mean_score, CAST(row_number() OVER (ORDER BY count(*) * avg(s) DESC, zone) AS INTEGER) AS rank FROM (SELECT zone, 0.3 * browse + 0.2 * cover + 0.1 * {pr('d_water', 150, 800)} + 0.1 * {nz('-tpi', -15, 5)} + 0.3 * edge AS s0, CASE WHEN slope > 20 THEN 0.3 ELSE 1.0 END * {cl(f'''0.3 * browse + 0.2 * cover + 0.1 * {pr('d_water', 150, 800)} + 0.1 * {nz('-tpi', -15, 5)} + 0.3 * edge''')} AS s FROM l WHERE cls <> 80) WHERE s >= 0.3 GROUP BY zone) best_ground WHERE rank <= 3")
def best_ground(spark, sf_dir):
    """Where is the best ground: weighted overlay, mask, zonal mean, rank by extent times quality."""
    df, _ = layers(spark, sf_dir)
    score = A.habitat(F.col("browse"), F.col("cover"), A.prox(F.col("d_water"), 150, 800), A.normalize(-F.col("tpi"), -15, 5), F.col("edge"), F.col("slope"), F.col("cls") == 80)
    zones = df.select("zone", score.alias("s")).where("s >= 0.3").groupBy("zone").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("s").alias("m"))
    from pyspark.sql import Window

    ranked = zones.withColumn("rank", F.row_number().over(Window.orderBy((F.col("n_cells") * F.col("m")).desc(), "zone")).cast("int")).where("rank <= 3")
    return ranked.select("zone", "rank", "n_cells", r9(F.col("m"), "mean_score"))


@query(f"{L} SELECT r, c, round({nz('elev', 5, 120)}, 9) AS v, round(1 - {nz('elev', 5, 120)}, 9) AS inverted FROM l")
def normalize_fixed(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    return df.select("r", "c", r9(A.normalize(F.col("elev"), 5, 120), "v"), r9(A.normalize(F.col("elev"), 5, 120, invert=True), "inverted"))


@query(f"{L}, b AS (SELECT quantile_cont(ndvi, 0.02) AS lo, quantile_cont(ndvi, 0.98) AS hi FROM l) SELECT r, c, round({nz('ndvi', 'lo', 'hi')}, 9) AS v FROM l, b")
def normalize_percentile(spark, sf_dir):
    """Bounds from the 2nd and 98th percentile of what is there; absent stays absent."""
    df, _ = layers(spark, sf_dir)
    b = df.agg(F.percentile("ndvi", F.lit(0.02)).alias("lo"), F.percentile("ndvi", F.lit(0.98)).alias("hi"))
    return df.crossJoin(F.broadcast(b)).select("r", "c", r9(A.normalize(F.col("ndvi"), F.col("lo"), F.col("hi")), "v"))  # b is one row


@query(f"{L} SELECT r, c, round({pr('d_water', 150, 800)}, 9) AS v FROM l")
def prox_decay(spark, sf_dir):
    return layers(spark, sf_dir)[0].select("r", "c", r9(A.prox(F.col("d_water"), 150, 800), "v"))


@query(f"{L} SELECT r, c, round({knots('(2026 - burn)', A.BURN_CURVE)}, 9) AS burn_browse, round({knots('(2026 - cut)', A.CUT_CURVE)}, 9) AS cut_browse FROM l")
def interp_curve(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    return df.select("r", "c", r9(A.interp(2026 - F.col("burn"), A.BURN_CURVE), "burn_browse"), r9(A.interp(2026 - F.col("cut"), A.CUT_CURVE), "cut_browse"))


_CASE = lambda col, m: f"(CASE {col} " + " ".join(f"WHEN {k} THEN {v}" for k, v in m.items()) + " ELSE 0.0 END)"


@query(f"{L} SELECT r, c, {_CASE('cls', A.BROWSE_BY_CLASS)}::DOUBLE AS browse_lc, {_CASE('cls', A.COVER_BY_CLASS)}::DOUBLE AS cover_lc FROM l")
def class_score(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    return df.select("r", "c", A.class_score(F.col("cls"), A.BROWSE_BY_CLASS).alias("browse_lc"), A.class_score(F.col("cls"), A.COVER_BY_CLASS).alias("cover_lc"))


_FR = {k: f"f{k}" for k in (10, 20, 30, 80, 90)}


@query(f"""WITH {CELLS_SQL}, fr AS (SELECT r // 2 AS r, c // 2 AS c, {', '.join(f'avg(CASE WHEN cls = {k} THEN 1.0 ELSE 0.0 END) AS f{k}' for k in _FR)} FROM cells GROUP BY 1, 2)
SELECT r, c, round({cl(' + '.join(f'{A.BROWSE_BY_CLASS[k]} * f{k}' for k in _FR))}, 9) AS browse_lc, round({cl('0.9 * f10 + 0.35 * f20 + 0.15 * f90')}, 9) AS cover_lc, round({cl('4 * f10 * (f20 + f30 + f90)')}, 9) AS sub_edge FROM fr""")
def fraction_overlay(spark, sf_dir):
    """Areal class fractions of blocks, scored and paired as cover against food-bearing openings."""
    df, _ = demo_cells(spark, sf_dir)
    fr = df.groupBy(F.expr("cast(r div 2 as int)").alias("r"), F.expr("cast(c div 2 as int)").alias("c")).agg(*[F.avg((F.col("cls") == k).cast("double")).alias(f"f{k}") for k in _FR])
    cols = {k: F.col(v) for k, v in _FR.items()}
    sub = A.clip(4 * F.col("f10") * (F.col("f20") + F.col("f30") + F.col("f90")))
    return fr.select("r", "c", r9(A.fraction_score(cols, A.BROWSE_BY_CLASS), "browse_lc"), r9(A.fraction_score(cols, A.COVER_BY_CLASS), "cover_lc"), r9(sub, "sub_edge"))


_SRC = f"""s AS (SELECT r, c, {knots('(2026 - cut)', A.CUT_CURVE)} AS s1, {knots('(2026 - burn)', A.BURN_CURVE)} AS s2, CASE stand WHEN 1 THEN 0.05 WHEN 2 THEN 0.35 WHEN 3 THEN 0.3 WHEN 4 THEN 0.55 WHEN 5 THEN 0.45 WHEN 7 THEN 0.35 END AS s3, browse AS s4 FROM l)"""
_STAND_BROWSE = {1: 0.05, 2: 0.35, 3: 0.30, 4: 0.55, 5: 0.45, 7: 0.35}  # fixed values


def browse_sources():
    return [A.interp(2026 - F.col("cut"), A.CUT_CURVE), A.interp(2026 - F.col("burn"), A.BURN_CURVE), A.class_score(F.col("stand"), _STAND_BROWSE, None), F.col("browse")]


@query(f"{L}, {_SRC} SELECT r, c, round(coalesce(s1, s2, s3, s4), 9) AS browse, CAST(CASE WHEN s1 IS NOT NULL THEN 1 WHEN s2 IS NOT NULL THEN 2 WHEN s3 IS NOT NULL THEN 3 ELSE 4 END AS INTEGER) AS browse_source FROM s")
def precedence_merge(spark, sf_dir):
    v, code = A.precedence(browse_sources())
    return layers(spark, sf_dir)[0].select("r", "c", r9(v, "browse"), code.alias("browse_source"))


@query(f"""{L}, {_SRC}, a AS (SELECT r, c, [x for x in [s1, s2, s3, s4] if x IS NOT NULL] AS xs FROM s)
SELECT r, c, round(CASE WHEN len(xs) > 1 THEN 1 - abs(xs[1] - (list_sum(xs) - xs[1]) / (len(xs) - 1)) ELSE 0.5 END, 9) AS agree FROM a""")
def corroboration(spark, sf_dir):
    return layers(spark, sf_dir)[0].select("r", "c", r9(A.corroboration(browse_sources()), "agree"))


@query(f"{L} SELECT r, c, round(CASE WHEN cls <> 80 THEN CASE WHEN slope > 20 THEN 0.3 ELSE 1.0 END * {cl(f'''0.3 * browse + 0.2 * cover + 0.1 * {pr('d_water', 150, 800)} + 0.1 * {nz('-tpi', -15, 5)} + 0.3 * edge''')} END, 9) AS hsm FROM l")
def weighted_overlay(spark, sf_dir):
    score = A.habitat(F.col("browse"), F.col("cover"), A.prox(F.col("d_water"), 150, 800), A.normalize(-F.col("tpi"), -15, 5), F.col("edge"), F.col("slope"), F.col("cls") == 80)
    return layers(spark, sf_dir)[0].select("r", "c", r9(score, "hsm"))


_NB = f"{cl('(n - 0.15) / 0.5')} * {cl('1 - (n - 0.8) / 0.15')}"


@query(f"{L}, n AS (SELECT *, {cl('ndvi', -0.2, 0.9)} AS n FROM l) SELECT r, c, round(CASE WHEN n IS NULL THEN browse ELSE 0.6 * browse + 0.4 * {_NB} END, 9) AS browse, round(CASE WHEN n IS NULL THEN cover ELSE 0.6 * cover + 0.4 * {cl('(n - 0.5) / 0.4')} END, 9) AS cover FROM n")
def nan_blend(spark, sf_dir):
    n = F.col("ndvi")
    return layers(spark, sf_dir)[0].select("r", "c", r9(A.blend(F.col("browse"), A.ndvi_browse(n)), "browse"), r9(A.blend(F.col("cover"), A.ndvi_cover(n)), "cover"))


@query(f"{L} SELECT r, c, round(CASE WHEN k > 0 AND elev > 0 THEN (elev - k) / (elev + k + 0.000001) END, 9) AS ndvi FROM l")
def ndvi_index(spark, sf_dir):
    return layers(spark, sf_dir)[0].select("r", "c", r9(A.ndvi(F.col("elev"), F.col("k")), "ndvi"))


_SC = {1: 0.85, 2: 0.55, 3: 0.25, 4: 0.05, 5: 0.35, 6: 0.10, 7: 0.00}  # fixed values


@query(f"{L} SELECT r, c, round(CASE WHEN stand IS NULL THEN cover ELSE {cl(_CASE('stand', _SC) + ' * (0.5 + 0.5 * closure)')} END, 9) AS cover FROM l")
def stand_override(spark, sf_dir):
    """Surveyed stands decide cover where they are mapped."""
    return layers(spark, sf_dir)[0].select("r", "c", r9(F.coalesce(A.stand_cover(A.class_score(F.col("stand"), _SC), F.col("closure")), F.col("cover")), "cover"))


_FEED0 = f"{cl(f'browse * (0.5 + 0.5 * edge) * (0.35 + (0.30 + 0.35 * 0.2) * coalesce(wp, 0.4)) * (1 + 0.2 * browse)')}"


@query(f"""{L}, w AS (SELECT *, {pr('d_water', 150, 640)} AS wp, {nz('cover', 0.6, 0.85)} AS dense, greatest({pr('d_water', 100, 350)}, 0.7 * low) AS wetc, (cos(radians(aspect)) + 1) / 2 * {nz('slope', 3, 12)} AS asp FROM l),
f AS (SELECT *, {cl(f'{_FEED0} * (0.85 + 0.15 * low)')} AS feed, {cl('dense * (0.12 + 0.88 * greatest(wetc, asp))')} AS refuge FROM w)
SELECT r, c, round(feed, 9) AS feed, round(refuge, 9) AS refuge, round({cl('0.65 * feed + 0.35 * refuge')}, 9) AS midday_cool, round({cl('0.15 * feed + 0.85 * refuge')}, 9) AS midday_warm, round({cl('edge * (0.55 + 0.45 * funnel)')}, 9) AS cruise FROM f""")
def behaviour_surfaces(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    feed = A.feeding(F.col("browse"), F.col("edge"), A.prox(F.col("d_water"), 150, 640), F.lit(0.2), F.col("low"))
    refuge = A.thermal_refuge(F.col("cover"), F.col("d_water"), F.col("low"), (F.cos(F.radians("aspect")) + 1) / 2, F.col("slope"))
    cool, warm = A.midday(F.col("feed"), F.col("refuge"))
    df = df.withColumns({"feed": feed, "refuge": refuge})
    return df.select("r", "c", r9(F.col("feed"), "feed"), r9(F.col("refuge"), "refuge"), r9(cool, "midday_cool"), r9(warm, "midday_warm"), r9(A.cruise(F.col("edge"), F.col("funnel")), "cruise"))


@query(f"""{L} SELECT r, c, round({cl('browse * (0.15 + 0.85 * cover)')}, 9) AS hsm_cow, round({cl('browse * (0.3 + 0.7 * (1 - cover))')}, 9) AS hsm_bull,
round({cl(f'0.55 * edge * (0.5 + 0.5 * {pr("d_water", 150, 800)}) + 0.3 * funnel + 0.35 * low + 0.3 * closure')}, 9) AS hsm_rut, round({nz('-tpi', -5, 15)} * (1 - {nz('slope', 0, 15)}), 9) AS wet FROM l""")
def sex_and_rut(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    cow, bull = A.cow_bull(F.col("browse"), F.col("cover"))
    rut = A.rut_surface(F.col("edge"), A.prox(F.col("d_water"), 150, 800), F.col("funnel"), F.col("low"), F.col("closure"))
    return df.select("r", "c", r9(cow, "hsm_cow"), r9(bull, "hsm_bull"), r9(rut, "hsm_rut"), r9(A.wetness(F.col("tpi"), F.col("slope")), "wet"))


_REACH = f"greatest({cl('1 - (d_road - 5000) / 3000.0')}, {cl('1 - (d_water - 10000) / 6000.0')})"


@query(f"""{L}, a AS (SELECT r, c, cover, edge, {_REACH} AS ext, 1 - (1 - exp(-d_road / 1500)) * (1 - 0.5 * low) AS prs, 0.4 * browse + 0.6 * (0.5 * cover + 0.3 * edge + CASE WHEN ndvi IS NULL THEN 0 ELSE 0.2 * ndvi END) / (0.8 + CASE WHEN ndvi IS NULL THEN 0 ELSE 0.2 END) AS phase FROM l),
b AS (SELECT *, ext * (1 - 0.25 * prs) AS ret FROM a)
SELECT r, c, round(ext, 9) AS extraction, round(prs, 9) AS pressure, round(phase, 9) AS phase, round(ret, 9) AS retrieval, round(phase * {cl('ret / 0.05')} * (0.35 + 0.65 * ret), 9) AS huntability FROM b""")
def access_surfaces(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    ext = A.reach_decay(F.col("d_road"), F.lit(5000.0), F.col("d_water"), 2)
    prs = A.pressure(F.col("d_road"), 0.5 * F.col("low"))
    phase = A.phase_blend(F.col("browse"), [(0.5, F.col("cover")), (0.3, F.col("edge")), (0.2, F.col("ndvi"))])
    df = df.withColumns({"ext": ext, "prs": prs, "phase": phase})
    e, p, h = F.col("ext"), F.col("prs"), F.col("phase")
    return df.select("r", "c", r9(e, "extraction"), r9(p, "pressure"), r9(h, "phase"), r9(e * (1 - 0.25 * p), "retrieval"), r9(A.huntability(h, e, p), "huntability"))


@query(f"""{L} SELECT r, c, round(1 + {cl('slope', 0, 60)} / 6 + CASE cls WHEN 90 THEN 3.0 WHEN 10 THEN 0.5 ELSE 0 END, 9) AS friction,
round(CASE WHEN cls = 80 THEN 1e7 WHEN k < 3 THEN 0.05 WHEN k < 8 THEN 0.35 ELSE 1 + slope / 10 + CASE WHEN cls = 90 THEN 3 ELSE 0 END + CASE WHEN low > 0 THEN 3 ELSE 0 END END, 9) AS walk_cost, CASE WHEN cls IN (80, 90) THEN 1.0 ELSE 60.0 END::DOUBLE AS water_cost FROM l""")
def cost_surfaces(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    walk = A.walk_cost(F.col("slope"), F.col("cls"), F.col("low") > 0, F.col("k") < 8, F.col("k") < 3, F.col("cls") == 80)
    return df.select("r", "c", r9(A.friction(F.col("slope"), F.col("cls")), "friction"), r9(walk, "walk_cost"), A.water_cost(F.col("cls")).alias("water_cost"))


@query(f"""{L} SELECT r, c, round({cl('elev / 45')} * {cl('1 - slope / 15')} * {cl('browse / 0.4')}, 9) AS glassing,
round(least(d_road / 400, 1.0) * exp(-greatest(d_road - 400, 0.0) / 900) * exp(-d_water / 500) * edge, 9) AS camp, round(edge * exp(-d_water / 400), 9) AS near_water FROM l""")
def site_surfaces(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    return df.select("r", "c", r9(A.glassing(F.col("elev"), F.col("slope"), F.col("browse")), "glassing"), r9(A.camp_preference(F.col("d_road"), F.col("d_water"), F.col("edge")), "camp"), r9(A.near_water(F.col("edge"), F.col("d_water")), "near_water"))


@query(f"""{L}, blocked AS (SELECT DISTINCT zone FROM l WHERE zone % 7 = 0) SELECT r, c, CASE WHEN b.zone IS NULL THEN round(edge, 6) END AS huntability FROM l LEFT JOIN blocked b USING (zone)""")
def legal_mask(spark, sf_dir):
    """Null on ground whose tenure is closed."""
    df, _ = layers(spark, sf_dir)
    blocked = df.where("zone % 7 = 0").select("zone").distinct().withColumn("closed", F.lit(True))
    return df.join(blocked, "zone", "left").select("r", "c", F.when(F.col("closed").isNull(), F.round("edge", 9)).alias("huntability"))


@query(f"""WITH {CELLS_SQL} SELECT r, c, CASE WHEN r < 5 OR c < 5 OR r >= w - 5 OR c >= w - 5 THEN NULL ELSE elev END AS cropped, CASE WHEN (r - w // 2) * (r - w // 2) + (c - w // 2) * (c - w // 2) <= 900 THEN elev END AS near_camp FROM cells, g""")
def border_and_radius(spark, sf_dir):
    df, side = demo_cells(spark, sf_dir)
    mid = side // 2
    edge = (F.col("r") < 5) | (F.col("c") < 5) | (F.col("r") >= side - 5) | (F.col("c") >= side - 5)
    near = (F.col("r") - mid) ** 2 + (F.col("c") - mid) ** 2 <= 900
    return df.select("r", "c", F.when(~edge, F.col("elev")).alias("cropped"), F.when(near, F.col("elev")).alias("near_camp"))


@query("""WITH p AS (SELECT c_custkey, -78 + (c_custkey % 100) / 1000.0 AS lon, 47 + (c_custkey // 100) / 1000.0 AS lat, 8.0 + c_nationkey AS km FROM customer),
b AS (SELECT *, km / 111.0 AS dlat, km / (111.0 * cos(radians(lat))) AS dlon FROM p)
SELECT c_custkey, round(lon - dlon, 9) AS min_lon, round(lat - dlat, 9) AS min_lat, round(lon + dlon, 9) AS max_lon, round(lat + dlat, 9) AS max_lat, round(greatest(2 * dlat * 111, 2 * dlon * 111 * cos(radians(lat))) / 2, 9) AS half_km,
greatest(40.0, ceil(2 * (greatest(2 * dlat * 111, 2 * dlon * 111 * cos(radians(lat))) / 2) * 1000 / 2400)) AS res, least(500.0, greatest(20.0, ceil(2 * (greatest(2 * dlat * 111, 2 * dlon * 111 * cos(radians(lat))) / 2) * 1000 / 3200), 25.0)) AS res_asked,
round(lon - 0.01 - 2.5 / (111.0 * cos(radians(lat))), 9) AS ring_min_lon FROM b""")
def aoi_boxes(spark, sf_dir):
    """Boxes, half widths and grid resolutions of areas of interest."""
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (-78 + (F.col("c_custkey") % 100) / 1000.0).alias("lon"), (47 + F.expr("c_custkey div 100") / 1000.0).alias("lat"), (8.0 + F.col("c_nationkey")).alias("km"))
    lon, lat = F.col("lon"), F.col("lat")
    p = p.withColumns(dict(zip(("x0", "y0", "x1", "y1"), bbox(lon, lat, F.col("km")))))
    ring = F.array(*[F.struct((lon + a).alias("lon"), (lat + b).alias("lat")) for a, b in ((-0.01, 0), (0, 0.01), (0.01, 0), (0, -0.01), (-0.01, 0))])
    half = half_width_km(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    names = ("min_lon", "min_lat", "max_lon", "max_lat")
    cols = [F.round(F.col(a), 9).alias(n) for a, n in zip(("x0", "y0", "x1", "y1"), names)]
    return p.select("c_custkey", *cols, F.round(half, 9).alias("half_km"), resolution(half, F.lit(40)).alias("res"), resolution(half, F.lit(40), F.lit(25)).alias("res_asked"), F.round(ring_bbox(ring)[0], 9).alias("ring_min_lon"))


@query(f"""{L} SELECT r, c, CASE WHEN elev < 20 THEN 'low' WHEN elev < 60 THEN 'mid' WHEN elev < 120 THEN 'high' ELSE 'top' END AS elev_band, CASE WHEN burn IS NULL THEN NULL WHEN 2026 - burn < 10 THEN 'fresh' WHEN 2026 - burn < 26 THEN 'regen' WHEN 2026 - burn < 41 THEN 'closing' ELSE 'old' END AS burn_band FROM l""")
def value_bands(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    return df.select("r", "c", A.band(F.col("elev"), (20, 60, 120), ("low", "mid", "high", "top")).alias("elev_band"), A.band(2026 - F.col("burn"), (10, 26, 41), ("fresh", "regen", "closing", "old")).alias("burn_band"))

"""Calendars, weather and wind."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.core import query
from cellweave.functions import algebra as A
from cellweave.functions import geo as G
from cellweave.functions import season as S

_DAYS = "d AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS t, min(value) AS lo, max(value) AS hi, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) % 360 AS DOUBLE) AS wind, count(*) % 30 AS kmh, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE count(*) % 7 / 2.0 END AS mm FROM events GROUP BY 1)"


def days(spark, sf_dir):
    """A daily series made of the events: temperatures, wind direction and speed, rain."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    n = F.count(F.lit(1))
    return e.groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("t"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.sum("k") % 360).cast("double").alias("wind"), (n % 30).alias("kmh"), F.when(n % 4 != 0, n % 7 / 2.0).alias("mm"))


_X = "date_diff('day', make_date(2026, 10, 2), d)"


@query(f"""WITH w AS (SELECT CAST(unnest(generate_series(DATE '2026-09-01', DATE '2026-11-15', INTERVAL 7 DAY)) AS DATE) + 3 AS d)
SELECT CAST(d AS VARCHAR) AS day, CAST({_X} AS BIGINT) AS days, round(exp(-power({_X}, 2) / (2 * 6.5 * 6.5)), 6) AS breeding, round(least(1.0, exp(-power({_X} + 6, 2) / 128) + 0.3 * exp(-power({_X} - 12, 2) / 72)), 6) AS response,
CASE WHEN {_X} BETWEEN -20 AND -4 THEN 'seeking' WHEN {_X} BETWEEN -3 AND 6 THEN 'peak' WHEN {_X} BETWEEN 7 AND 29 THEN 'post' ELSE 'outside' END AS phase FROM w""")
def rut_calendar(spark, sf_dir):
    """Weeks of the season by their middle day."""
    w = spark.sql("SELECT explode(sequence(DATE '2026-09-01', DATE '2026-11-15', INTERVAL 7 DAYS)) AS d").select(F.date_add("d", 3).alias("d"))
    x = S.days_from_anchor(F.col("d"))
    return w.select(F.col("d").cast("string").alias("day"), x.cast("long").alias("days"), F.round(S.breeding(x), 6).alias("breeding"), F.round(S.call_response(x), 6).alias("response"), S.phase(x).alias("phase"))


_XO = "date_diff('day', make_date(CAST(year(CAST(o_orderdate AS DATE)) AS BIGINT), 10, 2), CAST(o_orderdate AS DATE))"


@query(f"""SELECT o_orderpriority, CASE WHEN {_XO} BETWEEN -20 AND -4 THEN 'seeking' WHEN {_XO} BETWEEN -3 AND 6 THEN 'peak' WHEN {_XO} BETWEEN 7 AND 29 THEN 'post' ELSE 'outside' END AS phase, count(*) AS n, round(avg(least(1.0, exp(-power({_XO} + 6, 2) / 128) + 0.3 * exp(-power({_XO} - 12, 2) / 72))), 8) AS response FROM orders GROUP BY 1, 2""")
def call_response(spark, sf_dir):
    """Response by phase of dated records, each against its own year."""
    x = S.days_from_anchor(F.to_date("o_orderdate"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", S.phase(x).alias("phase"), S.call_response(x).alias("r"))
    return o.groupBy("o_orderpriority", "phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 8).alias("response"))


@query("""WITH t AS (SELECT r_regionkey, DATE '2026-02-10' + CAST(r_regionkey * 60 AS INTEGER) AS today FROM region), w AS (SELECT r_regionkey, today, year(today) - i AS y FROM t, range(0, 4) s(i))
SELECT r_regionkey, CAST(make_date(y, 6, 15) AS VARCHAR) AS starts, CAST(least(make_date(y, 9, 20), today) AS VARCHAR) AS ends, CAST(max(y) OVER (PARTITION BY r_regionkey) AS BIGINT) AS epoch FROM w WHERE make_date(y, 6, 15) <= today""")
def season_windows(spark, sf_dir):
    """Growing seasons newest first, never one that has not begun."""
    t = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.expr("date_add(DATE '2026-02-10', cast(r_regionkey * 60 as int))").alias("today"))
    w = t.withColumn("y", F.explode(F.sequence(F.year("today") - 3, F.year("today")))).withColumn("a", F.make_date(F.col("y"), F.lit(6), F.lit(15))).where("a <= today")
    return w.select("r_regionkey", F.col("a").cast("string").alias("starts"), F.least(F.make_date(F.col("y"), F.lit(9), F.lit(20)), F.col("today")).cast("string").alias("ends"), F.max("y").over(Window.partitionBy("r_regionkey")).cast("long").alias("epoch"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey % 40 AS cloud, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 12 END AS snow, year(o_orderdate) AS y FROM orders WHERE month(o_orderdate) BETWEEN 6 AND 9),
r AS (SELECT *, row_number() OVER (ORDER BY y DESC, cloud, o_orderkey) AS n FROM s WHERE cloud < 25 AND coalesce(snow, 0) <= 5) SELECT o_orderkey, cloud, CAST(y AS BIGINT) AS season FROM r WHERE n <= 10""")
def scene_choice(spark, sf_dir):
    """The ten best scenes: newest season first, then the least cloud; missing snow counts as none."""
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.month("o_orderdate").between(6, 9))
    s = s.select("o_orderkey", (F.col("o_custkey") % 40).alias("cloud"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 12).alias("snow"), F.year("o_orderdate").cast("long").alias("season"))
    return s.where((F.col("cloud") < 25) & (F.coalesce("snow", F.lit(0)) <= 5)).orderBy(F.desc("season"), "cloud", "o_orderkey").limit(10).select("o_orderkey", "cloud", "season")


@query(f"WITH {_DAYS} SELECT CAST(d AS VARCHAR) AS day, CAST(CASE WHEN t > 15 OR kmh > 20 THEN 2 WHEN t > 8 OR kmh > 12 THEN 3 ELSE 4 END AS INTEGER) AS refresh_hours, coalesce(mm, 0) >= 1 AS rain_reset, round(CASE WHEN lo <= 0 THEN least(1.0, f * 1.2) ELSE f END, 6) AS response, round({'CASE WHEN t IS NOT NULL THEN least(1.0, greatest(0.0, (t - 14) / 6)) ELSE 0.5 END'}, 6) AS refuge FROM (SELECT *, CASE WHEN t >= 20 THEN 0.4 WHEN t >= 17 THEN 0.6 WHEN t >= 14 THEN 0.8 ELSE 1.0 END AS f FROM d)")
def scent_cadence(spark, sf_dir):
    """Refresh hours, rain, damping and midday cover of each day."""
    d = days(spark, sf_dir)
    return d.select(F.col("d").cast("string").alias("day"), S.refresh_hours(F.col("t"), F.col("kmh")).cast("int").alias("refresh_hours"), S.rain_reset(F.col("mm")).alias("rain_reset"), F.round(S.temperature_factor(F.col("t"), F.col("lo")), 6).alias("response"), F.round(A.refuge_weight(F.col("t")), 6).alias("refuge"))


@query("""WITH g AS (SELECT o_custkey % 20 AS plan, avg(dayofyear(o_orderdate)) AS doy, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT plan, round(least(1.0, greatest(0.0, (263 - doy) / 51.0)), 6) AS aquatic FROM g""")
def aquatic_season(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy((F.col("o_custkey") % 20).alias("plan")).agg(F.avg(F.dayofyear("o_orderdate")).alias("doy"))
    return g.select("plan", F.round(A.aquatic_weight(F.col("doy")), 6).alias("aquatic"))


_PT = "p AS (SELECT s_suppkey, -78 + (s_suppkey % 100) / 1000.0 AS lon, 47 + (s_suppkey // 100) / 1000.0 + s_nationkey / 500.0 AS lat FROM supplier)"
_B = "(degrees(atan2(sin(radians(-77.9 - lon)) * cos(radians(47.05)), cos(radians(lat)) * sin(radians(47.05)) - sin(radians(lat)) * cos(radians(47.05)) * cos(radians(-77.9 - lon)))) + 360)"
_MOD = lambda x: f"({x} - 360 * floor(({x}) / 360))"


def points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (-78 + F.col("s_suppkey") % 100 / 1000.0).alias("lon"), (47 + F.expr("s_suppkey div 100") / 1000.0 + F.col("s_nationkey") / 500.0).alias("lat"))


@query(f"WITH {_PT} SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(power(sin(radians(47.05 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(47.05)) * power(sin(radians(-77.9 - lon) / 2), 2))), 7) AS km FROM p")
def haversine(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("s_suppkey", F.round(G.haversine_km(F.col("lat"), F.col("lon"), F.lit(47.05), F.lit(-77.9)), 7).alias("km"))


_NAMES = "(['" + "', '".join(G.COMPASS) + "'])"


@query(f"WITH {_PT}, b AS (SELECT s_suppkey, {_MOD(_B)} AS b FROM p), o AS (SELECT *, {_MOD('b + 180')} AS f FROM b) SELECT s_suppkey, round(b, 6) AS approach_deg, round(f, 6) AS from_deg, {_NAMES}[CAST(floor(f / 22.5 + 0.5) AS BIGINT) % 16 + 1] AS from_compass FROM o")
def bearing_compass(spark, sf_dir):
    """Approach bearing to a site and the wind to hunt it on."""
    b = G.bearing(F.col("lat"), F.col("lon"), F.lit(47.05), F.lit(-77.9))
    o = points(spark, sf_dir).withColumn("b", b).withColumn("f", F.pmod(F.col("b") + 180, F.lit(360.0)))
    return o.select("s_suppkey", F.round("b", 6).alias("approach_deg"), F.round("f", 6).alias("from_deg"), G.compass(F.col("f")).alias("from_compass"))


_DIFF = lambda a, b: f"abs(({a} - {b} + 180) - 360 * floor(({a} - {b} + 180) / 360) - 180)"
_STANDS = "s AS (SELECT s_suppkey % 12 AS area, s_suppkey, (s_suppkey * 37 % 360) * 1.0 AS deg FROM supplier)"


def stands(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") % 12).alias("area"), "s_suppkey", (F.col("s_suppkey") * 37 % 360).cast("double").alias("deg"))


@query(f"WITH {_DAYS}, {_STANDS}, f AS (SELECT d, area, min({_DIFF('deg', 'wind')}) AS off FROM d, s GROUP BY 1, 2) SELECT CAST(d AS VARCHAR) AS day, area, round(off, 6) AS off, row_number() OVER (PARTITION BY d ORDER BY off, area) AS place FROM f WHERE off <= 45")
def wind_rotation(spark, sf_dir):
    """The areas that suit each day's wind, the best first."""
    f = days(spark, sf_dir).select("d", "wind").crossJoin(F.broadcast(stands(spark, sf_dir).select("area", "deg").distinct())).groupBy("d", "area").agg(F.min(G.angle_between(F.col("deg"), F.col("wind"))).alias("off"))  # 12 areas by 360 whole degrees at most
    place = F.row_number().over(Window.partitionBy("d").orderBy("off", "area")).cast("long")
    return f.where("off <= 45").select(F.col("d").cast("string").alias("day"), "area", F.round("off", 6).alias("off"), place.alias("place"))


@query(f"WITH {_STANDS}, o AS (SELECT unnest([0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]) AS oct), w AS (SELECT area, oct, bool_or({_DIFF('deg', 'oct')} <= 45) AS ok FROM s, o GROUP BY 1, 2) SELECT area, count(*) FILTER (WHERE ok) AS octants, array_to_string(list(CAST(CAST(oct AS BIGINT) AS VARCHAR) ORDER BY oct) FILTER (WHERE ok), ',') AS winds FROM w GROUP BY 1")
def wind_robustness(spark, sf_dir):
    """On how many of eight winds an area works."""
    o = F.explode(F.array(*[F.lit(45.0 * i) for i in range(8)]))
    w = stands(spark, sf_dir).withColumn("oct", o).groupBy("area", "oct").agg(F.bool_or(G.angle_between(F.col("deg"), F.col("oct")) <= 45).alias("ok"))
    return w.groupBy("area").agg(F.count(F.when(F.col("ok"), 1)).alias("octants"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("oct").cast("int")))), lambda x: x.cast("string")), ",").alias("winds"))


@query(f"WITH {_PT}, s AS (SELECT s_suppkey, 12 - (lon / 15 + 4) AS noon, degrees(acos(greatest(-1.0, least(1.0, -tan(radians(lat)) * tan(0.4093 * sin(2 * pi() / 365 * (s_suppkey % 365 - 81))))))) / 15 AS h FROM p) SELECT s_suppkey, round(noon - h, 6) AS sunrise, round(noon + h, 6) AS sunset, s_suppkey % 24 >= noon - h + 0.75 AND s_suppkey % 24 <= noon + h - 0.5 AS rising FROM s")
def sun_and_thermals(spark, sf_dir):
    """Sunrise, sunset and whether air rises at an hour."""
    rise, set_ = G.sun(F.col("lat"), F.col("lon"), F.col("s_suppkey") % 365)
    p = points(spark, sf_dir).withColumns({"a": rise, "b": set_})
    h = F.col("s_suppkey") % 24
    return p.select("s_suppkey", F.round("a", 6).alias("sunrise"), F.round("b", 6).alias("sunset"), ((h >= F.col("a") + 0.75) & (h <= F.col("b") - 0.5)).alias("rising"))


_DEST = "asin(sin(radians(lat)) * cos(0.07 / 6371) + cos(radians(lat)) * sin(0.07 / 6371) * cos(radians(s_suppkey * 37 % 360)))"


@query(f"WITH {_PT}, d AS (SELECT *, {_DEST} AS la2 FROM p) SELECT s_suppkey, round(degrees(la2), 7) AS lat2, round(lon + degrees(atan2(sin(radians(s_suppkey * 37 % 360)) * sin(0.07 / 6371) * cos(radians(lat)), cos(0.07 / 6371) - sin(radians(lat)) * sin(la2))), 7) AS lon2 FROM d")
def downwind_points(spark, sf_dir):
    """Where the shooter sits: 70 m downwind."""
    lat2, lon2 = G.destination(F.col("lat"), F.col("lon"), F.col("s_suppkey") * 37 % 360, F.lit(0.07))
    return points(spark, sf_dir).select("s_suppkey", F.round(lat2, 7).alias("lat2"), F.round(lon2, 7).alias("lon2"))


@query("""WITH z AS (SELECT c_nationkey % 12 AS zone, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS males FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY y DESC) AS k FROM z)
SELECT lpad(CAST(zone AS VARCHAR), 2, '0') AS zone, y, n, males FROM r WHERE k <= 5""")
def last_n_years(spark, sf_dir):
    """The last five years of each zone."""
    from cellweave.operators.zonal import topk

    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    z = o.groupBy((F.col("c_nationkey") % 12).alias("zone"), F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("males"))
    return topk(z, ["zone"], [F.desc("y")], 5, "k").select(F.lpad(F.col("zone").cast("string"), 2, "0").alias("zone"), "y", "n", "males")


@query(f"""WITH {_DAYS}, want AS (SELECT d FROM d UNION SELECT CAST(d + INTERVAL 1 YEAR AS DATE) FROM d UNION SELECT CAST(d + INTERVAL 40 DAY AS DATE) FROM d)
SELECT CAST(w.d AS VARCHAR) AS day, round(a.t, 6) AS t, a.d IS NULL AS missing, round(b.t, 6) AS proxy FROM want w LEFT JOIN d a ON a.d = w.d LEFT JOIN d b ON b.d = CAST(w.d - INTERVAL 1 YEAR AS DATE) AND a.d IS NULL""")
def weather_lookup(spark, sf_dir):
    """The days of the series, those a year and those 40 days later against it; the day a year earlier stands in where there is none."""
    d = days(spark, sf_dir)
    w = d.select(F.explode(F.array("d", F.add_months("d", 12), F.date_add("d", 40))).alias("w")).distinct()
    a = d.select(F.col("d").alias("a_d"), F.col("t").alias("a_t"))
    b = d.select(F.col("d").alias("b_d"), F.col("t").alias("b_t"))
    j = w.join(a, F.col("w") == F.col("a_d"), "left").join(b, (F.add_months("w", -12) == F.col("b_d")) & F.col("a_d").isNull(), "left")
    return j.select(F.col("w").cast("string").alias("day"), F.round("a_t", 6).alias("t"), F.col("a_d").isNull().alias("missing"), F.round("b_t", 6).alias("proxy"))

"""Cost fields, routes and their legs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.core import query
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.operators import cost as K
from cellweave.operators.scan import Tracks, smoothed

_OFF = "o AS (SELECT * FROM (VALUES (0,1,1.0),(1,0,1.0),(0,-1,1.0),(-1,0,1.0),(1,1,sqrt(2)),(1,-1,sqrt(2)),(-1,1,sqrt(2)),(-1,-1,sqrt(2))) t(dr,dc,l))"


def field_sql(name: str, cost: str, seed: str, where: str = "TRUE") -> str:
    """CTEs: name(id, dist), least cost from the seeds; 1e300 where no route leads."""
    return f"""{name}_m AS MATERIALIZED (SELECT CAST(r AS BIGINT) * w + c AS id, r, c, CAST({cost} AS DOUBLE) AS cost, {seed} AS seed FROM cells, g WHERE {where}),
{name}_e AS MATERIALIZED (SELECT a.id AS a, b.id AS b, l * (a.cost + b.cost) / 2 AS len FROM {name}_m a, o JOIN {name}_m b ON b.r = a.r + dr AND b.c = a.c + dc),
{name}(id, dist) USING KEY (id) AS (SELECT id, CASE WHEN seed THEN 0.0 ELSE 1e300 END::DOUBLE FROM {name}_m UNION SELECT e.b, min({name}.dist + e.len) FROM {name} JOIN {name}_e e ON {name}.id = e.a JOIN recurring.{name} x ON x.id = e.b WHERE {name}.dist < 1e299 AND {name}.dist + e.len < x.dist - 1e-9 GROUP BY e.b)"""


_WALK = "1 + (k % 10) * 0.5"


def walk(df):
    return df.select("r", "c", "k", "cls", F.when(F.col("cls") != 80, 1 + (F.col("k") % 10) * 0.5).alias("walk"))


@query(f"WITH RECURSIVE {CELLS_SQL}, {_OFF}, {field_sql('d', _WALK, 'k < 2', 'cls <> 80')} SELECT r, c, round(CASE WHEN dist < 1e299 THEN dist * 40 ELSE 1e6 END, 4) AS d_m FROM d JOIN d_m USING (id)")
def cost_distance(spark, sf_dir):
    """Metres of friction from the nearest road cell around impassable water; 1e6 out of reach."""
    df = walk(demo_cells(spark, sf_dir)[0])
    d = K.cost_field(df, "walk", F.col("k") < 2, "d")
    return d.select("r", "c", F.round(F.coalesce(F.col("d") * 40, F.lit(1e6)), 4).alias("d_m"))


@query(f"""WITH RECURSIVE {CELLS_SQL}, {_OFF}, {field_sql('a', _WALK, 'r = 0 AND c < 5', 'cls <> 80')}, {field_sql('b', _WALK, 'r = (SELECT w - 1 FROM g) AND c >= (SELECT w - 5 FROM g)', 'cls <> 80')},
t AS (SELECT a.id, a.dist AS x, b.dist AS y FROM a JOIN b USING (id) WHERE a.dist < 1e299 AND b.dist < 1e299), m AS (SELECT min(x + y) AS total FROM t) SELECT round(total, 6) AS total, count(*) FILTER (WHERE x + y <= total + 1e-6) AS cells FROM t, m GROUP BY total""")
def least_cost_path(spark, sf_dir):
    """Cost between two sides and how many cells lie on a cheapest route."""
    df, side = demo_cells(spark, sf_dir)
    way = K.corridor(walk(df), "walk", (F.col("r") == 0) & (F.col("c") < 5), (F.col("r") == side - 1) & (F.col("c") >= side - 5))
    return way.agg(F.round(F.min("total"), 6).alias("total"), F.count(F.lit(1)).alias("cells"))


@query(f"""WITH RECURSIVE {CELLS_SQL}, {_OFF}, {field_sql('a', _WALK, 'r = 0 AND c < 5', 'cls <> 80')}, {field_sql('b', _WALK, 'r = (SELECT w - 1 FROM g) AND c >= (SELECT w - 5 FROM g)', 'cls <> 80')}
SELECT round(min(a.dist + b.dist), 6) AS total, TRUE AS connected, TRUE AS cheapest FROM a JOIN b USING (id) WHERE a.dist < 1e299 AND b.dist < 1e299""")
def route_trace(spark, sf_dir):
    """One traced route: its steps hang together and add up to the least cost."""
    df, side = demo_cells(spark, sf_dir)
    df = walk(df)
    start, end = (F.col("r") == 0) & (F.col("c") < 5), (F.col("r") == side - 1) & (F.col("c") >= side - 5)
    path = K.least_cost_path(df, "walk", start, end).join(df.select("r", "c", "walk"), ["r", "c"])
    w = Window.orderBy("step")
    step = F.sqrt((F.col("r") - F.lag("r").over(w)) ** 2 + (F.col("c") - F.lag("c").over(w)) ** 2)
    legs = path.select(step.alias("s"), (step * (F.col("walk") + F.lag("walk").over(w)) / 2).alias("cost"))
    least = K.cost_field(df, "walk", start, "d").join(df.where(end).select("r", "c"), ["r", "c"]).agg(F.min("d").alias("least"))
    out = legs.agg(F.sum("cost").alias("t"), (F.coalesce(F.max("s"), F.lit(0.0)) < 1.5).alias("connected")).crossJoin(least)
    return out.select(F.round("t", 6).alias("total"), "connected", (F.abs(F.col("t") - F.col("least")) < 1e-6).alias("cheapest"))


@query(f"""WITH RECURSIVE {CELLS_SQL}, {_OFF}, {field_sql('w', _WALK, 'r = (SELECT w // 2 FROM g) AND c = (SELECT w // 2 FROM g)')}, {field_sql('v', '0.01', 'r = 0', 'r % 7 = 0 OR k < 30')},
t AS (SELECT w_m.r, w_m.c, w.dist + v.dist AS total FROM w JOIN w_m USING (id) JOIN v USING (id) WHERE w.dist < 1e299 AND v.dist < 1e299), s AS (SELECT min(w.dist) AS walk_only FROM w JOIN w_m USING (id) WHERE r = 0)
SELECT CASE WHEN total < walk_only THEN 'vehicle' ELSE 'foot' END AS mode, round(least(total, walk_only), 6) AS total, round(walk_only, 6) AS walk_only FROM (SELECT min(total) AS total FROM t), s""")
def mode_route(spark, sf_dir):
    """One vehicle leg, then on foot, if that is cheaper than walking."""
    df, side = demo_cells(spark, sf_dir)
    df = df.withColumn("walk", 1 + (F.col("k") % 10) * 0.5)
    mid = (F.col("r") == side // 2) & (F.col("c") == side // 2)
    out = K.mode_route(df, "walk", (F.col("r") % 7 == 0) | (F.col("k") < 30), 0.01, F.col("r") == 0, mid)
    return out.select("mode", F.round("total", 6).alias("total"), F.round("walk_only", 6).alias("walk_only"))


_SMOOTH = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 1 ELSE 0 END AS o, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s(user_id, i, v) AS (SELECT user_id, i, o FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.i < e.n AND s.v = nx.o AND s.v <> e.o THEN s.v ELSE e.o END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1 LEFT JOIN e nx ON nx.user_id = e.user_id AND nx.i = e.i + 1)"""


def smoothed_runs(spark, sf_dir):
    """Tracks of users: events in order with the state `on` of each, single-cell flicker taken out from front to back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    on = (F.get_json_object("props", "$.k").cast("int") < 50).cast("int")
    return smoothed(Tracks(e.select("user_id", "event_id", on.alias("o")), ["user_id"], ["event_id"]), "o", "on")


@query(f"""WITH RECURSIVE {_SMOOTH}, b AS (SELECT user_id, i, v, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY i) = v THEN 0 ELSE 1 END AS cut FROM s), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY i) AS run FROM b)
SELECT user_id, CAST(run AS BIGINT) AS run, CASE WHEN max(v) = 1 THEN 'trail' ELSE 'bush' END AS mode, count(*) AS cells FROM r GROUP BY user_id, run""")
def leg_runs(spark, sf_dir):
    """Runs of trail and bush along tracks, flicker of one cell smoothed."""
    s = smoothed_runs(spark, sf_dir).beside(before=("on", -1))
    s = s.running(F.when(F.col("before") == F.col("on"), 0).otherwise(1), "run").rows
    return s.groupBy("user_id", "run").agg(F.when(F.max("on") == 1, "trail").otherwise("bush").alias("mode"), F.count(F.lit(1)).alias("cells"))


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'boat' WHEN 'click' THEN 'vehicle' ELSE 'foot' END AS mode, value AS km, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT user_id, km, CASE WHEN mode = 'foot' AND (p = 'view' OR n = 'view') THEN 'portage' ELSE mode END AS mode FROM e)
SELECT user_id, round(coalesce(sum(km) FILTER (WHERE mode = 'foot'), 0), 4) AS foot_km, round(coalesce(sum(km) FILTER (WHERE mode = 'portage'), 0), 4) AS portage_km, round(coalesce(sum(km) FILTER (WHERE mode IN ('foot', 'portage')), 0), 4) AS walk_km, round(7 * coalesce(sum(km) FILTER (WHERE mode = 'foot'), 0) + 8 * coalesce(sum(km) FILTER (WHERE mode = 'portage'), 0), 3) AS carry_km,
CASE WHEN coalesce(sum(km) FILTER (WHERE mode = 'boat'), 0) >= coalesce(sum(km) FILTER (WHERE mode = 'vehicle'), 0) THEN 'boat' ELSE 'vehicle' END AS ride_mode FROM l GROUP BY user_id""")
def portage_carry(spark, sf_dir):
    """Kilometres by mode; a walk beside a boat leg is a portage, and loads are carried seven or eight times."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"p": F.lag("event_type").over(w), "n": F.lead("event_type").over(w)})
    mode = F.when(F.col("event_type") == "view", "boat").when(F.col("event_type") == "click", "vehicle").when((F.col("p") == "view") | (F.col("n") == "view"), "portage").otherwise("foot")
    e = e.select("user_id", mode.alias("mode"), F.col("value").alias("km"))
    km = lambda *m: F.coalesce(F.sum(F.when(F.col("mode").isin(*m), F.col("km"))), F.lit(0.0))
    return e.groupBy("user_id").agg(
        F.round(km("foot"), 4).alias("foot_km"), F.round(km("portage"), 4).alias("portage_km"), F.round(km("foot", "portage"), 4).alias("walk_km"), F.round(7 * km("foot") + 8 * km("portage"), 3).alias("carry_km"),
        F.when(km("boat") >= km("vehicle"), "boat").otherwise("vehicle").alias("ride_mode"),
    )


@query(f"WITH {CELLS_SQL}, w AS (SELECT r, c FROM cells WHERE cls = 80), d AS (SELECT a.r, a.c, min(abs(a.r - s.r) + abs(a.c - s.c)) AS n FROM cells a, (SELECT r, c FROM cells WHERE k < 3) s GROUP BY 1, 2), t AS (SELECT a.r, a.c, min(abs(a.r - s.r) + abs(a.c - s.c)) AS n FROM cells a, (SELECT r, c FROM cells WHERE k < 8) s GROUP BY 1, 2) SELECT w.r, w.c, d.n <= 2 AS motor, t.n <= 10 AS canoe FROM w JOIN d USING (r, c) JOIN t USING (r, c)")
def launch_cells(spark, sf_dir):
    """Water that a trailer reaches from a road, and water that a canoe can be carried to from any trail."""
    from cellweave.operators.shapes import city_block

    df = demo_cells(spark, sf_dir)[0].select("r", "c", "k", "cls")
    df = city_block(city_block(df, F.col("k") < 3, "road"), F.col("k") < 8, "trail")
    return df.where("cls = 80").select("r", "c", (F.col("road") <= 2).alias("motor"), (F.col("trail") <= 10).alias("canoe"))

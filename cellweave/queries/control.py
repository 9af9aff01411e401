"""Routes of areas, seats, plans of a request, artefacts and what a client draws."""

from pyspark.sql import functions as F

from cellweave.core import query, table
from cellweave.functions import geo as G
from cellweave.plans import control as K
from cellweave.plans import routes as R

_LEGEND = ["rut_calling", "glassing", "thermal_refuge", "funnel", "saline_blind"]
_SITES_SQL = "s AS (SELECT c_nationkey AS area, (['rut_calling', 'glassing', 'thermal_refuge', 'funnel', 'saline_blind'])[c_custkey % 5 + 1] AS legend, c_custkey AS seq, CAST(c_custkey % 40 AS INTEGER) AS r, CAST(c_custkey // 40 % 40 AS INTEGER) AS c FROM customer)"


def _sites(spark, sf_dir):
    k = F.col("c_custkey")
    legend = F.element_at(F.array(*[F.lit(x) for x in _LEGEND]), (k % 5).cast("int") + 1)
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area"), legend.alias("legend"), k.alias("seq"), (k % 40).cast("int").alias("r"), F.expr("cast(c_custkey div 40 % 40 as int)").alias("c"))


@query(f"""WITH {_SITES_SQL}, a AS (SELECT n_nationkey AS area, n_nationkey * 3 % 40 AS cr, n_nationkey % 4 AS cc, n_nationkey * 3 % 40 AS sr, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey % 4 ELSE 7 END AS sc, 4000 + n_nationkey * 300 AS d FROM nation),
k AS (SELECT *, row_number() OVER (PARTITION BY area, legend ORDER BY seq) AS n FROM s WHERE legend IN ('rut_calling', 'thermal_refuge'))
SELECT k.area, CASE legend WHEN 'rut_calling' THEN 'route_best' ELSE 'route_midday_hot' END AS legend, CAST(n AS INTEGER) AS n, r, c FROM k JOIN a USING (area) WHERE n <= CASE legend WHEN 'rut_calling' THEN 2 ELSE 1 END AND NOT (r = cr AND c = cc)
UNION ALL SELECT area, CASE WHEN (SELECT min(d) FROM a) < 5000 THEN 'route_access' ELSE 'route_paddle' END, 1, cr, cc FROM a WHERE NOT (sr = cr AND sc = cc)""")
def route_plan(spark, sf_dir):
    """Routes of each area: to calling stands, to a refuge, and in."""
    n = F.col("n_nationkey")
    i = lambda x: x.cast("int")
    areas = table(spark, sf_dir, "nation").select(n.alias("area"), i(n * 3 % 40).alias("camp_r"), i(n % 4).alias("camp_c"), i(n * 3 % 40).alias("stage_r"), i(F.when(n % 5 == 0, n % 4).otherwise(7)).alias("stage_c"), (4000 + n * 300).alias("d_road"))
    return R.plan_routes(areas, _sites(spark, sf_dir))


@query("""WITH e AS (SELECT l_suppkey AS route, l_orderkey * 100 + l_linenumber * 10 + row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) AS seq, (['foot_trail', 'canoe', 'foot', 'atv'])[l_partkey % 4 + 1] AS mode, l_quantity AS km, l_partkey AS place FROM lineitem),
b AS (SELECT *, lag(mode) OVER w = 'canoe' OR lead(mode) OVER w = 'canoe' AS p, lead(seq) OVER w IS NOT NULL AS more FROM e WINDOW w AS (PARTITION BY route ORDER BY seq)), m AS (SELECT route, seq, km, place, more, CASE WHEN mode LIKE 'foot%' AND p THEN 'portage' ELSE mode END AS mode FROM b),
s AS (SELECT route, mode, round(sum(km), 2) AS km, arg_min(place, seq) FILTER (WHERE more) AS stop FROM m GROUP BY 1, 2), x AS (SELECT route, string_agg(mode || '=' || CAST(CAST(km AS BIGINT) AS VARCHAR), ',' ORDER BY mode) AS km_by_mode, coalesce(sum(km) FILTER (WHERE mode LIKE 'foot%' OR mode = 'portage'), 0) AS walk_km, coalesce(sum(km) FILTER (WHERE mode LIKE 'foot%'), 0) * 7 + coalesce(sum(km) FILTER (WHERE mode = 'portage'), 0) * 8 AS carry_km, coalesce(sum(km) FILTER (WHERE mode NOT LIKE 'foot%'), 0) AS ride_km FROM s GROUP BY 1),
y AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY km DESC, mode) AS n FROM s WHERE mode NOT LIKE 'foot%')
SELECT x.route, km_by_mode, round(walk_km, 2) AS walk_km, round(carry_km, 1) AS carry_km, round(ride_km, 2) AS ride_km, y.mode AS ride_mode, stop AS vehicle_left_at FROM x LEFT JOIN y ON y.route = x.route AND n = 1""")
def route_properties(spark, sf_dir):
    """Kilometres of routes by mode, loads, the ride and where it ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey", "l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("foot_trail", "canoe", "foot", "atv")]), (F.col("l_partkey") % 4).cast("int") + 1)
    seq = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.row_number().over(w)
    legs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("route"), seq.alias("seq"), mode.alias("mode"), F.col("l_quantity").alias("km"), F.col("l_partkey").alias("end"))
    out = R.route_properties(legs)
    text = F.array_join(F.transform(F.map_entries("km_by_mode"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("long").cast("string"))), ",")
    return out.withColumn("km_by_mode", text)


@query(f"""WITH {_SITES_SQL}, r AS (SELECT *, CASE legend WHEN 'rut_calling' THEN 1 WHEN 'glassing' THEN 2 ELSE 3 END AS o, CASE legend WHEN 'rut_calling' THEN 'caller' WHEN 'glassing' THEN 'glasser' ELSE 'sitter' END AS role FROM s WHERE legend <> 'thermal_refuge'),
n AS (SELECT area, seq, role, row_number() OVER (PARTITION BY area, role ORDER BY legend = 'funnel', seq) AS n, row_number() OVER (PARTITION BY area ORDER BY o, legend = 'funnel', seq) AS seat FROM r)
SELECT area, seq, role, CAST(n AS INTEGER) AS n, CAST(seat AS INTEGER) AS seat FROM n WHERE seat <= 2 * greatest(1, area % 40)""")
def crew_seats(spark, sf_dir):
    """Who sits where in an area."""
    return R.seats(_sites(spark, sf_dir), F.col("area") % 40).select("area", "seq", "role", "n", "seat")


@query(f"WITH {_SITES_SQL}, n AS (SELECT area, legend, count(*) AS n FROM s WHERE seq % 7 > 0 GROUP BY 1, 2) SELECT area, string_agg(legend || '=' || CAST(n AS VARCHAR), ',' ORDER BY legend) AS counts FROM n GROUP BY 1")
def counts_by_key(spark, sf_dir):
    """Sites of an area by kind, as a map."""
    s = _sites(spark, sf_dir).withColumn("legend", F.when(F.col("seq") % 7 > 0, F.col("legend")))
    text = F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return K.counts_by_key(s, ["area"], "legend").select("area", text.alias("counts"))


@query("""WITH s AS (SELECT c_nationkey AS request, c_custkey AS site, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer), w AS (SELECT s_nationkey AS request, s_suppkey AS win, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT request, site, win, CAST(row_number() OVER (PARTITION BY request ORDER BY site, win) AS INTEGER) AS plan FROM s JOIN w USING (request) WHERE s.n <= 4 AND w.n <= 4""")
def plan_grid(spark, sf_dir):
    """Plans of a request: its sites by its windows."""
    return K.plan_grid(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("request"), F.col("c_custkey").alias("site")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("request"), F.col("s_suppkey").alias("win")))


@query("""WITH b AS (SELECT s_nationkey AS host, count(*) AS busy FROM supplier WHERE s_suppkey % 9 = 0 GROUP BY 1), q AS (SELECT c_custkey, c_nationkey AS host, c_custkey % 6 = 0 AS anon, c_nationkey % 8 = 0 AS draining FROM customer)
SELECT c_custkey, CAST(CASE WHEN anon THEN 401 WHEN draining OR coalesce(busy, 0) >= 2 THEN 503 ELSE 202 END AS INTEGER) AS answer, CAST(CASE WHEN anon THEN NULL WHEN draining THEN 120 WHEN coalesce(busy, 0) >= 2 THEN 180 END AS INTEGER) AS retry_s FROM q LEFT JOIN b USING (host)""")
def admission(spark, sf_dir):
    """Requests taken or sent away by what their host runs."""
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("host"), F.when(k % 6 > 0, F.col("c_name")).alias("user"), (F.col("c_nationkey") % 8 == 0).alias("draining"))
    running = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("host"), F.when(F.col("s_suppkey") % 9 == 0, "running").otherwise("done").alias("state"))
    return K.admitted(q, running).select("c_custkey", "answer", "retry_s")


@query("""WITH a AS (SELECT o_custkey % 5 AS store, o_custkey AS plan, o_orderkey % 4 AS name, CAST(o_totalprice AS BIGINT) AS bytes, o_orderdate AS used FROM orders), p AS (SELECT store, plan, sum(bytes) AS bytes, max(used) AS used FROM a GROUP BY 1, 2), b AS (SELECT *, sum(bytes) OVER (PARTITION BY store ORDER BY used DESC, plan DESC ROWS UNBOUNDED PRECEDING) <= 4000000 AS kept FROM p),
q AS (SELECT c_custkey % 5 AS store, c_custkey AS plan, c_nationkey % 4 AS name FROM customer), h AS (SELECT DISTINCT store, plan, name FROM a)
SELECT q.plan, q.name, CASE WHEN kept THEN 'present' WHEN kept IS NOT NULL THEN 'evicted' ELSE 'absent' END AS state FROM q LEFT JOIN (SELECT h.*, kept FROM h JOIN b USING (store, plan)) k ON k.store = q.store AND k.plan = q.plan AND k.name = q.name""")
def artefact_states(spark, sf_dir):
    """Layers of plans in stores of a budget: there, gone to make room, or never there."""
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("store"), F.col("o_custkey").alias("plan"), (F.col("o_orderkey") % 4).alias("name"), F.round("o_totalprice").cast("long").alias("bytes"), F.col("o_orderdate").alias("used"))
    q = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("store"), F.col("c_custkey").alias("plan"), (F.col("c_nationkey") % 4).cast("long").alias("name"))
    return K.artefact_state(q, a, 4e6).select("plan", F.col("name").cast("int").alias("name"), "state")


@query("""SELECT c_custkey, coalesce((SELECT string_agg(n_name, ';' ORDER BY n_nationkey DESC) FROM nation WHERE n_nationkey > rev), '') AS notes FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN c_custkey % 27 END AS rev FROM customer)""")
def changes_since(spark, sf_dir):
    """What changed in the engine since a plan was made."""
    plans = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey") % 27).alias("rev"))
    revisions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rev"), F.col("n_name").alias("note"))
    return K.changes_since(plans, revisions).select("c_custkey", F.array_join("notes", ";").alias("notes"))


@query("""WITH n AS (SELECT o_custkey AS zone, o_orderstatus || o_orderpriority AS joins, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / 1e6, 6) END AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / 1e6, 6) END, 0) DESC, o_orderstatus || o_orderpriority) AS n FROM orders)
SELECT c_custkey AS zone, joins, score AS destination FROM customer LEFT JOIN n ON zone = c_custkey AND n = 1""")
def neck_notes(spark, sf_dir):
    """Neck zones with the note of the same key."""
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("zone"), F.concat("o_orderstatus", "o_orderpriority").alias("joins"), F.when(F.col("o_orderkey") % 5 > 0, F.round(F.col("o_totalprice") / 1e6, 6)).alias("score"))
    return K.noted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("zone")), notes, "zone")


def _dest_sql(lat, lon, deg, km):
    d, b, a = f"({km} / 6371.0::DOUBLE)", f"radians({deg})", f"radians({lat})"
    la = f"asin(sin({a}) * cos({d}) + cos({a}) * sin({d}) * cos({b}))"
    return f"degrees({la})", f"degrees(radians({lon}) + atan2(sin({b}) * sin({d}) * cos({a}), cos({d}) - sin({a}) * sin({la})))"


_M, _SH = _dest_sql("lat", "lon", "down", "0.045::DOUBLE"), _dest_sql("lat", "lon", "down", "0.07::DOUBLE")
_RT, _LT = (_dest_sql("mlat", "mlon", f"((down + {t}) % 360)", "0.025::DOUBLE") for t in (90, 270))


@query(f"""WITH e AS (SELECT event_id, 46 + (event_id % 600) / 100.0::DOUBLE AS lat, -79 + (event_id % 700) / 100.0::DOUBLE AS lon, (coalesce(CASE WHEN event_id % 8 > 0 THEN event_id * 29 % 360 END, 270)::DOUBLE + 180) % 360 AS down FROM events), m AS (SELECT *, {_M[0]} AS mlat, {_M[1]} AS mlon FROM e)
SELECT event_id, 'shooter' AS role, round({_SH[0]}, 6) AS lat, round({_SH[1]}, 6) AS lon FROM m UNION ALL SELECT event_id, 'wick', round(mlat, 6), round(mlon, 6) FROM m UNION ALL SELECT event_id, 'right', round({_RT[0]}, 6), round({_RT[1]}, 6) FROM m UNION ALL SELECT event_id, 'left', round({_LT[0]}, 6), round({_LT[1]}, 6) FROM m""")
def scent_points(spark, sf_dir):
    """Shooter and scent wicks downwind of every caller."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.explode(G.scent_points(46 + i % 600 / 100.0, -79 + i % 700 / 100.0, F.when(i % 8 > 0, i * 29 % 360))).alias("p"))
    return e.select("event_id", "p.role", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query(f"""WITH p AS (SELECT l_orderkey AS o, l_suppkey % 90 / 10.0::DOUBLE - 75 AS x, 45 + l_partkey % 90 / 10.0::DOUBLE AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)),
s AS (SELECT a.o, a.n, radians(b.x - a.x) * (2 + sin(radians(a.y)) + sin(radians(b.y))) AS t FROM p a JOIN p b ON b.o = a.o AND b.i = a.i % a.n + 1) SELECT o AS l_orderkey, CASE WHEN min(n) < 3 THEN 0.0 ELSE round(abs(sum(t)) * 6371.0::DOUBLE * 6371.0::DOUBLE / 2, {3}) END AS km2 FROM s GROUP BY 1""")
def ring_km2(spark, sf_dir):
    """Areas of drawn rings on the sphere."""
    x, y = F.col("l_suppkey") % 90 / 10.0 - 75, 45 + F.col("l_partkey") % 90 / 10.0
    rings = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", x.alias("x"), y.alias("y")))).alias("ring"))
    return rings.select("l_orderkey", F.round(G.ring_km2(F.col("ring")), 3).alias("km2"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 6 WHEN 0 THEN 'x' ELSE CAST(l_partkey % 120 AS VARCHAR) END AS a, CASE WHEN l_suppkey % 7 > 0 THEN CAST(l_suppkey % 200 AS VARCHAR) END AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
v AS (SELECT l_orderkey, n, try_cast(a AS DOUBLE) AS lat, try_cast(b AS DOUBLE) AS lon FROM p WHERE n <= 4), g AS (SELECT * FROM v WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180), o AS (SELECT DISTINCT l_orderkey FROM p)
SELECT l_orderkey, coalesce(string_agg(CAST(CAST(lat AS INTEGER) AS VARCHAR) || '/' || CAST(CAST(lon AS INTEGER) AS VARCHAR), ';' ORDER BY n), '48/-78') AS sites FROM o LEFT JOIN g USING (l_orderkey) GROUP BY 1""")
def request_sites(spark, sf_dir):
    """Sites of requests: the good ones of the first four, else the centre."""
    from cellweave.functions import decode as D

    a = F.when(F.col("l_suppkey") % 6 == 0, "x").otherwise((F.col("l_partkey") % 120).cast("string"))
    b = F.when(F.col("l_suppkey") % 7 > 0, (F.col("l_suppkey") % 200).cast("string"))
    raw = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(a, b).alias("p")))).alias("s"))
    sites = D.sites_of(F.transform("s", lambda x: x["p"]), F.lit(48.0), F.lit(-78.0))
    text = F.transform(sites, lambda x: F.concat(x["lat"].cast("int").cast("string"), F.lit("/"), x["lon"].cast("int").cast("string")))
    return raw.select("l_orderkey", F.array_join(text, ";").alias("sites"))


_KINDS = ("roads", "trails", "rail", "waterways", "waterbodies", "builtup")
_TAGS = {"highway": ["track", "path", None, "steps"], "railway": ["rail", None, "abandoned"], "waterway": [None, "canal", "drain"], "natural": ["wood", "water", None], "landuse": [None, "reservoir", "quarry", "forest"], "building": [None, None, "yes"], "leisure": ["park", None]}


def _tag_sql(name):
    v = _TAGS[name]
    return f"([{', '.join('NULL' if x is None else repr(x) for x in v)}])[event_id // {len(name)} % {len(v)} + 1] AS {name}"


@query(f"""WITH e AS (SELECT event_id, {', '.join(_tag_sql(n) if n != 'natural' else _tag_sql(n).replace('AS natural', 'AS nat') for n in _TAGS)} FROM events)
SELECT event_id, coalesce(highway = 'track', FALSE) AS roads, coalesce(highway = 'path', FALSE) AS trails, coalesce(railway = 'rail', FALSE) AS rail, coalesce(waterway = 'canal', FALSE) AS waterways, coalesce(nat = 'water', FALSE) OR coalesce(landuse = 'reservoir', FALSE) AS waterbodies,
coalesce(landuse = 'quarry', FALSE) OR building IS NOT NULL OR coalesce(leisure = 'park', FALSE) AS builtup FROM e""")
def feature_kinds(spark, sf_dir):
    """Kinds of mapped features by their tags."""
    from cellweave.sources.readers import is_feature

    tags = {n: F.element_at(F.array(*[F.lit(x) for x in v]), (F.expr(f"event_id div {len(n)}") % len(v)).cast("int") + 1) for n, v in _TAGS.items()}
    return table(spark, sf_dir, "events").select("event_id", *[is_feature(k, tags.__getitem__).alias(k) for k in _KINDS])


@query("""WITH i AS (SELECT l_suppkey % 5 AS site, l_linenumber % 3 AS win, (['areas', 'routes', 'camps', 'legend'])[l_partkey % 4 + 1] AS key, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY site, win, l_orderkey, l_linenumber, l_partkey, l_suppkey, q) - 1 AS pos FROM i WHERE key <> 'legend' AND NOT (site = 1 AND win = 2)) SELECT key, site, win, pos, '{"q":' || CAST(q AS VARCHAR) || '}' AS json FROM n""")
def list_merge(spark, sf_dir):
    """Lists of all plans end to end, each item with its plan."""
    from pyspark.sql import Window

    from cellweave.plans import merge as M

    key = F.element_at(F.array(*[F.lit(x) for x in ("areas", "routes", "camps", "legend")]), (F.col("l_partkey") % 4).cast("int") + 1)
    q = F.col("l_quantity").cast("long")
    i = table(spark, sf_dir, "lineitem").withColumns({"site": F.col("l_suppkey") % 5, "win": F.col("l_linenumber") % 3, "key": key, "q": q})
    w = Window.partitionBy("site", "win", "key").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q")
    items = i.select("site", "win", "key", (F.row_number().over(w) - 1).alias("pos"), F.to_json(F.struct("q")).alias("json"))
    plans = i.select("site", "win").distinct().withColumn("ok", ~((F.col("site") == 1) & (F.col("win") == 2)))
    return M.merge_lists(items, plans)


@query(f"""WITH {_SITES_SQL}, k AS (SELECT area, string_agg(line, chr(10) ORDER BY line) AS lines FROM (SELECT area, '- ' || legend || ': ' || CAST(count(*) AS VARCHAR) AS line FROM s GROUP BY area, legend) GROUP BY 1),
a AS (SELECT n_nationkey AS area, n_nationkey * 1.5::DOUBLE AS km2, n_nationkey / 30.0::DOUBLE AS score FROM nation)
SELECT area, '## Area ' || CAST(area AS VARCHAR) || ': ' || printf('%.1f', km2) || ' km2, score ' || printf('%.2f', score) || ' (' || CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.5 THEN 'moderate' ELSE 'low' END || ')' || CASE WHEN score > 0.3 THEN chr(10) || '- strong ground' ELSE '' END || CASE WHEN area % 2 = 0 THEN chr(10) || '- far from roads' ELSE '' END || coalesce(chr(10) || lines, '') AS lines FROM a LEFT JOIN k USING (area)""")
def brief_lines(spark, sf_dir):
    """The brief of each area as Markdown."""
    from cellweave.functions.decode import confidence_band
    from cellweave.plans import merge as M

    n = F.col("n_nationkey")
    score = n / 30.0
    areas = table(spark, sf_dir, "nation").select(n.alias("area"), (n * 1.5).alias("km2"), score.alias("score"), confidence_band(score).alias("band"), F.array(F.when(score > 0.3, "strong ground"), F.when(n % 2 == 0, "far from roads")).alias("reasons"))
    return M.brief(areas, _sites(spark, sf_dir))

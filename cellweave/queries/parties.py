"""Camps of groups of areas and the gate of a party without a boat."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.core import query, table
from cellweave.plans import camps as C

_KM = "2 * 6371.0 * asin(sqrt(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2)))"
_PLACES = """a AS (SELECT s_suppkey AS rank, 46 + (s_suppkey * 37 % 1000) / 500.0::DOUBLE AS lat, -78 + (s_suppkey * 61 % 997) / 400.0::DOUBLE AS lon FROM supplier),
r AS (SELECT c_custkey AS id, 46 + (c_custkey * 53 % 991) / 500.0::DOUBLE AS lat, -78 + (c_custkey * 17 % 983) / 400.0::DOUBLE AS lon FROM customer WHERE c_mktsegment = 'BUILDING')"""


@query(f"""WITH RECURSIVE {_PLACES}, e AS (SELECT a.rank AS x, b.rank AS y FROM a, a b WHERE a.rank <> b.rank AND {_KM.format(a='a', b='b')} < 15),
k(id, lab) USING KEY (id) AS (SELECT rank, rank FROM a UNION SELECT e.y, min(k.lab) FROM k JOIN e ON k.id = e.x JOIN recurring.k z ON z.id = e.y WHERE k.lab < z.lab GROUP BY e.y),
m AS (SELECT lab, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM k JOIN a ON a.rank = k.id GROUP BY lab), s AS (SELECT m.lab, arg_min({{'lat': r.lat, 'lon': r.lon}}, {{'km': {_KM.format(a='m', b='r')}, 'id': r.id}}) AS site FROM m, r GROUP BY m.lab),
c AS (SELECT m.lab, n, site.lat AS lat, site.lon AS lon, row_number() OVER (ORDER BY n DESC, m.lab) AS i FROM m JOIN s ON s.lab = m.lab),
l AS (SELECT *, CASE WHEN i <= 26 THEN chr(CAST(64 + i AS INTEGER)) ELSE chr(CAST(65 + (i - 27) // 26 AS INTEGER)) || chr(CAST(65 + (i - 27) % 26 AS INTEGER)) END AS camp FROM c)
SELECT a.rank, camp, round({_KM.format(a='l', b='a')}, 1) AS km, n AS areas, round(l.lat, 5) AS lat, round(l.lon, 5) AS lon, 'road' AS access FROM l JOIN k ON k.lab = l.lab JOIN a ON a.rank = k.id""")
def camp_sites(spark, sf_dir):
    """For each area its camp, at the road nearest to the middle of the areas that share it, and the way to pack in."""
    k = F.col("s_suppkey")
    areas = table(spark, sf_dir, "supplier").select(k.alias("rank"), (46 + (k * 37 % 1000) / 500.0).alias("lat"), (-78 + (k * 61 % 997) / 400.0).alias("lon"))
    c = F.col("c_custkey")
    roads = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(c.alias("id"), (46 + (c * 53 % 991) / 500.0).alias("lat"), (-78 + (c * 17 % 983) / 400.0).alias("lon"))
    camps, packin = C.camp_sites(areas, roads)
    return packin.join(camps, "camp").select("rank", "camp", "km", "areas", "lat", "lon", "access")


@query("""WITH a AS (SELECT c_nationkey AS plan, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'excluded' ELSE 'ok' END AS status, c_nationkey % 3 = 0 AS has_boat FROM customer),
x AS (SELECT plan, rank, id, CASE WHEN id % 5 = 0 THEN 'boat' ELSE 'ford' END AS kind FROM a WHERE id % 2 = 0 OR id % 5 = 0), h AS (SELECT *, status = 'ok' AND NOT has_boat AND id % 5 = 0 AS hit FROM a),
n AS (SELECT *, CASE WHEN bool_or(hit) OVER (PARTITION BY plan) THEN row_number() OVER (PARTITION BY plan ORDER BY status <> 'ok' OR hit, rank) ELSE rank END AS new FROM h)
SELECT 'area' AS kind, plan, id, new AS rank, CASE WHEN hit THEN 'excluded' ELSE status END AS status FROM n UNION ALL SELECT 'crossing', n.plan, n.id, new, x.kind FROM n JOIN x ON x.id = n.id
UNION ALL SELECT 'site', n.plan, o_orderkey, new, NULL FROM n JOIN orders ON o_custkey = n.id UNION ALL SELECT 'route', n.plan, o_orderkey, new, o_orderpriority FROM n JOIN orders ON o_custkey = n.id WHERE o_orderstatus = 'O'""")
def boat_gate(spark, sf_dir):
    """Areas, crossings, sites and routes of all plans after the gate, with the same new ranks."""
    c = table(spark, sf_dir, "customer").withColumns({"plan": F.col("c_nationkey"), "id": F.col("c_custkey")})
    rank = F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("c_acctbal"), "id"))
    a = c.select("plan", "id", rank.alias("rank"), F.when(F.col("c_mktsegment") == "MACHINERY", "excluded").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    crossings = a.where("id % 2 = 0 or id % 5 = 0").select("plan", "rank", "id", F.when(F.col("id") % 5 == 0, "boat").otherwise("ford").alias("kind"))
    orders = table(spark, sf_dir, "orders").join(a.select("plan", "rank", F.col("id").alias("o_custkey")), "o_custkey").select("plan", "rank", F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus")
    out = C.boat_gate(a, crossings, F.col("plan") % 3 == 0, {"sites": orders, "routes": orders.where("o_orderstatus = 'O'")})
    row = lambda name, kind, status: out[name].select(F.lit(kind).alias("kind"), "plan", F.col("id").cast("long").alias("id"), F.col("rank").cast("long").alias("rank"), status.alias("status"))
    every = row("areas", "area", F.col("status")).unionByName(row("crossings", "crossing", F.col("kind")))
    return every.unionByName(row("sites", "site", F.lit(None).cast("string"))).unionByName(row("routes", "route", F.col("o_orderpriority")))

"""Codes, rules, gates and scores."""

from pyspark.sql import functions as F

from cellweave.core import query
from cellweave.functions import decode as D
from cellweave.functions import season as S
from cellweave.queries.layers import LAYERS_SQL, layers


def _values(rows) -> str:
    q = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)


_CODES = ("EN", "BP", "SB", "PT", "ZZ", "ER", "PG", "BJ")
_RUN = "element_at(array('EN','BP','SB','PT','ZZ','ER','PG','BJ'), cast(p_partkey % 8 as int) + 1)"
_PARTS = lambda n, m: f"(['EN','BP','SB','PT','ZZ','ER','PG','BJ'])[CAST((p_partkey // {n}) % 8 + 1 AS INTEGER)]"


@query(f"""WITH s(code, v) AS (VALUES {_values(D.SPECIES_BROWSE.items())}), p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN {_PARTS(1, 0)} WHEN 2 THEN {_PARTS(1, 0)} || {_PARTS(8, 1)} WHEN 3 THEN {_PARTS(1, 0)} || {_PARTS(8, 1)} || {_PARTS(64, 2)} ELSE {_PARTS(1, 0)} || {_PARTS(8, 1)} || {_PARTS(64, 2)} || 'BPB' END AS run FROM part),
c AS (SELECT p_partkey, run, i, CASE i WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END AS w, substring(run, CAST(2 * i - 1 AS BIGINT), 2) AS code FROM p, range(1, 4) t(i) WHERE i <= length(run) // 2),
v AS (SELECT p_partkey, sum(w * coalesce(v, 0.10)) / sum(w) AS browse FROM c LEFT JOIN s USING (code) GROUP BY 1)
SELECT p_partkey, run, round(coalesce(browse, 0), 6) AS browse FROM p LEFT JOIN v USING (p_partkey)""")
def stand_species_score(spark, sf_dir):
    """Browse value of species runs, dominant first."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    codes = F.array(*[F.lit(x) for x in _CODES])
    at = lambda n: F.element_at(codes, (F.expr(f"p_partkey div {n}") % 8).cast("int") + 1)
    m = F.col("p_size") % 5
    run = F.when(m == 0, "").when(m == 1, at(1)).when(m == 2, F.concat(at(1), at(8))).when(m == 3, F.concat(at(1), at(8), at(64))).otherwise(F.concat(at(1), at(8), at(64), F.lit("BPB")))
    return p.select("p_partkey", run.alias("run")).withColumn("browse", F.round(D.species_browse(F.col("run")), 6))


@query("""WITH p AS (SELECT p_partkey, (['30', 'JIN', ' vir ', '5050', '120', '', 'X1', '70'])[CAST(p_partkey % 8 + 1 AS INTEGER)] AS age, (['1', '2', '4', '7', '9'])[CAST(p_partkey % 5 + 1 AS INTEGER)] AS h, (['A', 'D', 'F', 'S'])[CAST(p_partkey % 4 + 1 AS INTEGER)] AS sl FROM part)
SELECT p_partkey, CAST(CASE WHEN upper(trim(age)) IN ('JIN', 'JIR') THEN 40 WHEN upper(trim(age)) IN ('VIN', 'VIR') THEN 100 WHEN regexp_full_match(trim(age), '[0-9]+') THEN CAST(CASE WHEN length(trim(age)) = 4 THEN substring(trim(age), 1, 2) ELSE trim(age) END AS INTEGER) ELSE 0 END AS INTEGER) AS age,
CASE h WHEN '1' THEN 24.0 WHEN '2' THEN 19.5 WHEN '4' THEN 9.5 WHEN '7' THEN 1.0 END::DOUBLE AS height_m, CASE sl WHEN 'A' THEN 1.5 WHEN 'D' THEN 23.0 WHEN 'F' THEN 50.0 END::DOUBLE AS slope_pct, CASE sl WHEN 'A' THEN 0.9 WHEN 'D' THEN 0.32 END::DOUBLE AS closure FROM p""")
def stand_decode(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs)).cast("int") + 1)
    age, sl = pick(["30", "JIN", " vir ", "5050", "120", "", "X1", "70"]), pick(["A", "D", "F", "S"])
    return p.select("p_partkey", D.stand_age(age).cast("int").alias("age"), D.lookup(D.HEIGHT_M, pick(["1", "2", "4", "7", "9"])).alias("height_m"), D.lookup(D.SLOPE_PCT, sl).alias("slope_pct"), D.lookup(D.CLOSURE, sl).alias("closure"))


_PURPOSES = ["Abri sommaire en forêt", "  VILLÉGIATURE  (chalet)", "Résidence   principale", "Pourvoirie sans droits exclusifs", "Tour de télécommunication", "", "Éolienne"]


@query(f"""WITH p AS (SELECT p_partkey, ([{', '.join(f"'{x}'" for x in _PURPOSES)}])[CAST(p_partkey % 7 + 1 AS INTEGER)] AS purpose FROM part), f AS (SELECT *, trim(regexp_replace(lower(strip_accents(purpose)), '\\s+', ' ', 'g')) AS t FROM p)
SELECT p_partkey, CASE WHEN contains(t, 'abri sommaire') THEN 'abri_sommaire' WHEN contains(t, 'pourvoirie sans droits') THEN 'pourvoirie_camp' WHEN contains(t, 'villegiature') THEN 'villegiature' WHEN contains(t, 'residence principale') THEN 'residence' END AS kind FROM f""")
def lease_classify(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    purpose = F.element_at(F.array(*[F.lit(x) for x in _PURPOSES]), (F.col("p_partkey") % 7).cast("int") + 1)
    return p.select("p_partkey", D.lease_kind(purpose).alias("kind"))


_TEN = ["crown", "zec", "reserve_faunique", "refuge_faunique", "pourvoirie_exclusive", "unknown"]
_RES = ["quebec_resident", "non_resident_canada", "non_resident_foreign"]


@query(f"""WITH a(residency, tenure, rule) AS (VALUES {_values((r, t, v) for r, row in D.ACCESS.items() for t, v in row.items())}),
c AS (SELECT c_custkey, ([{', '.join(repr(x) for x in _RES)}])[CAST(r_regionkey % 3 + 1 AS INTEGER)] AS residency, ([{', '.join(repr(x) for x in _TEN)}])[CAST(c_custkey % 6 + 1 AS INTEGER)] AS tenure FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, c.residency, c.tenure, coalesce(rule, 'no') AS rule FROM c LEFT JOIN a ON a.residency = c.residency AND a.tenure = c.tenure""")
def access_matrix(spark, sf_dir):
    """Who may hunt where."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(k) % len(xs)).cast("int") + 1)
    c = c.select("c_custkey", pick(_RES, "r_regionkey").alias("residency"), pick(_TEN, "c_custkey").alias("tenure"))
    return c.withColumn("rule", D.access_rule(F.col("residency"), F.col("tenure")))


@query("""WITH c AS (SELECT c_nationkey, (['crown', 'zec', 'reserve_faunique', 'refuge_faunique', 'pourvoirie_exclusive'])[CAST(c_custkey % 5 + 1 AS INTEGER)] AS tenure, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, array_to_string(list_slice(list_sort(list(DISTINCT tenure)), 1, 8), ';') AS tenures, bool_or(tenure IN ('crown', 'zec')) AS diy_possible, coalesce(bool_or(tenure = 'refuge_faunique'), FALSE) AS verify, CAST(sum(n) AS BIGINT) AS patches FROM c GROUP BY 1""")
def legal_assessment(spark, sf_dir):
    """Tenures of an area and what follows for a resident."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ten = F.element_at(F.array(*[F.lit(x) for x in _TEN[:5]]), (F.col("c_custkey") % 5).cast("int") + 1)
    c = c.select("c_nationkey", ten.alias("tenure")).withColumn("rule", D.access_rule(F.lit("quebec_resident"), F.col("tenure")))
    return c.groupBy("c_nationkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("tenure")), 1, 8), ";").alias("tenures"), F.bool_or(F.col("rule") == "yes").alias("diy_possible"), F.bool_or(F.col("rule") == "verify").alias("verify"), F.count(F.lit(1)).alias("patches"))


@query("""SELECT o_orderkey, CASE WHEN hw IN ('motorway', 'trunk', 'primary') THEN 'artery' WHEN hw IN ('track', 'service') THEN 'track' ELSE 'road' END AS role, regexp_matches(tags, 'gravel|dirt|ground|unpaved|compacted|earth|sand|"tracktype"') AS unpaved
FROM (SELECT o_orderkey, (['Trunk', 'tertiary', 'track', 'SERVICE', 'path', ''])[CAST(o_orderkey % 6 + 1 AS INTEGER)] AS raw, lower(raw) AS hw, (['surface=Gravel', 'asphalt', 'x=fine_gravel', ''])[CAST(o_orderkey % 4 + 1 AS INTEGER)] AS t0, lower(t0) AS tags FROM orders)""")
def road_classes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % len(xs)).cast("int") + 1)
    return o.select("o_orderkey", D.road_role(pick(["Trunk", "tertiary", "track", "SERVICE", "path", ""])).alias("role"), D.unpaved(pick(["surface=Gravel", "asphalt", "x=fine_gravel", ""])).alias("unpaved"))


@query("""WITH s(source, max_lat, min_lat) AS (VALUES ('stands', 52.0, NULL), ('fire', NULL, NULL), ('north', NULL, 50.0), ('imagery', 47.4, 46.0)), b AS (SELECT s_suppkey, 46.5 + s_suppkey % 8 AS lo, 46.5 + s_suppkey % 8 + (s_acctbal + 1000) / 8000 AS hi FROM supplier)
SELECT s_suppkey, source, CASE WHEN lo >= max_lat THEN 'out' WHEN hi > max_lat THEN 'partial' WHEN hi <= min_lat THEN 'out' WHEN lo < min_lat THEN 'partial' ELSE 'in' END AS declared, s_suppkey % 3 > 0 AS measured, CASE WHEN s_suppkey % 3 > 0 THEN 'used' WHEN CASE WHEN lo >= max_lat THEN 'out' WHEN hi > max_lat THEN 'partial' WHEN hi <= min_lat THEN 'out' WHEN lo < min_lat THEN 'partial' ELSE 'in' END = 'out' THEN 'not covered' ELSE 'missing' END AS status FROM b, s""")
def coverage_manifest(spark, sf_dir):
    """Each source's declared coverage beside what was measured."""
    src = spark.createDataFrame([("stands", 52.0, None), ("fire", None, None), ("north", None, 50.0), ("imagery", 47.4, 46.0)], "source string, max_lat double, min_lat double")
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (46.5 + F.col("s_suppkey") % 8).alias("lo"), (46.5 + F.col("s_suppkey") % 8 + (F.col("s_acctbal") + 1000) / 8000).alias("hi"))
    m = b.crossJoin(F.broadcast(src)).withColumn("declared", D.coverage(F.col("max_lat"), F.col("min_lat"), F.col("lo"), F.col("hi")))  # four sources
    m = m.withColumn("measured", F.col("s_suppkey") % 3 > 0)
    return m.select("s_suppkey", "source", "declared", "measured", F.when(F.col("measured"), "used").when(F.col("declared") == "out", "not covered").otherwise("missing").alias("status"))


@query("""SELECT c_custkey, greatest(0.5, least(25.0, coalesce(TRY_CAST(raw AS DOUBLE), 6.0))) AS walk_km, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) ELSE 'other' END AS style
FROM (SELECT *, (['0', NULL, '4.5', 'far', '99', ' 3'])[CAST(c_custkey % 6 + 1 AS INTEGER)] AS raw FROM customer)""")
def request_coercion(spark, sf_dir):
    """Request values: clamps, defaults, white lists."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.element_at(F.array(F.lit("0"), F.lit(None), F.lit("4.5"), F.lit("far"), F.lit("99"), F.lit(" 3")), (F.col("c_custkey") % 6).cast("int") + 1)
    return c.select("c_custkey", D.clamped(raw, 6.0, 0.5, 25.0).alias("walk_km"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lower("c_mktsegment")).otherwise("other").alias("style"))


@query(f"""WITH {LAYERS_SQL}, a AS (SELECT zone, CASE WHEN zone % 11 = 0 THEN 1e6 ELSE min(d_road) * 30 END AS dr, CASE WHEN zone % 5 = 0 THEN zone % 9 * 1.0 END AS camp, zone % 2 = 0 AS atv, zone % 3 = 0 AS boat, zone % 13 = 0 AS unk FROM l GROUP BY zone),
b AS (SELECT *, CASE WHEN atv THEN 9.0 * 2.5 + 5 ELSE 9.0 END AS reach, CASE WHEN atv THEN 3.0 * 2.5 + 5 ELSE 3.0 END AS cr FROM a),
c AS (SELECT zone, CASE WHEN camp IS NOT NULL THEN CASE WHEN camp > cr THEN 'beyond range of camp' END WHEN unk THEN NULL WHEN dr >= 5e5 THEN CASE WHEN NOT boat THEN 'water-locked' END WHEN dr > reach * 1000 THEN 'beyond range of road' END AS reason FROM b) SELECT zone, reason IS NULL AS ok, reason FROM c""")
def capability_gate(spark, sf_dir):
    """Which areas a party can reach with what it has, and why not."""
    df, _ = layers(spark, sf_dir)
    z = F.col("zone")
    a = df.groupBy("zone").agg(F.min("d_road").alias("m")).withColumn("dr", F.when(z % 11 == 0, 1e6).otherwise(F.col("m") * 30))
    atv = z % 2 == 0
    ok, reason = D.capability(F.col("dr"), F.when(z % 5 == 0, (z % 9).cast("double")), D.reach_km(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False), atv), F.when(atv, 12.5).otherwise(3.0), z % 3 == 0, z % 13 == 0)
    return a.select("zone", ok.alias("ok"), reason.alias("reason"))


@query(f"""WITH {LAYERS_SQL}, n AS (SELECT zone, cls, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT zone, max(n) / sum(n) AS top, coalesce(sum(n) FILTER (WHERE cls = 80), 0) / sum(n) AS water FROM n GROUP BY 1),
c AS (SELECT zone, greatest(0.30, least(0.95, CASE WHEN zone % 2 = 0 THEN 0.60 ELSE 0.82 END + CASE WHEN top > 0.85 THEN -0.10 WHEN top < 0.55 THEN 0.06 ELSE 0 END + CASE WHEN water > 0.30 THEN -0.06 ELSE 0 END + CASE WHEN zone % 3 = 0 THEN 0.04 ELSE 0 END)) AS s FROM s)
SELECT zone, round(s, 6) AS score, CASE WHEN s >= 0.72 THEN 'high' WHEN s >= 0.5 THEN 'moderate' ELSE 'low' END AS band FROM c""")
def area_confidence(spark, sf_dir):
    df, _ = layers(spark, sf_dir)
    from cellweave.operators.zonal import mode_share

    m = mode_share(df, "zone", "cls").join(df.groupBy("zone").agg(F.avg((F.col("cls") == 80).cast("double")).alias("water")), "zone")
    s = m.withColumn("s", D.area_confidence(F.col("zone") % 2 == 0, F.col("share"), F.col("water"), F.col("zone") % 3 == 0))
    return s.select("zone", F.round("s", 6).alias("score"), D.confidence_band(F.col("s")).alias("band"))


@query("""SELECT event_id, round(greatest(0.35, least(0.9, CASE WHEN event_type = 'error' THEN 0.6 ELSE 0.55 + 0.30 * least(1.0, greatest(0.0, value / 100)) END)), 6) AS conf, CASE event_type WHEN 'view' THEN 'cover' WHEN 'click' THEN 'edge' WHEN 'purchase' THEN 'food' WHEN 'signup' THEN 'view' ELSE 'neck' END AS why FROM events""")
def site_explain(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    why = D.lookup({"view": "cover", "click": "edge", "purchase": "food", "signup": "view", "error": "neck"}, F.col("event_type"))
    return e.select("event_id", F.round(D.site_confidence(F.when(F.col("event_type") != "error", F.col("value") / 100)), 6).alias("conf"), why.alias("why"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN value END AS closed_m, CASE WHEN event_id % 11 = 0 THEN value END AS open_m, CASE WHEN event_id % 7 = 0 THEN value END AS bridge_m, CASE WHEN event_id % 3 > 0 THEN event_id % 6 END AS ord, CASE WHEN event_id % 2 = 0 THEN 'P' ELSE 'I' END AS flow, event_id % 29 = 0 AS hazard, (['stream', 'river', 'danger', 'shore'])[CAST(event_id % 4 + 1 AS INTEGER)] AS kind FROM events),
h AS (SELECT *, coalesce(closed_m <= 30, FALSE) AS c, coalesce(open_m <= 30, FALSE) AS o, coalesce(bridge_m <= 30, FALSE) AS b, CASE WHEN hazard THEN 'boat' WHEN ord >= 4 OR (ord >= 3 AND flow = 'P') THEN 'boat' WHEN ord IS NOT NULL THEN 'ford' END AS m FROM e)
SELECT event_id, CASE WHEN c THEN 'boat' WHEN o OR b THEN 'bridge' WHEN kind IN ('stream', 'river') AND m IS NOT NULL THEN m WHEN kind = 'stream' THEN 'ford' ELSE 'boat' END AS crossing, CASE WHEN c OR o OR b OR (kind IN ('stream', 'river') AND m IS NOT NULL) THEN 'measured' ELSE 'inferred' END AS basis FROM h""")
def crossing_grades(spark, sf_dir):
    """Water crossings by the best evidence at hand."""
    i = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = lambda k: F.when(i % k == 0, F.col("value"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("stream", "river", "danger", "shore")]), (i % 4).cast("int") + 1)
    out, basis = D.crossing(m(17), m(11), m(7), F.when(i % 3 > 0, i % 6), F.when(i % 2 == 0, "P").otherwise("I"), i % 29 == 0, kind)
    return e.select("event_id", out.alias("crossing"), basis.alias("basis"))


_SITES = ["rut_calling", "glassing", "saline_blind", "funnel", "thermal_refuge"]


@query(f"""WITH pw(phase, site, w) AS (VALUES {_values((p, s, w) for p, row in S.PHASE_SITES.items() for s, w in row.items())}), mw(method, site, w) AS (VALUES {_values((m, s, S.METHOD_SITES[m].get(s, 1.0)) for m in S.METHOD_SITES for s in _SITES)}),
p AS (SELECT n_nationkey AS party, 1 + n_nationkey % 8 AS n FROM nation), b AS (SELECT party, n, site, CASE site WHEN 'rut_calling' THEN greatest(2, least(8, n)) WHEN 'saline_blind' THEN ceil(n / 3.0) WHEN 'thermal_refuge' THEN 1 ELSE ceil(n / 2.0) END AS base, CASE site WHEN 'rut_calling' THEN 8 WHEN 'thermal_refuge' THEN 3 ELSE 4 END AS cap FROM p, (SELECT DISTINCT site FROM pw))
SELECT party, phase, method, site, CAST(greatest(1, least(cap, CASE WHEN pw.w * mw.w > 1 THEN ceil(base * (pw.w * mw.w)) ELSE greatest(1, floor(base * (pw.w * mw.w))) END)) AS INTEGER) AS n_sites FROM b JOIN pw USING (site) JOIN mw USING (site)""")
def site_counts(spark, sf_dir):
    """How many sites of each kind, by party, phase and method."""
    pw = spark.createDataFrame([(p, s, w) for p, row in S.PHASE_SITES.items() for s, w in row.items()], "phase string, site string, pw double")
    mw = spark.createDataFrame([(m, s, S.METHOD_SITES[m].get(s, 1.0)) for m in S.METHOD_SITES for s in _SITES], "method string, site string, mw double")
    p = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("party"), (1 + F.col("n_nationkey") % 8).alias("n"))
    b = p.crossJoin(F.broadcast(pw)).join(F.broadcast(mw), "site")  # small rule tables
    n, s = F.col("n"), F.col("site")
    base = F.when(s == "rut_calling", F.greatest(F.lit(2), F.least(F.lit(8), n))).when(s == "saline_blind", F.ceil(n / 3)).when(s == "thermal_refuge", F.lit(1)).otherwise(F.ceil(n / 2))
    w = F.col("pw") * F.col("mw")
    cap = F.when(s == "rut_calling", 8).when(s == "thermal_refuge", 3).otherwise(4)
    return b.select("party", "phase", "method", "site", F.least(cap, D.site_count(base, w, 99)).cast("int").alias("n_sites"))


@query("""WITH d AS (SELECT s_suppkey, s_nationkey % 4 AS ph, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 50 / 10.0 END AS surveyed, 46 + s_suppkey % 8 AS lat FROM supplier), e AS (SELECT *, coalesce(surveyed, CASE WHEN lat >= 52 THEN 0.6 WHEN lat >= 49 THEN 1.8 ELSE 3.2 END) AS per10 FROM d),
c AS (SELECT *, CASE WHEN per10 < 1.2 THEN 'low' WHEN per10 < 3 THEN 'moderate' ELSE 'high' END AS cls FROM e)
SELECT s_suppkey, cls, surveyed IS NULL AS is_estimate, round(least(1.0, CASE cls WHEN 'low' THEN 1.0 WHEN 'moderate' THEN 0.6 ELSE 0.3 END * CASE ph WHEN 0 THEN 1.35 WHEN 1 THEN 0.65 WHEN 2 THEN 0.45 ELSE 0.3 END), 6) AS calling, round(least(1.0, CASE cls WHEN 'low' THEN 0.3 WHEN 'moderate' THEN 0.6 ELSE 1.0 END * CASE ph WHEN 0 THEN 0.7 WHEN 1 THEN 1.3 WHEN 2 THEN 1.2 ELSE 1.1 END), 6) AS ambush FROM c""")
def strategy(spark, sf_dir):
    """Density sets the profile, the phase bends it."""
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    surveyed = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 50 / 10.0)
    per10 = F.coalesce(surveyed, D.density_prior(46 + F.col("s_suppkey") % 8))
    phases = ["seeking", "peak", "post", "outside"]
    ph = F.element_at(F.array(*[F.lit(x) for x in phases]), (F.col("s_nationkey") % 4).cast("int") + 1)
    cls = D.density_class(per10)
    at = lambda t, k, i: D.lookup({n: float(v[i]) for n, v in t.items()}, k)
    calling = F.least(F.lit(1.0), at(S.PROFILES, cls, 0) * at(S.PHASE_TACTICS, ph, 0))
    ambush = F.least(F.lit(1.0), at(S.PROFILES, cls, 1) * at(S.PHASE_TACTICS, ph, 1))
    return d.select("s_suppkey", cls.alias("cls"), surveyed.isNull().alias("is_estimate"), F.round(calling, 6).alias("calling"), F.round(ambush, 6).alias("ambush"))


@query("""WITH a AS (SELECT c_nationkey AS area, count(*) AS sites, sum(c_acctbal) / 10000 AS km2, count(*) FILTER (WHERE c_custkey % 5 = 0) AS callers FROM customer GROUP BY 1)
SELECT area, greatest(1, least(greatest(1, CAST(floor(km2 / 1.8) AS BIGINT)), sites)) AS capacity, greatest(1, least(greatest(1, CAST(floor(km2 / 1.8) AS BIGINT)), sites)) >= 4 AS fits, callers FROM a""")
def crew_plan(spark, sf_dir):
    """How many hunters an area holds at once."""
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("sites"), (F.sum("c_acctbal") / 10000).alias("km2"), F.count(F.when(F.col("c_custkey") % 5 == 0, 1)).alias("callers"))
    cap = F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.floor(F.col("km2") / 1.8)), F.col("sites")))
    return a.select("area", cap.alias("capacity"), (cap >= 4).alias("fits"), "callers")

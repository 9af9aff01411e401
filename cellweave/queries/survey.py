"""Stand, road and water classes, confidence of a whole area, hours and winds."""

from pyspark.sql import functions as F

from cellweave.core import query, table
from cellweave.functions import algebra as A
from cellweave.functions import survey as S
from cellweave.operators.zonal import ordered_means

_ORIGIN = ["CT", " br ", "PLR", "ES", None, "", "CPRS_U", "X"]
_TREAT = ["CP", "cea", "EPC", None, "CT"]
_COVER = ["R", "m", "F", None, "", "R "]
_SOIL, _DRAIN = ["7E", "1A", "7T", None], ["5", "20", "6", "40", None]
_YEARS = ["2004", "19985", "abcd", "1850", None, "2101", "1999-07"]


def _text(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _pick_sql(values, i):
    return f"({_text(values)})[CAST({i} AS BIGINT) % {len(values)} + 1]"


def _pick(values, i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int") + 1)


_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_STANDS_SQL = f"""s AS (SELECT o_orderkey, upper(trim({_pick_sql(_ORIGIN, 'o_orderkey')})) AS origin, upper(trim({_pick_sql(_TREAT, 'o_custkey')})) AS treat, upper(trim({_pick_sql(_COVER, 'o_orderkey // 3')})) AS cover,
 {_pick_sql(_SOIL, 'o_custkey // 2')} AS soil, {_pick_sql(_DRAIN, 'o_orderkey // 5')} AS drain, try_cast(substr({_pick_sql(_YEARS, 'o_orderkey')}, 1, 4) AS INTEGER) AS y1, try_cast(substr({_pick_sql(_YEARS, 'o_custkey')}, 1, 4) AS INTEGER) AS y2 FROM orders),
t AS (SELECT *, CAST(CASE WHEN origin IN {_IN(S.CUT_ORIGINS)} THEN 4 WHEN origin = 'BR' THEN 6 WHEN treat IN {_IN(S.PARTIAL_CUTS)} THEN 5 WHEN cover = 'R' THEN 1 WHEN cover = 'M' THEN 2 WHEN cover = 'F' THEN 3 WHEN soil LIKE '7%' AND substr(drain, 1, 1) IN ('4', '5', '6') THEN 7 END AS INTEGER) AS stand FROM s)"""


def _stands(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    third, half, fifth = F.expr("o_orderkey div 3"), F.expr("o_custkey div 2"), F.expr("o_orderkey div 5")
    stand = S.stand_class(_pick(_ORIGIN, k), _pick(_TREAT, c), _pick(_COVER, third), _pick(_SOIL, half), _pick(_DRAIN, fifth))
    return o.select("o_orderkey", "o_custkey", stand.alias("stand"))


@query(f"WITH {_STANDS_SQL}, y AS (SELECT o_orderkey, stand, CASE WHEN stand = 4 THEN y1 WHEN stand = 5 THEN y2 END AS y FROM t) SELECT o_orderkey, stand, CAST(CASE WHEN y > 1900 AND y < 2100 THEN y ELSE 0 END AS INTEGER) AS cut_year FROM y")
def stand_classes(spark, sf_dir):
    """Stands by origin, treatment, cover and, where there is no forest, peat."""
    s = _stands(spark, sf_dir)
    return s.select("o_orderkey", "stand", S.stand_cut_year(F.col("stand"), _pick(_YEARS, F.col("o_orderkey")), _pick(_YEARS, F.col("o_custkey"))).alias("cut_year"))


_SPECIES = {"resineux": {"cover": 0.9, "browse": -0.2}, "melange": {"browse": 1.4}, "tourbiere": {"browse": 0.35}, "coupe_recente": {"cover": 0.1}}


@query(f"WITH {_STANDS_SQL} SELECT o_orderkey, CASE stand WHEN 1 THEN 0.9 WHEN 2 THEN 0.55 WHEN 3 THEN 0.25 WHEN 4 THEN 0.1 WHEN 5 THEN 0.35 WHEN 6 THEN 0.1 WHEN 7 THEN 0.0 END::DOUBLE AS cover, CASE stand WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.3 WHEN 4 THEN 0.55 WHEN 5 THEN 0.45 WHEN 6 THEN 0.3 WHEN 7 THEN 0.35 END::DOUBLE AS browse FROM t")
def class_constants(spark, sf_dir):
    """Cover and browse of stands from a species' table, within 0..1, with fallbacks."""
    s = _stands(spark, sf_dir)
    return s.select("o_orderkey", S.class_constant(F.col("stand"), _SPECIES, "cover", S.STAND_COVER).alias("cover"), S.class_constant(F.col("stand"), _SPECIES, "browse", S.STAND_BROWSE).alias("browse"))


_FOREST, _ROUTE = ["CL1", "cl3-a", "05 x", "HN", None, "04", "02"], ["Autoroute", "Locale", None, "Route collectrice", "Régionale", "", "accès"]


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber, upper(coalesce({_pick_sql(_FOREST, 'l_partkey')}, '')) AS f, lower(coalesce({_pick_sql(_ROUTE, 'l_suppkey')}, '')) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p LIKE '%autoroute%' OR p LIKE '%nationale%' OR p LIKE '%régionale%' OR p LIKE '%regionale%' THEN 'artery' WHEN p LIKE '%collectrice%' THEN 'road' WHEN substr(f, 1, 3) IN ('CL1', 'CL2', 'CL3') OR substr(f, 1, 2) IN ('01', '02', '03') THEN 'road'
WHEN substr(f, 1, 3) IN ('CL4', 'CL5') OR substr(f, 1, 2) IN ('04', '05') THEN 'track' WHEN p LIKE '%locale%' THEN 'road' ELSE 'track' END AS road FROM e""")
def official_roads(spark, sf_dir):
    """Classes of the official road network."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.official_road(_pick(_FOREST, F.col("l_partkey")), _pick(_ROUTE, F.col("l_suppkey"))).alias("road"))


_WATER = ["river", "rapids", "ditch", None, "canal", "waterfall", "stream", "tidal_channel"]


@query(f"""WITH e AS (SELECT event_id, coalesce({_pick_sql(_WATER, 'event_id')}, '') AS w FROM events), c AS (SELECT event_id, CASE WHEN w IN ('rapids', 'tidal_channel', 'waterfall') THEN 'danger' WHEN w IN ('river', 'canal') THEN 'river' ELSE 'stream' END AS cls FROM e)
SELECT event_id, cls, CASE WHEN cls = 'danger' THEN 'river' ELSE cls END AS drawn FROM c""")
def waterway_classes(spark, sf_dir):
    cls, drawn = S.waterway(_pick(_WATER, F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", cls.alias("cls"), drawn.alias("drawn"))


@query("""WITH c AS (SELECT c_custkey AS i, CASE WHEN c_nationkey % 3 = 0 THEN 0.60 ELSE 0.66 END + CASE WHEN c_custkey % 2 = 0 THEN 0.06 ELSE -0.05 END + CASE WHEN c_custkey % 3 = 0 THEN 0.04 ELSE -0.06 END + CASE WHEN c_custkey % 5 = 0 THEN 0.08 ELSE 0 END + CASE WHEN c_custkey % 7 > 0 THEN 0.03 ELSE 0 END
 + CASE WHEN c_custkey % 11 > 0 THEN 0 ELSE -0.04 END + CASE WHEN c_custkey % 13 < 4 AND c_custkey % 13 >= 2 THEN -0.06 ELSE 0 END + CASE c_custkey % 4 WHEN 0 THEN 0.05 WHEN 1 THEN -0.05 ELSE 0 END AS s FROM customer),
b AS (SELECT i, round(greatest(0.30, least(0.95, CAST(s AS DOUBLE))), 2) AS score FROM c) SELECT i AS c_custkey, score, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.5 THEN 'moderate' ELSE 'low' END AS band FROM b""")
def overall_confidence(spark, sf_dir):
    """Confidence of a whole area from the sources at hand."""
    from cellweave.functions.decode import confidence_band

    i = F.col("c_custkey")
    every = lambda n: i % n == 0
    score = S.overall_confidence(F.col("c_nationkey") % 3 == 0, every(2), every(3), every(5), ~every(7), ~every(11), F.when(i % 13 < 4, i % 13), F.when(i % 4 < 2, every(4)))
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"), confidence_band(score).alias("band"))


@query("""WITH d AS (SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN value / 4 END), 1) AS t FROM events GROUP BY 1), w AS (SELECT *, CASE WHEN t IS NOT NULL THEN greatest(0.0, least(1.0, (t - 14) / 6)) END AS w FROM d)
SELECT user_id, t AS t_max, CASE WHEN w >= 0.66 THEN 'retreat' WHEN w >= 0.33 THEN 'partial' WHEN w IS NOT NULL THEN 'feeding' END AS midday FROM w""")
def expected_midday(spark, sf_dir):
    """Mean high of a window's days, and what it means for noon."""
    highs = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value") / 4).alias("t"))
    d = ordered_means(highs, "user_id", ["t"], ["event_id"]).withColumn("t", F.round(F.col("t") * 10) / 10)  # rounded as by the SQL: a mean a last bit below a half goes up
    return d.select("user_id", F.col("t").alias("t_max"), S.midday_class(F.when(F.col("t").isNotNull(), A.refuge_weight(F.col("t")))).alias("midday"))


@query("""WITH e AS (SELECT event_id, (event_id * 7 % 96) / 4.0 AS h, event_id % 5 = 0 AS warm, CASE WHEN event_id % 6 > 0 THEN event_id * 13 % 360 END AS opt, CASE WHEN event_id % 9 > 0 THEN event_id * 29 % 360 END AS wind FROM events)
SELECT event_id, CASE WHEN h < 6 THEN 'bedded' WHEN h < 9 THEN 'morning feeding' WHEN h < 13 THEN CASE WHEN warm THEN 'moving to shade' ELSE 'loafing' END WHEN h < 16.5 THEN CASE WHEN warm THEN 'refuge, then building' ELSE 'building' END WHEN h < 19 THEN 'evening feeding' ELSE 'night travel' END AS label,
CAST(CASE WHEN wind IS NULL THEN 0 WHEN h < 8 OR h > 16.5 THEN 2 WHEN opt IS NULL THEN 0 WHEN least(abs(opt - wind), 360 - abs(opt - wind)) <= 45 THEN 1 ELSE -1 END AS INTEGER) AS wind FROM e""")
def hour_winds(spark, sf_dir):
    """What an hour holds, and whether the wind fits a stand at it."""
    i = F.col("event_id")
    h = i * 7 % 96 / 4.0
    return table(spark, sf_dir, "events").select("event_id", S.hour_label(h, i % 5 == 0).alias("label"), S.wind_state(h, F.when(i % 6 > 0, i * 13 % 360), F.when(i % 9 > 0, i * 29 % 360)).alias("wind"))

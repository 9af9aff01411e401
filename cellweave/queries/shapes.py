"""Distance, morphology and connectivity queries."""

from pyspark.sql import functions as F

from cellweave.core import query
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.operators import shapes as S

C = f"WITH {CELLS_SQL}"
CR = f"WITH RECURSIVE {CELLS_SQL}"


def components_sql(mask: str, name: str = "comp") -> str:
    return f"""{name}_m AS (SELECT CAST(r AS BIGINT) * w + c AS id, r, c FROM cells, g WHERE {mask}),
{name}_e AS (SELECT a.id AS a, b.id AS b FROM {name}_m a JOIN {name}_m b ON a.r = b.r AND a.c = b.c - 1 UNION ALL SELECT b.id, a.id FROM {name}_m a JOIN {name}_m b ON a.r = b.r AND a.c = b.c - 1
 UNION ALL SELECT a.id, b.id FROM {name}_m a JOIN {name}_m b ON a.c = b.c AND a.r = b.r - 1 UNION ALL SELECT b.id, a.id FROM {name}_m a JOIN {name}_m b ON a.c = b.c AND a.r = b.r - 1),
{name}(id, lab) USING KEY (id) AS (SELECT id, id FROM {name}_m UNION SELECT e.b, min({name}.lab) FROM {name} JOIN {name}_e e ON {name}.id = e.a JOIN recurring.{name} x ON x.id = e.b WHERE {name}.lab < x.lab GROUP BY e.b)"""


@query(f"{C}, s AS (SELECT r AS sr, c AS sc FROM cells WHERE k < 3) SELECT r, c, round(sqrt(CAST(min((r - sr) * (r - sr) + (c - sc) * (c - sc)) AS DOUBLE)) * 40, 6) AS d_m FROM cells, s GROUP BY r, c")
def edt(spark, sf_dir):
    """Exact Euclidean distance to the nearest seed."""
    return S.euclidean(demo_cells(spark, sf_dir)[0].select("r", "c", "k"), F.col("k") < 3, "d", 40.0).select("r", "c", F.round("d", 6).alias("d_m"))


_KINDS = {0: 1.00, 1: 0.90, 2: 0.55, 3: 0.45}  # fixed values: weights of the lease classes


@query(f"""{C}, s AS (SELECT r AS sr, c AS sc, k % 4 AS kind FROM cells WHERE k < 4), d AS (SELECT r, c, kind, sqrt(CAST(min((r - sr) * (r - sr) + (c - sc) * (c - sc)) AS DOUBLE)) * 40 AS d FROM cells, s GROUP BY r, c, kind)
SELECT r, c, round(max(CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.55 ELSE 0.45 END * exp(-d / 1200)), 8) AS pressure FROM d GROUP BY r, c""")
def class_decay_pressure(spark, sf_dir):
    """Decay from the nearest site of each class, the strongest class counting."""
    df = demo_cells(spark, sf_dir)[0].select("r", "c", "k")
    for kind in _KINDS:
        df = S.euclidean(df, F.col("k") == kind, f"d{kind}", 40.0)
    return df.select("r", "c", F.round(F.greatest(*[w * F.exp(-F.col(f"d{k}") / 1200) for k, w in _KINDS.items()]), 8).alias("pressure"))


_DIST = lambda cond: f"SELECT a.r, a.c, min(abs(a.r - s.r) + abs(a.c - s.c)) AS d FROM cells a, (SELECT r, c FROM cells WHERE {cond}) s GROUP BY a.r, a.c"


@query(f"{C}, d AS ({_DIST('k < 3')}) SELECT r, c, CAST(d AS INTEGER) AS steps, d <= 2 AS grown FROM d")
def dilate(spark, sf_dir):
    df = demo_cells(spark, sf_dir)[0].select("r", "c", (F.col("k") < 3).alias("m"))
    return S.dilate(S.city_block(df, F.col("m"), "steps"), "m", "grown", 2).select("r", "c", "steps", "grown")


@query(f"""{C}, z AS (SELECT r, c, k < 70 AS m FROM cells), p AS (SELECT t.* FROM z t), off AS (SELECT * FROM (VALUES (0,0),(0,1),(1,0),(0,-1),(-1,0)) o(dr, dc)),
er AS (SELECT a.r, a.c, count(*) FILTER (WHERE b.m) = 5 AS m FROM z a, off JOIN z b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2),
op AS (SELECT a.r, a.c, coalesce(bool_or(b.m), FALSE) AS m FROM z a, off JOIN er b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2),
di AS (SELECT a.r, a.c, coalesce(bool_or(b.m), FALSE) AS m FROM z a, off JOIN z b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2),
cl AS (SELECT a.r, a.c, count(*) FILTER (WHERE b.m) = 5 AS m FROM z a, off JOIN di b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2)
SELECT op.r, op.c, op.m AS opened, cl.m AS closed FROM op JOIN cl USING (r, c)""")
def open_close(spark, sf_dir):
    df, side = demo_cells(spark, sf_dir)
    df = df.select("r", "c", (F.col("k") < 70).alias("m"))
    df = S.closed(S.opened(df, "m", "opened", 1, (side, side)), "m", "closed", 1, (side, side))
    return df.select("r", "c", "opened", "closed")


@query(f"{CR}, {components_sql('k < 50')} SELECT r, c, lab AS label FROM comp JOIN comp_m USING (id)")
def components(spark, sf_dir):
    df, side = demo_cells(spark, sf_dir)
    return S.labels(df, F.col("k") < 50, "label", side)


@query(f"{CR}, {components_sql('k < 50')} SELECT lab AS label, count(*) AS cells, round(count(*) * 1600 / 1e6, 6) AS km2, round(avg(r), 6) AS mid_r, round(avg(c), 6) AS mid_c, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM comp JOIN comp_m USING (id) GROUP BY lab HAVING count(*) >= 3")
def component_sizes(spark, sf_dir):
    df, side = demo_cells(spark, sf_dir)
    found = S.labels(df, F.col("k") < 50, "label", side)
    out = found.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.round(F.count(F.lit(1)) * 1600 / 1e6, 6).alias("km2"), F.round(F.avg("r"), 6).alias("mid_r"), F.round(F.avg("c"), 6).alias("mid_c"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return out.where("cells >= 3")


@query(f"{CR}, {components_sql('k < 60')}, seed AS (SELECT min(id) AS id FROM comp_m WHERE r >= 10) SELECT r, c FROM comp JOIN comp_m USING (id) WHERE lab = (SELECT lab FROM comp JOIN seed USING (id))")
def seed_component(spark, sf_dir):
    """The ground that hangs together with a seed."""
    df, side = demo_cells(spark, sf_dir)
    first = df.where("k < 60 AND r >= 10").agg(F.min(F.col("r").cast("long") * side + F.col("c"))).head()[0]
    return S.seed_component(S.labels(df, F.col("k") < 60, "label", side), "label", first // side, first % side).select("r", "c")


@query(f"{CR}, {components_sql('k >= 60')}, outer_l AS (SELECT DISTINCT lab FROM comp JOIN comp_m USING (id), g WHERE r = 0 OR c = 0 OR r = w - 1 OR c = w - 1), open_c AS (SELECT r, c FROM comp JOIN comp_m USING (id) WHERE lab IN (SELECT lab FROM outer_l)) SELECT cells.r, cells.c, o.r IS NULL AS filled FROM cells LEFT JOIN open_c o ON o.r = cells.r AND o.c = cells.c")
def fill_holes(spark, sf_dir):
    df, side = demo_cells(spark, sf_dir)
    return S.filled(df.select("r", "c", (F.col("k") < 60).alias("m")), "m", "filled", (side, side)).select("r", "c", "filled")

"""Neighbourhood queries."""

from pyspark.sql import functions as F

from cellweave.core import query
from cellweave.functions import algebra as A
from cellweave.grid import CELLS_SQL, demo_cells
from cellweave.operators import focal as O
from cellweave.queries.layers import LAYERS_SQL, cl, layers, nz

C = f"WITH {CELLS_SQL}"
L = f"WITH {LAYERS_SQL}"


def r9(x, name):
    return F.round(x, 9).alias(name)


def along_sql(src: str, out: str, axis: str, lo: int, hi: int, fn: str) -> str:
    """CTEs: fn over a window of column v along an axis with reflected edges."""
    o = "c" if axis == "r" else "r"
    cols = lambda x: f"{x} AS r, c" if axis == "r" else f"r, {x} AS c"
    return f"""{out}_h AS (SELECT r, c, v FROM {src} UNION ALL SELECT {cols(f'-1 - {axis}')}, v FROM {src} WHERE {axis} < {lo} UNION ALL SELECT {cols(f'2 * w - 1 - {axis}')}, v FROM {src}, g WHERE {axis} >= w - {hi}),
{out}_x AS (SELECT r, c, {fn} OVER (PARTITION BY {o} ORDER BY {axis} RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) AS v FROM {out}_h),
{out} AS (SELECT t.* FROM {out}_x t, g WHERE {axis} >= 0 AND {axis} < w)"""


def box_sql(src: str, out: str, lo: int, hi: int, fn: str = "avg(v)") -> str:
    return along_sql(src, f"{out}_c", "c", lo, hi, fn) + ",\n" + along_sql(f"{out}_c", out, "r", lo, hi, fn)


def gauss_sql(src: str, out: str, sigma: float) -> str:
    """Weights applied by position in the list of the window."""
    w = O.gauss_weights(sigma)
    k = len(w) // 2
    ws = "[" + ", ".join(f"{x!r}::DOUBLE" for x in w) + "]"
    part = lambda s, o, axis: along_sql(s, f"{o}_l", axis, k, k, "list(v)") + f",\n{o} AS (SELECT r, c, list_inner_product(v, {ws}) AS v FROM {o}_l)"
    return part(src, f"{out}_c", "c") + ",\n" + part(f"{out}_c", out, "r")


_E = "e AS (SELECT r, c, elev AS v FROM cells)"


@query(f"{C}, {_E}, {box_sql('e', 'm', 2, 2)}, {box_sql('e', 'n', 2, 1)} SELECT m.r, m.c, round(m.v, 9) AS mean5, round(n.v, 9) AS mean4 FROM m JOIN n USING (r, c)")
def focal_mean(spark, sf_dir):
    """Moving mean of odd and even size with reflected edges."""
    df, side = demo_cells(spark, sf_dir)
    df = O.box_mean(O.box_mean(df.select("r", "c", "elev"), "elev", "a", (side, side), 5), "elev", "b", (side, side), 4)
    return df.select("r", "c", r9(F.col("a"), "mean5"), r9(F.col("b"), "mean4"))


@query(f"{C}, {_E}, {box_sql('e', 'm', 3, 3, 'max(v)')} SELECT r, c, v AS max7 FROM m")
def focal_max(spark, sf_dir):
    df, side = demo_cells(spark, sf_dir)
    return O.box_max(df.select("r", "c", "elev"), "elev", "max7", (side, side), 7).select("r", "c", "max7")


@query(f"{C}, {_E}, {gauss_sql('e', 's', 1.0)} SELECT r, c, round(v, 8) AS smooth FROM s")
def gaussian_smooth(spark, sf_dir):
    df, side = demo_cells(spark, sf_dir)
    return O.gaussian(df.select("r", "c", "elev"), "elev", "s", (side, side), 1.0).select("r", "c", F.round("s", 8).alias("smooth"))


@query(f"{L}, e AS (SELECT r, c, coalesce(ndvi, 0) AS v FROM l), m AS (SELECT r, c, CASE WHEN ndvi IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM l), {gauss_sql('e', 'a', 1.5)}, {gauss_sql('m', 'b', 1.5)} SELECT a.r, a.c, round(CASE WHEN b.v > 1e-9 THEN a.v / b.v END, 8) AS smooth FROM a JOIN b USING (r, c)")
def normalised_convolution(spark, sf_dir):
    """Gaussian carried over gaps: value and mask smoothed alike."""
    df, side = layers(spark, sf_dir)
    return O.gaussian_present(df.select("r", "c", "ndvi"), "ndvi", "s", (side, side), 1.5).select("r", "c", F.round("s", 8).alias("smooth"))


def _diff(col, axis, src, out, res=1):
    o = "c" if axis == "r" else "r"
    w = f"OVER (PARTITION BY {o} ORDER BY {axis})"
    return f"CASE WHEN lag({col}) {w} IS NULL THEN lead({col}) {w} - {col} WHEN lead({col}) {w} IS NULL THEN {col} - lag({col}) {w} ELSE (lead({col}) {w} - lag({col}) {w}) / 2 END / {res} AS {out}"


@query(f"""{C}, d AS (SELECT r, c, {_diff('elev', 'r', '', 'dy', 40.0)}, {_diff('elev', 'c', '', 'dx', 40.0)} FROM cells), a AS (SELECT r, c, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, degrees(atan2(dy, -dx)) + 360 AS a FROM d)
SELECT r, c, round(slope, 8) AS slope, round(a - 360 * floor(a / 360), 8) AS aspect, round((cos(radians(a - 360 * floor(a / 360))) + 1) / 2, 8) AS cool FROM a""")
def gradient_slope(spark, sf_dir):
    df, _ = demo_cells(spark, sf_dir)
    return O.slope_aspect(df.select("r", "c", "elev"), "elev", 40.0).select("r", "c", *[F.round(x, 8).alias(x) for x in ("slope", "aspect", "cool")])


@query(f"""{C}, d AS (SELECT r, c, {_diff('elev', 'r', '', 'a')}, {_diff('elev', 'c', '', 'b')} FROM cells), h AS (SELECT r, c, {_diff('a', 'r', '', 'aa')}, {_diff('a', 'c', '', 'ab')}, {_diff('b', 'c', '', 'bb')} FROM d)
SELECT r, c, round(CASE WHEN aa * bb - ab * ab < 0 THEN ab * ab - aa * bb ELSE 0 END, 6) AS saddle FROM h""")
def hessian_saddle(spark, sf_dir):
    df, _ = demo_cells(spark, sf_dir)
    return O.saddle(df.select("r", "c", "elev"), "elev", "s").select("r", "c", F.round("s", 6).alias("saddle"))


@query(f"{C}, {_E}, {box_sql('e', 'm', 6, 6)} SELECT m.r, m.c, round(e.v - m.v, 8) AS tpi FROM m JOIN e USING (r, c)")
def tpi(spark, sf_dir):
    """Height above the mean of 500 m around (13 cells of 40 m)."""
    df, side = demo_cells(spark, sf_dir)
    return O.box_mean(df.select("r", "c", "elev"), "elev", "m", (side, side), O.odd(500, 40)).select("r", "c", F.round(F.col("elev") - F.col("m"), 8).alias("tpi"))


@query(f"""{C}, t AS (SELECT r, c, CASE WHEN cls = 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM cells), o AS (SELECT r, c, CASE WHEN cls IN (20, 30, 90) THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM cells), {box_sql('t', 'mt', 2, 2)}, {box_sql('o', 'mo', 2, 2)}
SELECT r, c, round({cl('4 * mt.v * mo.v')}, 9) AS edge, round({cl('4 * mt.v * (1 - mt.v)')}, 9) AS categorical FROM mt JOIN mo USING (r, c)""")
def interspersion(spark, sf_dir):
    """Cover against openings in 200 m, from fractions and from the tree share alone."""
    df, side = demo_cells(spark, sf_dir)
    df = df.select("r", "c", (F.col("cls") == 10).cast("double").alias("t"), F.col("cls").isin(20, 30, 90).cast("double").alias("o"))
    size = O.odd(200, 40)
    df = O.box_mean(O.box_mean(df, "t", "mt", (side, side), size), "o", "mo", (side, side), size)
    t, o = F.col("mt"), F.col("mo")
    return df.select("r", "c", r9(A.clip(4 * t * o), "edge"), r9(A.clip(4 * t * (1 - t)), "categorical"))


@query(f"""{L}, e AS (SELECT r, c, coalesce(ndvi, 0) AS v FROM l), {box_sql('e', 'm', 2, 2)}, d AS (SELECT e.r, e.c, (e.v - m.v) * (e.v - m.v) AS v FROM e JOIN m USING (r, c)), {box_sql('d', 's', 2, 2)}, b AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM s)
SELECT r, c, round({nz('v', 'lo', 'hi')}, 7) AS edge FROM s, b""")
def variance_edge(spark, sf_dir):
    """Edge from local variance alone, between its 2nd and 98th percentile."""
    df, side = layers(spark, sf_dir)
    df = O.box_mean(df.select("r", "c", F.coalesce("ndvi", F.lit(0.0)).alias("v")), "v", "m", (side, side), 5)
    df = O.box_mean(df.withColumn("d", (F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))), "d", "s", (side, side), 5)
    b = df.agg(F.percentile("s", F.lit(0.02)).alias("lo"), F.percentile("s", F.lit(0.98)).alias("hi"))
    return df.crossJoin(F.broadcast(b)).select("r", "c", F.round(A.normalize(F.col("s"), F.col("lo"), F.col("hi")), 7).alias("edge"))  # b is one row




@query(f"""{C}, e AS (SELECT r, c, round(elev * 100) * 1e7 - (r * 2000 + c) AS v FROM cells), {box_sql('e', 'm', 4, 4, 'max(v)')} SELECT cells.r, cells.c, elev FROM m JOIN e USING (r, c) JOIN cells USING (r, c) WHERE m.v = e.v AND elev > 40""")
def local_peaks(spark, sf_dir):
    """Maxima above a bar that keep their distance."""
    df, side = demo_cells(spark, sf_dir)
    return O.local_peaks(df.select("r", "c", "elev"), "elev", (side, side), 4, F.lit(40.0)).select("r", "c", "elev")


@query(f"""{C}, e AS (SELECT r, c, elev AS v FROM cells), {gauss_sql('e', 's', 1.0)}, {box_sql('s', 'm', 6, 6)}, p AS (SELECT s.r // 5 AS br, s.c // 5 AS bc, s.v - m.v AS t FROM s JOIN m USING (r, c))
SELECT br, bc, round(CASE WHEN abs(max(t)) >= abs(min(t)) THEN max(t) ELSE min(t) END, 7) AS prominence FROM p GROUP BY 1, 2""")
def peak_prominence(spark, sf_dir):
    """Signed peak position of the fine grid within each coarse cell."""
    from cellweave.operators.zonal import blocks, signed_peak

    df, side = demo_cells(spark, sf_dir)
    df = O.box_mean(O.gaussian(df.select("r", "c", "elev"), "elev", "s", (side, side), 1.0), "s", "m", (side, side), 13)
    df = blocks(df.withColumn("t", F.col("s") - F.col("m")), 5)
    return df.groupBy("br", "bc").agg(F.round(signed_peak(F.col("t")), 7).alias("prominence"))

"""Layers derived from the demonstration grid, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.grid import CELLS_SQL, demo_cells

_LAYERS = {
    "browse": "(k % 11) / 10.0D", "cover": "((k * 7) % 11) / 10.0D", "edge": "((k * 3) % 11) / 10.0D", "slope": "(k % 31) * 1.0D", "aspect": "(k * 11 % 360) * 1.0D",
    "d_water": "((k * 53) % 1500) * 1.0D", "d_road": "elev * 40.0D", "tpi": "elev / 10.0D - 5.0D", "ndvi": "CASE WHEN k % 13 = 0 THEN NULL ELSE (k % 90) / 100.0D END",
    "burn": "CASE WHEN k % 4 = 0 THEN 1950 + k % 70 END", "cut": "CASE WHEN k % 5 = 0 THEN 1980 + k % 45 END", "stand": "CASE WHEN k % 8 = 0 THEN NULL ELSE k % 8 END", "closure": "(k % 5) / 4.0D",
    "funnel": "((k * 17) % 101) / 100.0D", "low": "(k % 2) * 1.0D",
}


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    cells, side = demo_cells(spark, sf_dir)
    return cells.select("*", *[F.expr(v).alias(k) for k, v in _LAYERS.items()]), side


def _duck(e: str) -> str:
    return e.replace("0D", "0").replace("4.0D", "4.0")


LAYERS_SQL = CELLS_SQL + ",\nl AS (SELECT *, " + ", ".join(f"{'CAST(' + _duck(v) + ' AS DOUBLE)' if 'D' in v.replace('THEN', '').replace('END', '').replace('CASE', '').replace('WHEN', '').replace('ELSE', '').replace('NULL', '').replace('AND', '') else _duck(v)} AS {k}" for k, v in _LAYERS.items()) + " FROM cells)"


def cl(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    """SQL of a null-keeping clip."""
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least({hi}, greatest({lo}, CAST({x} AS DOUBLE))) END)"


def nz(x: str, lo: float, hi: float) -> str:
    return cl(f"({x} - ({lo})) / ({hi} - ({lo}))")


def pr(d: str, opt: float, fall: float) -> str:
    return cl(f"1 - ({d} - {opt}) / {fall}")


def knots(x: str, pts) -> str:
    out = [f"WHEN {x} <= {pts[0][0]} THEN {pts[0][1]}"]
    out += [f"WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) * ({y1} - {y0}) / CAST({x1} - {x0} AS DOUBLE)" for (x0, y0), (x1, y1) in zip(pts, pts[1:])]
    return f"(CASE WHEN {x} IS NULL THEN NULL {' '.join(out)} ELSE {pts[-1][1]} END)"

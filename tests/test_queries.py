"""Every query with SQL against DuckDB over the small tables."""

import decimal
import math

import duckdb
import pytest

import cellweave.queries  # noqa: F401
from cellweave import core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 5) + 0.0
    return None if v is None else str(v) if not isinstance(v, (int, bool)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF)
    rel = duck.sql(core.SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_resample_covers_the_whole_source(spark, tmp_path):
    """A source of side 120 needs 71 x 71 target cells; all of them are what the SQL gives."""
    side, n = 120, 71
    e = spark.range(side * side).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01' AS ts", "id % 5 AS user_id", "'view' AS event_type", "cast(id * 37 % 1009 as double) AS value", "'{\"k\": 1}' AS props")
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.r, r.c): (r.nearest, r.bilinear) for r in core.QUERIES["resample"](spark, str(tmp_path)).collect()}
    assert set(got) == {(r, c) for r in range(n) for c in range(n)}
    v = lambda r, c: float((r * side + c) * 37 % 1009)
    assert all(got[r, c][0] == v(math.floor(r * 1.7 + 0.1), math.floor(c * 1.7 + 0.1)) for r in range(n) for c in range(n))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    part = con.sql(core.SQL["resample"]).fetchall()
    assert rows(["r", "c", "nearest", "bilinear"], part) == rows(["r", "c", "nearest", "bilinear"], [(*k, *x) for k, x in got.items()])


def test_grid_holds_every_event(spark):
    from cellweave.grid import demo_cells

    for sf in ("sf0.001", "sf0.01"):
        cells, side = demo_cells(spark, f"/root/testdata/{sf}")
        n = spark.read.parquet(f"/root/testdata/{sf}/events.parquet").count()
        assert n <= cells.count() == side * side == cells.select("r", "c").distinct().count() < n + 2 * side


"""The stage chain, its store of results and the command line."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import cli
from cellweave.functions import algebra as A
from cellweave.plans import stages as T

SIDE, RES = 24, 40.0


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(1)
    rows = []
    for r in range(SIDE):
        for c in range(SIDE):
            water = (r - 6) ** 2 + (c - 6) ** 2 < 12
            rows.append((r, c, 100 + 10 * math.sin(r / 4) + 8 * math.cos(c / 5), 80 if water else int(rng.choice([10, 20, 30, 90])), float(rng.random()), int(rng.integers(1990, 2024)) if rng.random() < 0.3 else None, None, 40.0 * c))
    return spark.createDataFrame(rows, "r int, c int, elev double, cls int, ndvi double, cut int, burn int, d_road double")


@pytest.fixture(scope="module")
def chained(cells):
    return T.run(cells, {"sides": (SIDE, SIDE), "res": RES, "year": 2026})


def test_stages_in_order(cells, chained):
    rows = chained.collect()
    assert len(rows) == SIDE * SIDE and {(r.r, r.c) for r in rows} == {(a, b) for a in range(SIDE) for b in range(SIDE)}
    for r in rows:
        assert (r.feed is None) == (r.cls == 80) and 0 <= r.browse <= 1 and 0 <= r.edge <= 1
        assert r.cls == 80 or r.d_water is not None and r.d_water >= 0
        assert r.huntability is None or 0 <= r.huntability <= 1 + 1e-9
    wet = [(r.r, r.c) for r in rows if r.cls in (80, 90)]
    for r in rows[::37]:
        assert math.isclose(r.d_water, RES * min(math.hypot(r.r - a, r.c - b) for a, b in wet), rel_tol=1e-9)


def test_stages_use_computed_layers(chained):
    """Each surface is the formula of the layers that the stages before it computed."""
    n = chained.where("cls <> 80")
    want = A.cruise(F.col("hsm_rut"), F.col("funnel"))
    assert n.where(F.abs(F.col("cruise") - want) > 1e-12).isEmpty()
    phase = A.phase_blend(F.col("hsm"), [(0.6, F.col("cruise")), (0.4, F.col("feed"))])
    hunt = A.huntability(phase, A.reach_decay(F.col("d_road"), F.lit(9000.0)), A.pressure(F.col("d_road")))
    assert n.where(F.abs(F.col("huntability") - hunt) > 1e-12).isEmpty()


def test_stages_one_by_one_give_the_same(cells, chained):
    """A run that is taken up after a stage ends as the run in one go."""
    p = {"sides": (SIDE, SIDE), "res": RES, "year": 2026}
    some = T.run(T.run(cells, p, ["terrain", "habitat"]), p, ["behavior", "access"])
    assert some.select(*chained.columns).exceptAll(chained).isEmpty()
    assert list(T.STAGES) == ["terrain", "habitat", "behavior", "access"]
    free = T.run(cells.drop("d_road"), p)
    assert free.where("extraction <> 0.85 or pressure <> 0").isEmpty()


def test_store(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/store/x"
    assert T.cached(spark, path, make).count() == T.cached(spark, path, make).count() == 3 and made == [1]
    (tmp_path / "store/x/_SUCCESS").unlink()  # a write that broke off
    assert T.cached(spark, path, make).count() == 3 and made == [1, 1]
    a = T.store_path(spark, (1.00001, 2, 3, 4), "EPSG:4326", 40, "terrain")
    assert a == T.store_path(spark, (1.00002, 2, 3, 4), "EPSG:4326", 40.001, "terrain") != T.store_path(spark, (1.1, 2, 3, 4), "EPSG:4326", 40, "terrain")


def test_command_line(spark, cells, tmp_path, capsys):
    assert cli.main(["stages"]) == 0 and capsys.readouterr().out.split() == list(T.STAGES)
    assert cli.main(["queries"]) == 0 and "best_ground" in capsys.readouterr().out.split()
    assert cli.main(["run", "best_ground", "/root/testdata/sf0.001", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    cells.write.parquet(str(tmp_path / "layers"))
    assert cli.main(["chain", str(tmp_path / "layers"), str(tmp_path / "done"), "--side", str(SIDE), "--stages", "terrain,habitat"]) == 0
    assert {"slope", "funnel", "hsm"} <= set(spark.read.parquet(str(tmp_path / "done")).columns)

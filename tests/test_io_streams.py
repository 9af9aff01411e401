"""Readers, writers and streams."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from cellweave.plans import merge as M
from cellweave.sources import readers as R
from cellweave.sources import sinks as W
from cellweave.streaming import jobs as J


def fetch(page, size):
    return [{"id": page * size + i, "name": f"f{i}", "geom": {"type": "Point"}} for i in range(size if page < 2 else 1)]


def test_pages(spark):
    df = R.read_pages(spark, "id long, name string, geom string, gone string", "tests.test_io_streams.fetch", 3, 10)
    assert df.count() == 21 and df.rdd.getNumPartitions() == 3
    assert df.where("id = 3").head().geom == '{"type": "Point"}'


def test_layers_round_trip(spark, tmp_path):
    df = spark.range(400).select(F.expr("cast(id div 20 as int)").alias("r"), F.expr("cast(id % 20 as int)").alias("c"), F.col("id").cast("double").alias("v"))
    W.write_layers(df, str(tmp_path / "l"), 8)
    some = W.read_layers(spark, str(tmp_path / "l"), (3, 3, 9, 9), 8)
    assert some.count() == 49 and dict(some.dtypes)["v"] == "float"
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString() and W.read_layers(spark, str(tmp_path / "l")).count() == 400


def test_clip_is_pushed_down(spark, tmp_path):
    spark.range(10).selectExpr("id", "double(id) minx", "double(id) miny", "double(id + 1) maxx", "double(id + 1) maxy").write.parquet(str(tmp_path / "f"))
    df = R.clipped(spark.read.parquet(str(tmp_path / "f")), (2.5, 2.5, 4.5, 4.5))
    assert sorted(r.id for r in df.collect()) == [2, 3, 4]
    assert "GreaterThanOrEqual(maxx" in df._jdf.queryExecution().executedPlan().toString()


def test_csv_text_and_columns(spark, tmp_path):
    (tmp_path / "h.csv").write_text("﻿Zone,Annee,Engins,Total_general\n9,2019,Tous,5\n09,2020,Tous,6\n09,2021,Arc,7\n09,2022,,8\n10,2022,Tous,9\n12E,2022,Tous,4\n12,2022,Tous,3\n", encoding="utf-8")
    assert [(r.Annee, r.total) for r in R.harvest(spark, str(tmp_path / "h.csv"), "9", 2).collect()] == [("2022", 8), ("2020", 6)]
    assert [r.total for z in ("12", "12E") for r in R.harvest(spark, str(tmp_path / "h.csv"), z, 9).collect()] == [3, 4]
    text = "Le succès de chasse  global est de 12 %. On compte 1 234 chasseurs. Densité de 0,6 orignal"
    got = spark.range(1).select(*R.effort(F.lit(text))).head()
    assert (got.success_pct, got.hunters, got.density) == (12, 1234, 0.6)
    assert R.pick_field(["OBJECTID", "Nom_Zone", "TYPE"], "zone", "type") == "Nom_Zone" and R.pick_field(["a"], "z") is None
    assert R.tile_ids(-1, 0, 501, 10, 500) == [(-1, 0), (0, 0), (1, 0)]
    df = R.with_optional(spark.range(1), {"x": "double", "id": "long"})
    assert df.columns == ["id", "x"]
    u = R.union_all([spark.range(1), spark.range(2).withColumn("y", F.lit(1))])
    assert u.count() == 3 and "y" in u.columns
    tiles = spark.createDataFrame([(0, 0, 2, 5.0), (0, 0, 1, None), (0, 1, 2, 7.0), (0, 1, 1, 6.0)], "r int, c int, t int, v double")
    assert sorted(tuple(x) for x in R.first_valid_wins(tiles, "v", F.col("t")).collect()) == [(0, 0, 5.0), (0, 1, 6.0)]
    seasons = spark.range(1).select(R.season(F.lit("2026-05-01").cast("date")).alias("s")).head().s
    assert [s.starts.year for s in seasons] == [2025, 2024, 2023]


def test_documents(spark, tmp_path):
    pts = spark.createDataFrame([("b & c", 47.1, -78.5), ("a", 47.0, -78.0)], "name string, lat double, lon double")
    W.write_document(pts.select("name", M.gpx_points(F.col("name"), F.col("lat"), F.col("lon")).alias("x")), F.col("name"), "x", str(tmp_path / "g"), "<gpx>", "</gpx>")
    lines = [r.value for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert lines[0] == "<gpx>" and lines[-1] == "</gpx>" and '<name>b &amp; c</name>' in lines[2] and len(lines) == 4
    line = F.array(F.struct(F.lit(-78.123456).alias("lon"), F.lit(47.0).alias("lat")), F.struct(F.lit(-78.0).alias("lon"), F.lit(47.5).alias("lat")))
    row = spark.range(1).select(M.geojson_feature("LineString", line, F.struct(F.lit(1).alias("rank"))).alias("g"), M.gpx_track(F.lit("t"), line).alias("t"), M.kml_placemark(F.lit("k"), F.lit("#112233"), F.lit(1.0), F.lit(2.0)).alias("k")).head()
    assert row.g == '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[-78.12346,47.0],[-78.0,47.5]]},"properties":{"rank":1}}'
    assert row.t.count("<trkpt") == 2 and "<color>ff332211</color>" in row.k
    W.write_parts(M.contract(None, a=pts), str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc" / "a")).count() == 2


def stream(spark, tmp_path, batches):
    """A stream of files, one a batch."""
    folder = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "job long, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("job long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def at(s):
    return dt.datetime(2026, 9, 20, 8) + dt.timedelta(seconds=s)


def test_streams(spark, tmp_path):
    batches = [[(1, at(0), "poll"), (2, at(0), "poll"), (1, at(30), "poll")], [(1, at(60), "done"), (2, at(20), "poll")], [(3, at(4000), "poll")], [(4, at(9000), "poll")], [(5, at(9600), "poll")]]
    events = stream(spark, tmp_path, batches)
    got = {(r.job, r.polls) for r in run(spark, J.sessions(events), "s", tmp_path)}
    assert {(1, 3), (2, 2)} <= got
    ends = {r.job: r.status for r in run(spark, J.outcomes(events), "o", tmp_path)}
    assert ends[1] == "done" and ends[2] == "cancelled"
    assert sum(r.n for r in run(spark, J.activity(events), "a", tmp_path, "complete")) == 8


@pytest.fixture
def one_partition(spark):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", keep)


def test_job_life_over_a_restart(spark, tmp_path, one_partition):
    """A job goes on where it was after the query stopped; a late event does not bring an ended job back."""
    folder = tmp_path / "in"
    folder.mkdir()
    events = spark.readStream.schema("job long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(folder))

    def feed(rows):
        spark.createDataFrame(rows, "job long, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(folder))

    def go():
        q = J.outcomes(events, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted((r.job, r.status, r.polls) for r in spark.read.schema("job long, status string, polls long").parquet(str(tmp_path / "out")).collect())

    feed([(1, at(0), "poll"), (2, at(0), "poll"), (3, at(0), "poll")])
    assert go() == []
    feed([(1, at(50), "poll"), (2, at(40), "error"), (2, at(45), "done")])
    assert go() == [(2, "error", 3)]  # the first end counts
    feed([(9, at(400), "poll")])
    assert go() == [(1, "cancelled", 2), (2, "error", 3), (3, "cancelled", 1)]
    feed([(1, at(60), "poll"), (9, at(430), "done")])  # 60 is long before the watermark
    feed([(8, at(900), "poll")])
    assert go() == [(1, "cancelled", 2), (2, "error", 3), (3, "cancelled", 1), (9, "done", 2)]


def test_artefacts_are_forgotten(spark, tmp_path, one_partition):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)  # in processing time there is always another batch
    folder = tmp_path / "uses"
    folder.mkdir()
    schema = "plan long, name string, bytes long"
    uses = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    feed([(1, "map", 10), (1, "track", 5), (2, "map", 7)])

    def go():
        q = J.retained(uses, 4000).writeStream.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        assert q.awaitTermination(60)

    found: list[tuple] = []
    go()
    assert set(found) == {(1, 2, 15), (2, 1, 7)}
    time.sleep(5)
    feed([(1, "photo", 1)])
    go()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert found[-1] == (1, 1, 1)

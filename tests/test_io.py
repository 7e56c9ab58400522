"""Sources, sinks and streams, from payloads written by the test."""

import json

from pyspark.sql import functions as F

from strataflow.sources import readers, writers
from strataflow.streaming import events as stream


def test_feature_collection(spark, tmp_path):
    feature = lambda v, q: {"geometry": {"coordinates": [-122.0, 47.0]}, "properties": {"monitoring_location_id": " A1 ", "time": "2024-01-02T00:00:00Z", "value": v, "qualifier": q}}
    (tmp_path / "a.json").write_text(json.dumps({"features": [feature("3.5", ["Static", "Pumping"]), feature("bad", None)]}))
    rows = sorted(readers.feature_collection(spark, str(tmp_path)).collect(), key=lambda r: str(r.value))
    assert [(r.site_no, r.value, r.status, r.lon) for r in rows] == [("A1", 3.5, "P", -122.0), ("A1", None, "", -122.0)]


def test_year_month_table(spark, tmp_path):
    (tmp_path / "pdo.txt").write_text("Year Jan ...\n2020 " + " ".join(["1.5", "-99.9"] + ["0.1"] * 10) + "\n")
    rows = readers.year_month_table(spark, str(tmp_path / "pdo.txt")).orderBy("month").collect()
    assert len(rows) == 12 and rows[0].value == 1.5 and rows[1].value is None


def test_station_series(spark, tmp_path):
    (tmp_path / "s1.stm").write_text("header line here\n2020/01/01 00:00 0.25 G\n2020/01/01 01:00 7.5 D\n")
    rows = readers.station_series(spark, str(tmp_path)).collect()
    assert [(r.station, r.value) for r in rows] == [("s1", 0.25)]


def test_ascii_grid_round_trip(spark, tmp_path):
    grid = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else float(r * 3 + c)) for r in range(2) for c in range(3)], "row int, col int, z double")
    writers.write_ascii_grid(grid, "z", str(tmp_path / "g"), 0.0, 0.0, 90.0)
    back = readers.ascii_grid(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, grid.collect()), key=str)


def test_cube_tree_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01", 0, 0, 1.0), ("2020-02-01", 0, 0, 2.0)], "month string, row int, col int, v double")
    writers.write_cube(df, str(tmp_path / "cube"))
    assert spark.read.parquet(str(tmp_path / "cube")).filter("month = '2020-02-01'").first().v == 2.0
    writers.write_tree({"a": df, "b": None}, str(tmp_path / "tree"))
    assert spark.read.parquet(str(tmp_path / "tree" / "a")).count() == 2
    assert json.loads(writers.provenance(df, source="x").first().value)["rows"] == 2
    assert writers.described(df, "v", units="m").schema["v"].metadata == {"units": "m"}


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.unionByName(batch.limit(5)).repartition(1).write.parquet(str(tmp_path / "in"))
    source = stream.events(spark, str(tmp_path / "in"))
    clean = stream.quality_controlled(source, ["error"], "60 days")
    stream.to_memory(clean, "clean", "append", str(tmp_path / "c1"))
    assert spark.table("clean").count() == batch.filter("event_type <> 'error'").count()
    stream.to_memory(stream.daily_means(stream.events(spark, str(tmp_path / "in")), "60 days"), "daily", "complete", str(tmp_path / "c2"))
    assert spark.table("daily").agg(F.sum("n")).first()[0] == batch.count() + 5
    stream.to_memory(stream.bucket_state(stream.events(spark, str(tmp_path / "in"))), "bucket", "update", str(tmp_path / "c3"))
    rows = spark.table("bucket").collect()
    assert rows and all(100 <= r.storage <= 450 for r in rows)

"""Values of functions that queries only touch."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from strataflow.operators import grid, learn, months, variogram
from strataflow.sources import readers, writers
from strataflow.streaming import events as stream


def test_sessions_and_sliding_windows(spark, tmp_path):
    times = [("2020-01-01 00:00", 1.0), ("2020-01-01 05:00", 3.0), ("2020-01-01 12:00", 5.0), ("2020-01-02 13:00", 7.0)]
    rows = [(i, t, u, "ok", v, None) for u in (1, 2) for i, (t, v) in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    source = stream.events(spark, str(tmp_path / "in"))
    stream.to_memory(stream.sessions(source, "6 hours", "60 days"), "runs", "complete", str(tmp_path / "c1"))
    got = sorted((r["user_id"], str(r["started"]), str(r["ended"]), r["n"]) for r in spark.table("runs").collect())
    want = [("2020-01-01 00:00:00", "2020-01-01 11:00:00", 2), ("2020-01-01 12:00:00", "2020-01-01 18:00:00", 1), ("2020-01-02 13:00:00", "2020-01-02 19:00:00", 1)]
    assert got == [(u, *w) for u in (1, 2) for w in want]
    stream.to_memory(stream.daily_means(stream.events(spark, str(tmp_path / "in")), "60 days", "12 hours"), "slid", "complete", str(tmp_path / "c2"))
    slid = {str(r["start"]): (r["n"], r["mean_value"]) for r in spark.table("slid").filter("user_id = 1").collect()}
    assert slid["2020-01-01 00:00:00"] == (3, 3.0) and slid["2020-01-01 12:00:00"] == (1, 5.0) and slid["2019-12-31 12:00:00"] == (2, 2.0)


def test_state_files(spark, tmp_path):
    for s in ("WA", "OR"):
        spark.createDataFrame([(s, 1)], "a string, b int").coalesce(1).write.parquet(str(tmp_path / s))
        next((tmp_path / s).glob("*.parquet")).rename(tmp_path / f"{s}_levels.parquet")
    assert sorted((r["a"], r["state"]) for r in readers.state_files(spark, str(tmp_path), "levels").collect()) == [("OR", "OR"), ("WA", "WA")]
    assert readers.state_files(spark, str(tmp_path), "levels", ["WA"]).count() == 1


def test_folds_keep_blocks_whole(spark):
    df = spark.range(400).select(((F.col("id") % 20) * 0.5).alias("x"), (F.expr("id div 20") * 0.5).alias("y"))
    rows = learn.spatial_fold(df, "x", "y", 2.0, 3).collect()
    by_block = {}
    for r in rows:
        by_block.setdefault((r["x"] // 2, r["y"] // 2), set()).add(r["fold"])
    assert len(by_block) == 25 and all(len(f) == 1 for f in by_block.values()) and {r["fold"] for r in rows} == {0, 1, 2}


def test_draws_are_the_same_on_every_run(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    one = [r["k"] for r in months.drawn(df, ["k"], 50, 3).collect()]
    assert len(set(one)) == 50 and one == [r["k"] for r in months.drawn(df.repartition(7), ["k"], 50, 3).collect()]
    assert set(one) != {r["k"] for r in months.drawn(df, ["k"], 50, 4).collect()} and months.drawn(df, ["k"], 5000).count() == 1000


def test_pair_reach(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(11)], "pid long, px double, py double")
    d = sorted(j - i for i in range(11) for j in range(i + 1, 11) if j - i <= 5)
    assert variogram.pair_reach(points, 5.0, 0.5).first()["reach"] == d[math.ceil(len(d) / 2) - 1]


def test_provenance(spark):
    row = writers.provenance(spark.range(7).withColumn("v", F.lit(1)), source="wells", step="clean").first()[0]
    assert json.loads(row) == {"source": "wells", "step": "clean", "rows": 7, "columns": ["id", "v"]}


def test_moisture_on_a_fine_grid(spark):
    k, n = 3, 12
    rng = np.random.default_rng(0)
    wp, sat, theta = 0.05 + 0.1 * rng.random((n, n)), 0.4 + 0.1 * rng.random((n, n)), 0.1 + 0.3 * rng.random((n // k, n // k))
    envelope = spark.createDataFrame([(i, j, float(wp[i, j]), float(sat[i, j])) for i in range(n) for j in range(n)], "row int, col int, wp double, sat double")
    driver = spark.createDataFrame([(i, j, float(theta[i, j])) for i in range(n // k) for j in range(n // k)], "row int, col int, theta double")
    mean = lambda a: a.reshape(n // k, k, n // k, k).mean((1, 3))
    f = np.clip((theta - mean(wp)) / np.maximum(mean(sat) - mean(wp), 1e-6), 0, 1)
    got = {(r["row"], r["col"]): r["theta"] for r in grid.moisture_downscaled(driver, envelope, k).collect()}
    assert len(got) == n * n
    for i, j in ((4, 4), (5, 7), (7, 4), (0, 0)):
        u, w = min(max((i + 0.5) / k - 0.5, 0), n // k - 1), min(max((j + 0.5) / k - 0.5, 0), n // k - 1)
        a, b = min(int(u), n // k - 2), min(int(w), n // k - 2)
        s, t = u - a, w - b
        share = (1 - s) * ((1 - t) * f[a, b] + t * f[a, b + 1]) + s * ((1 - t) * f[a + 1, b] + t * f[a + 1, b + 1])
        assert abs(got[i, j] - (wp[i, j] + min(max(share, 0), 1) * (sat[i, j] - wp[i, j]))) < 1e-9

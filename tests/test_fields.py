"""Kriging with drift and covariate, regridding and out-of-fold forests against dense or exact forms; evaluation with nulls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import hydro
from strataflow.operators import evaluation, geostat, grid, kriging, learn, months, regrid, series

MODEL = (0.2, 5.0, 12.0)


def network(seed=0, n=40):
    rng = np.random.default_rng(seed)
    obs = [(int(i % 2), float(x), float(y), float(v), float(d)) for i, (x, y, v, d) in enumerate(zip(rng.random(n) * 30, rng.random(n) * 20, rng.normal(size=n), rng.random(n)))]
    cells = [(k, k * 10_000 + i, float(x), float(y), float(d)) for k in (0, 1) for i, (x, y, d) in enumerate(zip(rng.random(150) * 30, rng.random(150) * 20, rng.random(150)))]
    return obs, cells


OBS, CELLS = "k int, px double, py double, v double, d double", "k int, cell long, x double, y double, d double"


def dense(obs, cells, drift):
    px, py, v, d = (np.array([o[i] for o in obs]) for i in (1, 2, 3, 4))
    x, y, e = (np.array([c[i] for c in cells]) for i in (2, 3, 4))
    n = len(px)
    f, g = [np.ones(n)] + [d] * drift, [np.ones(len(x))] + [e] * drift
    a = np.zeros((n + len(f), n + len(f)))
    a[:n, :n] = geostat.exponential(np.hypot(px[:, None] - px, py[:, None] - py), *MODEL)
    a[:n, n:], a[n:, :n] = np.array(f).T, np.array(f)
    b = np.vstack([geostat.exponential(np.hypot(px[:, None] - x, py[:, None] - y), *MODEL), np.array(g)])
    w = np.linalg.solve(a, b)
    return w[:n].T @ v, np.sqrt(np.maximum((w * b).sum(0), 0))


@pytest.mark.parametrize("drift,block", [([], 7.0), (["d"], 7.0), (["d"], 0.5)])
def test_blocks_give_the_dense_solve(spark, drift, block):
    obs, cells = network()
    noise = [(0, None, 1.0, 2.0, 0.1), (1, 3.0, 3.0, None, 0.1)] + ([(1, 3.0, 3.0, 1.0, None)] if drift else [])
    got = {r["cell"]: r for r in kriging.drift_krige(spark.createDataFrame(obs + noise, OBS), spark.createDataFrame(cells, CELLS), ["k"], "v", drift, MODEL, 1000.0, block).collect()}
    assert len(got) == 300
    for k in (0, 1):
        mine = [c for c in cells if c[0] == k]
        want = dense([o for o in obs if o[0] == k], mine, len(drift))
        assert np.allclose([got[c[1]]["estimate"] for c in mine], want[0], atol=1e-8) and np.allclose([got[c[1]]["sd"] for c in mine], want[1], atol=1e-6)


def test_exact_at_stations_and_on_the_drift(spark):
    obs, _ = network(1)
    line = [(0, x, y, 3 - 2 * d, d) for _, x, y, _, d in obs]
    at = [(0, i, x, y, d) for i, (_, x, y, _, d) in enumerate(line)]
    away = [(0, 100 + i, x + 0.3, y - 0.2, 2 * d) for i, (_, x, y, _, d) in enumerate(line)]
    got = {r["cell"]: r for r in kriging.drift_krige(spark.createDataFrame(line, OBS), spark.createDataFrame(at + away, CELLS), ["k"], "v", ["d"], (0.0, 5.0, 12.0), 9.0, 5.0, least=4).collect()}
    assert len(got) > 60 and all(abs(r["estimate"] - (3 - 2 * (at + away)[c if c < 100 else c - 100 + len(at)][4])) < 1e-6 for c, r in got.items())
    assert all(got[i]["sd"] < 1e-4 for i in range(len(at)) if i in got)


def test_halo_reaches_far_enough(spark):
    obs, cells = network(2, 200)
    frames = spark.createDataFrame([(0, *o[1:]) for o in obs], OBS), spark.createDataFrame([c for c in cells if c[0] == 0], CELLS)
    near = {r["cell"]: r["estimate"] for r in kriging.drift_krige(*frames, ["k"], "v", [], MODEL, 25.0, 4.0).collect()}
    whole = {r["cell"]: r["estimate"] for r in kriging.drift_krige(*frames, ["k"], "v", [], MODEL, 1e6, 4.0).collect()}
    assert len(near) == len(whole) and max(abs(near[c] - whole[c]) for c in near) < 0.05


def test_cokriging_is_the_full_system(spark):
    obs, cells = network(3)
    rho, nugget, reach = 0.6, 0.1, 12.0
    gone = [(k, c, x, y, None if i % 5 == 0 else d) for i, (k, c, x, y, d) in enumerate(cells)]
    got = {r["cell"]: r for r in kriging.cokrige(spark.createDataFrame(obs, OBS), spark.createDataFrame(gone, CELLS), ["k"], "v", "d", rho, nugget, reach, 1000.0, 6.0).collect()}
    like = lambda d: np.where(d > 0, (1 - nugget) * np.exp(-3 * d / reach), 1.0)
    for k, cell, x, y, d in gone:
        mine = [o for o in obs if o[0] == k]
        px, py, v = (np.array([o[i] for o in mine]) for i in (1, 2, 3))
        c, c0 = like(np.hypot(px[:, None] - px, py[:, None] - py)), like(np.hypot(px - x, py - y))
        if d is not None:
            c = np.block([[c, rho * c0[:, None]], [rho * c0[None], np.ones((1, 1))]])
            c0, v = np.append(c0, rho), np.append(v, d)
        w = np.linalg.solve(c, c0)
        assert abs(got[cell]["estimate"] - w @ v) < 1e-9 and abs(got[cell]["sd"] - math.sqrt(max(1 - w @ c0, 0))) < 1e-6


def test_scores_turn_back(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in range(101)], "k int, v double")
    knots = kriging.score_knots(rows, ["k"], "v")
    found = spark.createDataFrame([(1, i, s, 0.5) for i, s in enumerate([0.0, 9.0, -9.0, None, 0.6744897501960817])], "k int, cell long, estimate double, sd double")
    got = {r["cell"]: r for r in kriging.back_transformed(found, knots, ["k"]).collect()}
    assert [round(got[i]["mean"], 6) if got[i]["mean"] is not None else None for i in range(5)] == [50.0, 100.0, 0.0, None, 75.0]
    assert got[0]["spread"] == pytest.approx(100 * (0.6914624612740131 - 0.5), abs=1e-2)


def test_stations_at_one_place_count_as_their_mean(spark):
    obs = [(0, float(i), float(i * i % 7), 1.0 * i) for i in range(9)]
    double = obs + [(0, 0.0, 0.0, 4.0)]
    mean = [(0, 0.0, 0.0, 2.0), *obs[1:]]
    cells = spark.createDataFrame([(0, 1, 2.5, 2.5)], "k int, cell long, x double, y double")
    one, other = (geostat.krige_groups(spark.createDataFrame(o, "k int, px double, py double, v double"), cells, ["k"], "v", MODEL).collect() for o in (double, mean))
    assert one == other


def test_area_weights_sum_to_one(spark):
    target = spark.range(60).select((F.col("id") % 6).alias("row"), F.expr("id div 6").alias("col"))
    weights = regrid.area_weights(target, regrid.Raster(-0.35, 2.2, 1.7, 0.6), regrid.Raster(0.1, 2.0, 1.0, 1.0))
    sums = weights.groupBy("row", "col").agg(F.sum("w").alias("w"), F.min("w").alias("least")).collect()
    assert len(sums) == 60 and all(abs(r["w"] - 1) < 1e-12 and r["least"] > 0 for r in sums)
    same = regrid.area_weights(target, regrid.Raster(0.0, 0.0, 2.0, 2.0), regrid.Raster(0.0, 0.0, 2.0, 2.0))
    assert same.filter("row = srow and col = scol and w = 1").count() == same.count() == 60


def test_regridding_keeps_the_total(spark):
    source = spark.range(100).select(F.expr("cast(id div 10 as int)").alias("row"), (F.col("id") % 10).cast("int").alias("col"), (F.col("id") * 1.0).alias("v"))
    target = spark.range(36).select(F.expr("cast(id div 6 as int)").alias("row"), (F.col("id") % 6).cast("int").alias("col"))
    got = regrid.regridded(source, "v", regrid.area_weights(target, regrid.Raster(-1.0, 1.0, 2.0, 2.0), regrid.Raster(0.0, 0.0, 1.0, 1.0))).collect()
    assert sum((r["v"] or 0) * r["share"] * 4 for r in got) == pytest.approx(4950.0)
    kinds = regrid.majority(source.withColumn("v", F.when(F.col("col") < 3, "a").when(F.col("col") > 5, "b")), "v", regrid.area_weights(target, regrid.Raster(0.0, 0.0, 2.0, 2.0), regrid.Raster(0.0, 0.0, 1.0, 1.0)))
    assert {r["col"]: r["v"] for r in kinds.filter("row < 5").collect()} == {0: "a", 1: "a", 2: None, 3: "b", 4: "b", 5: None}


def test_projection_there_and_back(spark):
    rows = spark.range(400).select((-125 + F.col("id") % 20 * 3.1).alias("lon"), (24 + F.expr("id div 20") * 1.3).alias("lat"))
    x, y = hydro.albers(F.col("lon"), F.col("lat"))
    lon, lat = hydro.albers_degrees(F.col("x"), F.col("y"))
    off = rows.withColumn("x", x).withColumn("y", y).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(off) < 1e-7


def test_no_row_is_predicted_by_its_own_fold(spark):
    rows = [(i, float(i % 10), float(i // 10), (100.0 if i // 10 >= 5 else 0.0), i // 50) for i in range(100)]
    rows += [(100, None, 1.0, 5.0, 0), (101, 1.0, 1.0, None, 0), (102, 1.0, 1.0, 5.0, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, z double, fold int")
    got = {r["id"]: r for r in learn.out_of_fold(df, ["a", "b"], "z", "fold", trees=4, depth=3).collect()}
    assert len(got) == 103  # once each
    # Each fold has one value only, so a forest that has not seen it gives the other's.
    assert all(got[i]["prediction"] == (100.0 if i < 50 else 0.0) and got[i]["tree_sd"] == 0 for i in range(100))
    assert got[100]["prediction"] is None and got[102]["prediction"] is None and got[101]["prediction"] == 100.0


def test_reports_count_complete_rows_only(spark):
    rows = [("d", 1.0, None), ("d", 2.0, 2.5), ("d", 3.0, 2.0), ("d", None, 1.0), ("basin", 1.0, None)] + [("valley_fill", 1.0, None)] * 30 + [("valley_fill", 1.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "domain string, y double, mu double")
    got = {r["domain"]: r for r in evaluation.gate_status(evaluation.errors(df, ["domain"], F.col("y"), F.col("mu")), "domain").collect()}
    assert got["d"]["n"] == 2 and got["d"]["r2"] == pytest.approx(-1.5) and got["d"]["mae"] == pytest.approx(0.75)
    assert got["basin"]["n"] == 0 and got["basin"]["rmse"] is None and got["basin"]["status"] == "unvalidated"
    assert got["valley_fill"]["n"] == 3 and got["valley_fill"]["status"] == "unvalidated" and not got["valley_fill"]["meets_target"]
    cover = {r["domain"]: r for r in evaluation.interval_coverage(df, ["domain"], F.col("y"), F.col("mu"), F.lit(1.0)).collect()}
    assert cover["d"]["n"] == 2 and cover["d"]["cov50"] == 0.5 and cover["basin"]["n"] == 0 and cover["basin"]["cov50"] is None


def test_ranks_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, v) for v in (None, 1.0, 2.0, 2.0, 3.0)], "k int, v double")
    got = sorted((r["v"], r["p"]) for r in series.average_rank(df, ["k"], "v", "p").filter("v is not null").collect())
    assert got == [(1.0, 0.0), (2.0, 0.5), (2.0, 0.5), (3.0, 1.0)] and series.average_rank(df, ["k"], "v", "p").filter("v is null").first()["p"] is None


def test_cells_in_shapes_with_nulls(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    shapes = spark.createDataFrame([("a", 1, ring)], "code string, rank int, ring array<struct<x:double,y:double>>")
    cells = spark.createDataFrame([(1, 1.0, 1.0, None), (2, 9.0, 1.0, "u"), (3, 1.0, 1.0, None), (4, None, 1.0, "v")], "cell int, x double, y double, other string")
    assert sorted((r["cell"], r["code"]) for r in grid.cells_in_shapes(cells, shapes, 3.0).collect()) == [(1, "a"), (2, None), (3, "a"), (4, None)]


def test_months_of_a_key(spark):
    df = spark.createDataFrame([(1, "2020-01-05", 1.0), (1, "2020-01-20", 3.0), (1, "2020-03-01", 4.0), (1, "2020-02-01", None)], "k int, m string, v double").withColumn("m", F.to_date("m"))
    got = sorted((str(r["m"]), r["v"]) for r in months.regular_months(df, ["k"], "m", "v").collect())
    assert got == [("2020-01-01", 2.0), ("2020-02-01", 3.0), ("2020-03-01", 4.0)]
    falls = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 1.0)], "k int, t int, v double")
    assert [r["l"] for r in months.losses(falls, ["k"], "t", "v", "l").orderBy("t").collect()] == [0.0, None, 4.0]


def test_reconstruction_is_the_fitted_line(spark):
    rows = [(1, i, 2.0 + 0.5 * math.sin(i) - 0.01 * (i % 7) * 40 + 0.3 * math.cos(3 * i), math.sin(i), math.cos(3 * i), (i % 7) * 40.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t int, y double, spi double, pdo double, swe double")
    fits = months.lagged_fits(df, ["k"], "t", "y", ["spi", "pdo"], "swe", 0, 10)
    c = F.col
    again = df.join(fits, "k").select((c("y") - months.reconstructed(c("spi"), c("swe"), c("pdo"), c("b0"), c("b_spi"), c("b_swe"), c("b_pdo"))).alias("e"))
    assert again.agg(F.max(F.abs("e"))).first()[0] < 1e-9


def test_normal_distribution_to_the_last_digits(spark):
    from statistics import NormalDist

    from strataflow.functions import normal

    z = [i / 50 for i in range(-450, 451)] + [None, 40.0, -40.0]
    p = [10.0**-k for k in range(1, 12)] + [1 - 10.0**-k for k in range(1, 12)] + [i / 1000 for i in range(1, 1000)] + [None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(normal.norm_cdf("z")).collect()]
    assert all(b is None if a is None else abs(b - NormalDist().cdf(a)) < 2e-15 for a, b in zip(z, got))
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(normal.norm_ppf("p")).collect()]
    assert all(b is None if a is None else abs(b - NormalDist().inv_cdf(a)) < 1e-13 for a, b in zip(p, got))

"""Operators without SQL against numpy, and the cases that the driver's tables don't hold."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.functions import classify, hydro, site
from strataflow.operators import evaluation, grid, learn, months, priors, series, variogram, wells
from strataflow.plans import wells as well_plans


def test_domain():
    d = grid.Domain("d", (-2005000.0, 2892000.0, -1864000.0, 3062000.0))
    rows, cols = d.shape()
    assert (rows, cols) == (1890, 1567) and d.n_cells() == rows * cols
    assert grid.which_domain(d.shape(), d.bounds(), [d]) == "d" and grid.which_domain((1, 1), d.bounds(), [d]) == "unknown"
    west, south, east, north = d.bbox_degrees()
    assert -124 < west < east < -120 and 46 < south < north < 49


def test_albers_there_and_back(spark):
    for lon, lat in ((-122.3, 47.6), (-96.0, 23.0), (-80.1, 30.2)):
        x, y = hydro.albers(F.lit(lon), F.lit(lat))
        r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert np.allclose(grid.albers_inverse(r.x, r.y), (lon, lat), atol=1e-9)


def test_template(spark):
    t = grid.domain_of(0, 0, 30, 20, 10.0).template(spark).orderBy("cell").collect()
    assert [(r["row"], r["col"], r["x"], r["y"]) for r in t] == [(0, 0, 5, 15), (0, 1, 15, 15), (0, 2, 25, 15), (1, 0, 5, 5), (1, 1, 15, 5), (1, 2, 25, 5)]


def by_samples(z, v, top):
    """Travel time by fine steps of a piecewise linear profile."""
    fine = np.linspace(z[0], z[0] + top, 200_001)
    vs = np.interp(fine, z, v)
    return top / np.trapezoid(1 / vs, fine)


def test_profiles(spark):
    rows = [
        ("deep", [(0.0, 200.0), (10.0, 300.0), (40.0, 700.0)]),
        ("air", [(0.0, 0.0), (5.0, 0.0), (10.0, 250.0), (20.0, 400.0), (60.0, 900.0)]),
        ("broken", [(0.0, 200.0), (10.0, None), (40.0, 700.0)]),
        ("short", [(0.0, 200.0), (10.0, 300.0)]),
        ("none", [(0.0, 0.0), (50.0, 0.0)]),
    ]
    frame = spark.createDataFrame(rows, "k string, p array<struct<z: double, vs: double>>")
    got = {r.k: (r.a, r.b) for r in frame.select("k", site.profile_velocity(F.col("p")).alias("a"), site.buried_profile_velocity(F.col("p")).alias("b")).collect()}
    assert got["deep"][0] == pytest.approx(by_samples([0, 10, 40], [200, 300, 700], 30), rel=1e-6)
    assert got["broken"][1] is None and got["short"][1] is None and got["none"][1] is None
    # from 10 m down: all of the layer to 20 m, half of the travel time of the one below
    layers = [(b - a) / ((v - u) / math.log(v / u)) for a, b, u, v in ((10, 20, 250, 400), (20, 60, 400, 900))]
    assert got["air"][1] == pytest.approx(30 / (layers[0] + layers[1] / 2), rel=1e-9)


def test_class_probabilities(spark):
    rows = spark.createDataFrame([(360.0, 50.0), (100.0, 0.0), (800.0, 200.0)], "m double, s double")
    found = rows.select(*[p.alias(k) for k, p in site.class_probabilities(F.col("m"), F.col("s")).items()], site.likeliest_class(F.col("m"), F.col("s"))["class"].alias("best")).collect()
    assert all(sum(r[k] for k in "EDCBA") == pytest.approx(1) for r in found)
    assert found[0].D == pytest.approx(0.5, abs=1e-3) and found[1].E == 1.0 and [r.best for r in found][1:] == ["E", "B"]


def test_domain_without_height(spark):
    rows = spark.createDataFrame([(None, 3, 10.0), (None, 0, 10.0), (5.0, None, 10.0), (5.0, 0, 9e9), (5.0, 2, 10.0)], "h double, l int, c double")
    assert [r[0] for r in rows.select(classify.domain_class(F.col("h"), F.col("l"), F.col("c"))).collect()] == [4, 1, 255, 0, 5]


def test_null_status_stays(spark):
    frame = spark.createDataFrame([("R", 1), (None, 2), ("", 3)], "status string, k int")
    step = well_plans.steps()["status"]
    assert [r.k for r in wells.filter_chain(frame, {"status": step}).orderBy("k").collect()] == [2, 3]


def test_asof_keeps_equal_rows_and_any_distance(spark):
    t = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)"
    left = spark.createDataFrame([(1, 50), (1, 50), (1, 500), (2, 1)], "k int, h int").withColumn("ts", F.expr(t))
    right = spark.createDataFrame([(1, 10, 1.0), (1, 90, 2.0), (1, 90, 0.5)], "k int, h int, v double").withColumn("t2", F.expr(t)).drop("h")
    got = [(r.k, r.h, r.nearest_v) for r in series.asof_nearest(left, right, ["k"], "ts", "t2", "v").orderBy("k", "h").collect()]
    assert got == [(1, 50, 1.0), (1, 50, 1.0), (1, 500, 0.5), (2, 1, None)]
    near = series.asof_nearest(left, right, ["k"], "ts", "t2", "v", within=41 * 3600.0).collect()
    assert sorted((r.h, r.nearest_v) for r in near if r.k == 1) == [(50, 1.0), (50, 1.0), (500, None)]


def test_contributing_cells_of_a_cycle(spark):
    from strataflow.session import checkpointed

    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, next long")
    with pytest.raises(ValueError, match="cycle"):
        grid.contributing_cells(ring, checkpointed, most=4)


def test_downscalers(spark):
    rng = np.random.default_rng(1)
    fine = pd.DataFrame([(r, c, float(rng.normal())) for r in range(20) for c in range(20)], columns=["row", "col", "twi"]).astype({"row": "int32", "col": "int32"})
    fine["truth"] = 3 + 2 * fine["twi"]
    table = spark.createDataFrame(fine)
    coarse = grid.averaged(table, "truth", 4, "v")
    found = {}
    for method in ("bilinear", "twi", "regression", "ml"):
        out = grid.downscale(coarse, table, "v", 4, method, ["twi"]).toPandas()
        assert len(out) == 400 and out["v"].notna().all()
        found[method] = float(((out["v"] - out["truth"]) ** 2).mean())
    assert found["regression"] < 1e-12 and found["ml"] < found["bilinear"]
    with pytest.raises(ValueError):
        grid.downscale(coarse, table, "v", 4, "none")


def test_variogram_fit():
    h = np.linspace(1, 40, 30)
    bins = [(x, 0.2 + 1.5 * (1 - math.exp(-3 * x / 15)), 100) for x in h]
    nugget, sill, reach = variogram.fit_exponential(bins, 40.0)
    assert (nugget, sill, reach) == (pytest.approx(0.2, abs=0.05), pytest.approx(1.5, abs=0.05), pytest.approx(15, rel=0.05))


def test_normal_scores(spark):
    from statistics import NormalDist

    values = [3.0, 1.0, 1.0, 7.0, None]
    got = {r.i: r.s for r in variogram.normal_scores(spark.createDataFrame(list(enumerate(values)), "i int, v double"), [], "v", "s").collect()}
    assert got[4] is None and got[0] == pytest.approx(NormalDist().inv_cdf(2 / 3)) and got[1] == got[2] == pytest.approx(NormalDist().inv_cdf(0.5 / 3)) and 5.19 < got[3] < 5.21
    back = spark.createDataFrame([(-9.0,), (0.5,), (9.0,)], "s double").select(variogram.back_transform(F.col("s"), [(0.0, 1.0), (1.0, 3.0)])).collect()
    assert [r[0] for r in back] == [1.0, 2.0, 3.0]


def test_resolution(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 10, (30, 2))
    prior = priors.covariance(xy, xy, 1.0, 3.0)
    g, noise = np.eye(30)[:4], np.full(4, 0.1)
    kernel = priors.averaging_kernel(prior, g, noise)
    assert np.allclose(priors.resolved(prior, g, noise), np.diag(prior @ g.T @ np.linalg.inv(g @ prior @ g.T + np.diag(noise)) @ g @ prior))
    assert (priors.added_resolution(prior, g[:2], g[2:], noise[:2], noise[2:]) >= 0).all() and (priors.resolution_width(kernel, xy) > 0).all()
    cells = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "k int, cell long, x double, y double")
    feet = spark.createDataFrame([(1, i, i, 1.0, 0.1) for i in range(4)], "k int, obs long, cell long, w double, noise double")
    got = {r.cell: r.resolved for r in priors.resolution_groups(cells, feet, ["k"], 1.0, 3.0).collect()}
    assert np.allclose([got[i] for i in range(30)], priors.resolved(prior, g, noise))


def test_footprints(spark):
    cells = spark.createDataFrame([(i, float(i % 5), float(i // 5), 1.0 if i < 12 else 9.0, i != 3) for i in range(25)], "cell long, x double, y double, hand double, land boolean")
    one = priors.channel_footprints(cells).groupBy("pid").agg(F.sum("w").alias("t")).collect()
    assert {r.pid for r in one} == set(range(12)) - {3} and all(r.t == pytest.approx(1) for r in one)
    weights = spark.createDataFrame([(1, 2.0), (1, None), (2, 0.0)], "k int, w double")
    assert [(r.k, r.w) for r in priors.normalised(weights, ["k"]).orderBy("k", "w").collect()] == [(1, 0.0), (1, 1.0), (2, 0.0)]
    with pytest.raises(Exception, match="not a water-table observation"):
        priors.water_table_footprints(cells, spark.createDataFrame([(1, 0.0, 0.0, "aquifer_head")], "pid long, px double, py double, measurement_target string")).collect()


def test_fitted_prior():
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 60, (150, 2))
    k = priors.covariance(xy, xy, 2.0, 8.0, 1.5) + 0.2 * np.eye(150)
    y = 5 + np.linalg.cholesky(k) @ rng.normal(size=150)
    fit = priors.fit_matern(xy, y, 1.5)
    assert 4 < fit["length"] < 16 and 1 < fit["sigma"] < 4 and fit["converged"]
    grid_best = min(priors.reml(xy, y, length, 1.5, a)[0] for length in np.geomspace(3, 30, 25) for a in np.linspace(0.01, 0.3, 25))
    assert fit["neg2_reml"] <= grid_best + 1e-3
    scores = priors.holdout_scores(xy, y, fit["sigma"], fit["length"], 1.5, fit["nugget"], np.floor(xy[:, 0] / 10))
    assert scores["rmse"] < y.std() * 1.1 and 0.75 < scores["cover90"] <= 1


def test_lagged_fits(spark):
    rng = np.random.default_rng(4)
    swe, spi = rng.normal(size=60), rng.normal(size=60)
    target = 1 + 2 * spi + 3 * np.r_[np.zeros(2), swe[:-2]] + 0.01 * rng.normal(size=60)
    frame = spark.createDataFrame([(1, i, float(target[i]), float(spi[i]), float(swe[i])) for i in range(60)], "k int, t int, y double, spi double, swe double")
    fits = months.lagged_fits(frame, ["k"], "t", "y", ["spi"], "swe", 4, 24)
    best = months.best_fit(fits, ["k"]).first()
    assert best.lag == 2 and best.b_swe == pytest.approx(3, abs=0.05) and best.b_spi == pytest.approx(2, abs=0.05) and best.r2 > 0.99
    assert months.best_lag(fits.withColumn("zone", F.lit("z")), "zone").first().lag == 2


def test_decomposition(spark):
    rows = [(1, f"{2000 + i // 12}-{i % 12 + 1:02d}-01", 0.5 * i + math.sin(2 * math.pi * i / 12)) for i in range(60)]
    frame = spark.createDataFrame(rows, "k int, m string, v double").withColumn("m", F.to_date("m"))
    got = months.classical_decomposition(frame, ["k"], "m", "v").orderBy("m").collect()
    assert got[0].trend is None and all(abs(r.rest) < 1e-9 and abs(r.trend - 0.5 * i) < 1e-9 for i, r in enumerate(got) if r.trend is not None)


def test_effective_support(spark):
    frame = spark.createDataFrame([(1, i, w) for i, w in enumerate([0.5, -0.3, 0.2, 1e-14])], "k int, cell int, w double")
    assert sorted(r.cell for r in months.effective_support(frame, ["k"]).collect()) == [0, 1, 2]


def test_permutation_uses_each_value_once(spark):
    frame = spark.createDataFrame([(float(i), float(i % 7)) for i in range(500)], "a double, b double")
    n = learn.numbered(frame, F.xxhash64("a", "b"), "n").collect()
    assert sorted(r.n for r in n) == list(range(1, 501))


def test_guards(spark):
    with pytest.raises(Exception, match="specific yield"):
        spark.range(1).select(hydro.checked_specific_yield(F.lit(1e-5))).collect()
    with pytest.raises(ValueError):
        hydro.saturated_conductivity("saxton_rawls", sand_pct=F.lit(1.0))
    with pytest.raises(ValueError):
        hydro.converted_range(-1.0, 1.5)
    assert hydro.converted_range(3.0, 1.5) == 6.0 and hydro.microergodic(2.0, 3.0, 0.5) == pytest.approx(4 / 3)
    a = spark.createDataFrame([(1, 1, 2.0)], "i int, j int, cov double")
    with pytest.raises(Exception, match="covariances differ"):
        evaluation.same_covariances(a, a.withColumn("j", F.lit(2))).collect()
    with pytest.raises(Exception, match="not on"):
        grid.on_domain(spark.createDataFrame([(5, 0)], "row int, col int"), grid.domain_of(0, 0, 20, 20, 10.0)).collect()


def test_sites(spark):
    frame = spark.createDataFrame([("a", 47.0, -122.0, 3.0, False, False), ("b", 47.0, -122.0, None, False, False), ("c", 47.0, -122.0, 3.0, True, False)], "site string, lat double, lon double, l double, is_sparse_timeseries boolean, has_long_gap boolean")
    assert [r.site for r in wells.usable_sites(frame, "l").collect()] == ["a"]
    with pytest.raises(KeyError):
        wells.usable_sites(frame.drop("lat"), "l")
    mask = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "row int, col int, mask int")
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)], "row int, col int, v double")
    assert [r.v for r in grid.masked(cells, mask, "v").orderBy("col").collect()] == [1.0, None, None]

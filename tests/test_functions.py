"""Hand cases of the expressions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from strataflow.functions import classify, core, hydro, normal
from strataflow.operators import folds, series, spatial, wells


def test_hydro_class(spark):
    rows = [(5.0, False), (20.0, False), (45.0, False), (80.0, False), (200.0, True), (None, False)]
    got = [r[0] for r in spark.createDataFrame(rows, "d double, deep boolean").select(classify.hydro_class("d", "deep")).collect()]
    assert got == ["shallow_watertable", "shallow_watertable", "ambiguous", "deep_confined", "deep_confined", "ambiguous"]


def test_measurement_target(spark):
    cases = [
        (10.0, None, None, None, False, False, "water_table"),
        (40.0, 6.0, 12.0, None, False, False, "water_table"),
        (40.0, 80.0, 95.0, None, False, False, "aquifer_head"),
        (12.0, None, None, "C", False, False, "aquifer_head"),
        (15.0, None, None, "U", True, False, "unknown"),
        (150.0, None, None, None, False, True, "aquifer_head"),
        (45.0, None, None, None, False, False, "unknown"),
        (None, None, None, None, None, None, "unknown"),
        (150.0, None, None, None, True, False, "aquifer_head"),
        (10.0, None, None, "C", True, False, "aquifer_head"),
    ]
    df = spark.createDataFrame(cases, "d double, t double, b double, c string, f boolean, p boolean, want string")
    got = df.select(classify.measurement_target(*map(F.col, "dtbcfp")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_domains(spark):
    cases = [(2, 0, 1e6, 0), (30, 0, 1e6, 1), (120, 1, 1e6, 2), (200, 2, 1e6, 3), (60, 3, 1e6, 4), (1, 0, 500, 5), (2, 0, 300, 5), (50, 1, 300, 2), (2, None, 1e6, 255)]
    df = spark.createDataFrame([(float(a), b, float(c), d) for a, b, c, d in cases], "h double, l int, c double, want int")
    assert all(r.g == r.want for r in df.select(classify.domain_class(F.col("h"), F.col("l"), F.col("c")).alias("g"), "want").collect())


def test_coverage_hand_case(spark):
    months = spark.createDataFrame([("a", 2020, 1), ("a", 2020, 2), ("a", 2020, 6), ("b", 2020, 1)], "site string, year int, month int")
    got = {r.site: r for r in wells.coverage(months, "site").collect()}
    a, b = got["a"], got["b"]
    assert (a.n_possible_months, a.n_observed_months, a.coverage_fraction, a.max_gap_months, a.record_span_years) == (6, 3, 0.5, 3, 0.5)
    assert (b.coverage_fraction, b.max_gap_months, b.record_span_years) == (1.0, 0, 0.08)


def test_no_nan_and_nodata(spark):
    df = core.no_nan(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int"))
    assert [r.x for r in df.orderBy("k").collect()] == [None, 2.0]
    assert df.select(core.nodata_to_null("x", 2.0).alias("y")).filter("y is not null").count() == 0


def test_bucket_case(spark):
    rows = [(0, i, p, e) for i, (p, e) in enumerate(zip([300.0, 0, 0, 0, 0, 0], [10.0] + [60.0] * 5))]
    df = spark.createDataFrame([(a, b, float(c), d) for a, b, c, d in rows], "k int, t int, p double, e double")
    theta = [r.theta for r in folds.total_bucket(df, ["k"], "t", "p", "e", 0.10, 0.25, 0.45).orderBy("t").collect()]
    assert theta[0] > 0.25 and theta[5] < theta[0] and all(0.10 <= x <= 0.45 for x in theta)


def test_snow_conserves_mass(spark):
    p, t = [100.0, 0, 0, 0, 0, 0], [-5.0, -2.0, 1.0, 4.0, 8.0, 12.0]
    df = spark.createDataFrame([(0, i, float(a), b) for i, (a, b) in enumerate(zip(p, t))], "k int, t int, p double, c double")
    out = [r.liquid for r in folds.snow_liquid(df, ["k"], "t", "p", "c", 30.0).orderBy("t").collect()]
    assert out[0] < 5 and sum(out[2:]) > 50 and sum(out) == pytest.approx(100)


def test_thornthwaite_mather(spark):
    for p, e, ok in ((160.0, 20.0, lambda w: w > 0.9), (3.0, 130.0, lambda w: w < 0.1)):
        df = spark.createDataFrame([(0, i, p, e) for i in range(8)], "k int, t int, p double, e double")
        assert ok(folds.thornthwaite_mather(df, ["k"], "t", "p", "e", 100.0).orderBy("t").collect()[-1].wetness)


def test_baseflow_invariants(spark):
    q = [5.0, 5, 9, 30, 12, 7, 6, 5]
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(q)] + [(1, i, 4.0) for i in range(6)], "k int, t int, q double")
    rows = folds.baseflow(df, ["k"], "t", "q").collect()
    assert all(-1e-12 <= r.baseflow <= r.q + 1e-12 for r in rows)
    assert all(r.baseflow == r.q for r in rows if r.k == 1)


def test_normal(spark):
    df = spark.createDataFrame([(0.0,), (1.96,)], "z double").select(normal.norm_cdf("z").alias("p"))
    got = [r.p for r in df.collect()]
    assert got[0] == 0.5 and got[1] == pytest.approx(0.975, abs=1e-4)
    c = spark.createDataFrame([(0.0,)], "y double").select(normal.crps(F.col("y"), F.lit(0.0), F.lit(0.5)).alias("a"), normal.crps(F.col("y"), F.lit(0.0), F.lit(3.0)).alias("b")).first()
    assert 0 < c.a < c.b


def test_envelope_and_pressure(spark):
    df = spark.createDataFrame([(85.0, 5.0), (40.0, 20.0), (15.0, 50.0)], "s double, c double")
    rows = df.select(*[v.alias(k) for k, v in hydro.saxton_rawls("s", "c").items()]).collect()
    assert all(r.theta_wp < r.theta_fc < r.theta_sat for r in rows) and rows[0].ksat_mm_h > rows[2].ksat_mm_h
    z = spark.createDataFrame([(102.0,), (100.0,), (99.0,), (95.0,)], "z double").select(hydro.pore_pressure(F.lit(100.0), F.col("z")).alias("p")).collect()
    assert [r.p for r in z] == [0.0, 0.0, 9806.65, 5 * 9806.65]  # standard gravity, 9.80665


def test_albers_origin(spark):
    x, y = hydro.albers(F.lit(-96.0), F.lit(23.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x) < 1e-6 and abs(r.y) < 1e-6


def test_near_pairs_equal_all_pairs(spark):
    cells = spark.createDataFrame([(i, i % 7 * 1.3, i // 7 * 0.9) for i in range(49)], "cell int, x double, y double")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, -2.0, 3.0), (2, 6.5, 5.5)], "pid int, px double, py double")
    got = {(r.cell, r.pid) for r in spatial.near_pairs(cells, points, 3.0).collect()}
    want = {(c.cell, p.pid) for c in cells.collect() for p in points.collect() if math.hypot(c.x - p.px, c.y - p.py) <= 3.0}
    assert got == want


def test_asof_nearest(spark):
    left = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-02 12:00:00'), (2, TIMESTAMP_NTZ '2024-03-01 00:00:00') t(k, ts)")
    right = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01 23:00:00', 5.0D), (1, TIMESTAMP_NTZ '2024-01-03 00:30:00', 7.0D) t(k, ts2, v)")
    assert {r.k: r.nearest_v for r in series.asof_nearest(left, right, ["k"], "ts", "ts2", "v").collect()} == {1: 7.0, 2: None}

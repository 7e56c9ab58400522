"""Invariants of the operators without an SQL form."""

import math

import numpy as np
import pytest

from strataflow.operators import folds, geostat
from strataflow.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_kriging_is_exact_at_data():
    rng = np.random.default_rng(2)
    x, y, v = rng.uniform(0, 10, 12), rng.uniform(0, 10, 12), rng.normal(size=12)
    z, sd = geostat.krige_block(x, y, v, x, y, (0.0, 1.0, 6.0))
    assert np.allclose(z, v, atol=1e-8) and np.allclose(sd, 0, atol=1e-5)
    z, sd = geostat.krige_block(x, y, np.full(12, 3.0), np.array([50.0]), np.array([50.0]), (0.1, 1.0, 6.0))
    assert z[0] == pytest.approx(3.0) and sd[0] > 0.9


def test_blue():
    x = np.array([0.0, 30.0])
    mean, red, dfs = geostat.blue(x, x * 0, np.array([0.0]), np.array([0.0]), np.array([1.0]), np.array([1e-6]), 2.0, 5.0)
    assert mean[0] == pytest.approx(1.0, abs=1e-6) and abs(mean[1]) < 1e-3
    assert red[0] == pytest.approx(4.0, abs=1e-4) and dfs == pytest.approx(1.0, abs=1e-6)


def test_budget_balances(spark):
    rows = [(0, i, max(0.0, 60 + 50 * math.sin(2 * math.pi * (i - 2) / 12)), max(0.0, 50 + 45 * math.sin(2 * math.pi * i / 12))) for i in range(48)]
    df = spark.createDataFrame(rows, "k int, t int, p double, e double")
    out = folds.coupled_budget(df, ["k"], "t", "p", "e", 0.10, 0.28, 0.45, 5.0).orderBy("t").collect()
    before = 280.0
    for (_, _, p, _), r in zip(rows, out):
        assert r.theta * 1000 - before == pytest.approx(r.cap_rise + p - r.runoff - r.aet - r.recharge, abs=1e-6)
        before = r.theta * 1000


def test_hysteresis_stays_between_curves(spark):
    path = [*np.linspace(0.3, 0.8, 20), *np.linspace(0.8, 0.4, 20), *np.linspace(0.4, 0.7, 20)]
    df = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(path)], "k int, t int, se double")
    got = [r.suction for r in folds.hysteretic_suction(df, ["k"], "t", "se", 0.05, 1.8).orderBy("t").collect()]
    curve = lambda s, a: (1 / a) * (s ** (-1 / (1 - 1 / 1.8)) - 1) ** (1 / 1.8)
    assert all(curve(s, 0.1) - 1e-9 <= h <= curve(s, 0.05) + 1e-9 for s, h in zip(path, got))
    same = [r.suction for r in folds.hysteretic_suction(df, ["k"], "t", "se", 0.05, 1.8, ratio=1.0).orderBy("t").collect()]
    assert np.allclose(same, [curve(s, 0.05) for s in path])


def test_forest_finds_the_driver(spark):
    got = {r.feature: r.importance for r in QUERIES["permutation_importance"](spark, SF).collect()}
    assert set(got) == {"row", "col", "hand"} and max(got, key=got.get) == "hand"
    assert all(r.tree_sd >= 0 for r in QUERIES["rf_spread"](spark, SF).collect())

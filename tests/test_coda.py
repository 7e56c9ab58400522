"""Correlation, stretching, depth separation and sensitivity against plain numpy; seasonal decomposition against scalars."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import coda, loess

RATE = 20.0


def test_band_pass_keeps_its_band():
    t = np.arange(4000) / RATE
    inside, outside = np.sin(2 * np.pi * 1.0 * t), np.sin(2 * np.pi * 6.0 * t)
    got = coda.band_passed(inside + outside, RATE, 0.5, 2.0)
    assert np.abs(got - inside)[200:-200].max() < 0.02


def test_correlation_by_hand():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=37), rng.normal(size=30)
    want = [sum(a[i + k] * b[i] for i in range(30) if 0 <= i + k < 37) for k in range(-9, 10)]
    assert np.allclose(coda.correlated(a, b, 9), np.array(want) / math.sqrt((a @ a) * (b @ b)))
    assert coda.correlated(a, a, 3)[3] == pytest.approx(1.0) and not coda.correlated(a, 0 * b, 3).any()


def test_a_known_stretch_is_found(spark):
    rng = np.random.default_rng(1)
    lags = np.arange(-800, 801) / RATE
    wave = sum(rng.normal() * np.cos(2 * np.pi * f * lags + rng.random() * 6) for f in np.linspace(0.4, 3, 60)) * np.exp(-np.abs(lags) / 25)
    rows = [("a", "b", 0, wave.tolist())] + [("a", "b", k, np.interp(lags * (1 + e), lags, wave).tolist()) for k, e in ((1, 0.004), (2, -0.011))]
    ccfs = spark.createDataFrame(rows, "a string, b string, epoch int, ccf array<double>")
    reference = ccfs.filter("epoch = 0").select("a", "b", F.col("ccf").alias("reference"))
    got = coda.velocity_changes(ccfs, reference, RATE, [(0.5, 1.0), (1.0, 2.0)], [(5.0, 25.0), (100.0, 200.0)]).collect()
    assert len(got) == 12
    for r in got:
        if r["coda_from"] > 50:
            assert r["dvv"] is None and r["cc"] is None
        else:
            # stretching t by (1 + e) undoes a compression by as much
            assert r["dvv"] == pytest.approx({0: 0.0, 1: -0.004, 2: 0.011}[r["epoch"]], abs=3e-4) and r["cc"] > 0.98


def test_chain_and_ensemble(spark):
    rng = np.random.default_rng(2)
    shared = rng.normal(size=3000)
    rows = [(s, e, (np.roll(shared, 40 * s) + 0.3 * rng.normal(size=3000)).tolist()) for s in range(3) for e in range(3)] + [(9, 0, None)]
    traces = coda.preprocessed(spark.createDataFrame(rows, "station int, epoch int, samples array<double>"), RATE, 0.2, 5.0)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 2), (1, 9)], "a int, b int")
    ccfs = coda.correlations(traces, pairs, RATE, 10.0)
    found = {(r["a"], r["b"], r["epoch"]): np.array(r["ccf"]) for r in ccfs.collect()}
    assert len(found) == 9 and all(len(c) == 401 for c in found.values())
    assert found[0, 1, 0].argmax() - 200 == -40 and found[0, 2, 1].argmax() - 200 == -80 and found[2, 2, 0][200] == pytest.approx(1)
    stack = {(r["a"], r["b"]): np.array(r["reference"]) for r in coda.stacked(ccfs).collect()}
    assert np.allclose(stack[0, 1], np.mean([found[0, 1, e] for e in range(3)], 0))
    members = coda.velocity_changes(ccfs, coda.stacked(ccfs), RATE, [(0.5, 2.0)], [(1.0, 6.0), (2.0, 9.0)])
    sigma = coda.stretching_error(*[F.col(c) for c in ("cc", "low", "high", "coda_from", "coda_to")])
    keys = ["a", "b", "epoch"]
    members = members.withColumn("sigma", sigma)
    rows = members.collect()
    for r in coda.ensemble(members, keys).collect():
        mine = [m for m in rows if all(m[k] == r[k] for k in keys)]
        d, s = np.array([m["dvv"] for m in mine]), np.array([m["sigma"] for m in mine])
        assert r["mean"] == pytest.approx(d.mean()) and r["total"] == pytest.approx(math.sqrt((s**2).mean() + d.var())) and r["n"] == 2


def test_depth_is_the_dense_formula(spark):
    depths = np.linspace(0.02, 1.0, 25)
    bands = spark.createDataFrame([(i, f) for i, f in enumerate((0.5, 1.0, 2.0, 4.0, 8.0))], "band int, f double")
    layers = spark.createDataFrame([(float(z), 0.04) for z in depths], "depth double, thick double")
    kernels = coda.band_kernels(bands, layers)
    g = np.zeros((5, 25))
    for r in kernels.collect():
        g[r["band"], int(np.abs(depths - r["depth"]).argmin())] = r["k"] * r["thick"]
    assert np.allclose(g.sum(1), 1)
    rng = np.random.default_rng(3)
    data = [(k, b, float(rng.normal() * 1e-3), 2e-4 * (b + 1)) for k in ("p", "q") for b in range(5)]
    measured = spark.createDataFrame([*data, ("p", 4, None, 1.0), ("r", 1, None, 1.0)], "k string, band int, dvv double, sigma double")
    profiles = coda.depth_profiles(measured, kernels, ["k"])
    got = profiles.collect()
    assert {r["k"] for r in got} == {"p", "q"}
    c = 25e-6 * np.exp(-np.abs(depths[:, None] - depths) / 0.1)
    for k in ("p", "q"):
        d, s = np.array([x[2] for x in data if x[0] == k]), np.array([x[3] for x in data if x[0] == k])
        inverse = np.linalg.inv(g @ c @ g.T + np.diag(s**2))
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["depth"])
        assert np.allclose([r["mean"] for r in mine], c @ g.T @ inverse @ d)
        assert np.allclose([r["sd"] for r in mine], np.sqrt(np.diag(c - c @ g.T @ inverse @ g @ c)))
        assert sum(r["resolution"] for r in mine) == pytest.approx(np.trace(g @ c @ g.T @ inverse))
        part = coda.separated(profiles.filter(F.col("k") == k), ["k"], F.lit(0.3)).first()
        assert part["moisture"] == pytest.approx(np.mean([r["mean"] for r in mine if r["depth"] <= 0.3])) and part["top_sd"] == pytest.approx(mine[0]["sd"])


def test_sensitivity(spark):
    cells = spark.createDataFrame([(i * 30 + j, float(j), float(i)) for i in range(20) for j in range(30)], "cell long, x double, y double")
    pairs = [(0, 5.0, 9.5, 24.0, 9.5), (1, 24.0, 9.5, 5.0, 9.5), (2, 14.5, 3.0, 14.5, 3.0)]
    frame = spark.createDataFrame(pairs, "pair int, ax double, ay double, bx double, by double")
    y, x = (v.ravel().astype(float) for v in np.mgrid[0:20, 0:30])
    u = (np.arange(24) + 0.5) * 10 / 24
    p = lambda r, t: np.exp(-(r**2) / (32 * t)) / (32 * np.pi * t)
    want = np.zeros(600)
    for _, ax, ay, bx, by in pairs:
        k = sum(p(np.hypot(x - ax, y - ay), t) * p(np.hypot(x - bx, y - by), 10 - t) for t in u)
        want += k / k.sum()
    for tile, parts in ((7.0, 2), (100.0, 1)):
        found = coda.network_sensitivity(cells, frame, tile=tile, parts=parts)
        got = np.array([r["sensitivity"] for r in found.orderBy("cell").collect()])
        assert np.allclose(got, want) and got.sum() == pytest.approx(3)
    one = {r["cell"]: r["sensitivity"] for r in coda.network_sensitivity(cells, frame.filter("pair = 0")).collect()}
    assert all(one[i * 30 + j] == pytest.approx(one[i * 30 + 29 - j]) for i in range(20) for j in range(30))  # from one station as from the other
    sigma = {r["cell"]: r["sigma"] for r in coda.relative_sigma(found.withColumn("sensitivity", F.when(F.col("cell") == 0, 0.0).otherwise(F.col("sensitivity")))).collect()}
    assert sigma[0] == math.inf and min(sigma.values()) == 1


def line_at(y, weight, window, at):
    """Local regression at one place, written out."""
    n = len(y)
    d = sorted(abs(i - at) for i in range(n))
    reach = d[min(window, n) - 1] + (max(window - n, 0) // 2)
    w = []
    for i in range(n):
        u = abs(i - at) / max(reach, 1e-12)
        w.append((1.0 if u <= 0.001 else (1 - u**3) ** 3 if u < 0.999 else 0.0))
    both = [a * b for a, b in zip(w, weight)]
    w = both if sum(both) > 0 else w
    total = sum(w)
    w = [v / total for v in w]
    centre = sum(v * i for i, v in enumerate(w))
    spread = sum(v * (i - centre) ** 2 for i, v in enumerate(w))
    tilt = (at - centre) / spread if spread > (0.001 * (n - 1)) ** 2 else 0.0
    return sum(v * (1 + tilt * (i - centre)) * y[i] for i, v in enumerate(w))


@pytest.mark.parametrize("window", [5, 23, 61])
def test_local_regression_by_scalars(window):
    rng = np.random.default_rng(4)
    y, weight = rng.normal(size=40), rng.random(40) * (rng.random(40) > 0.2)
    at = np.arange(-1.0, 41.0)
    assert np.allclose(loess.loess(y, weight, window, at), [line_at(y, weight, window, a) for a in at])


def test_seasonal_trend(spark):
    months = np.arange(120)
    season, trend = 3 * np.sin(2 * np.pi * months / 12), 0.05 * months + 2
    y = season + trend
    y[50] += 40  # one wild value
    rows = [(1, int(m), float(v), "x") for m, v in zip(months, y)] + [(2, int(m), float(m % 12) if m != 30 else None, "x") for m in range(60)] + [(3, 0, 1.0, "x")]
    df = spark.createDataFrame(rows, "k int, m int, v double, trend string")
    got = loess.seasonal_trend(df, ["k"], "m", "v").collect()
    one = sorted((r for r in got if r["k"] == 1), key=lambda r: r["m"])
    assert max(abs(r["seasonal"] - season[r["m"]]) for r in one) < 0.15 and max(abs(r["trend"] - trend[r["m"]]) for r in one) < 0.15
    assert one[50]["weight"] < 1e-3 and one[50]["rest"] > 39 and all(r["v"] == pytest.approx(r["seasonal"] + r["trend"] + r["rest"]) for r in one)
    two = {r["m"]: r for r in got if r["k"] == 2}
    assert two[30]["trend"] is None and two[0]["trend"] is not None and two[59]["trend"] is not None and len(two) == 60
    assert [r["weight"] for r in got if r["k"] == 3] == [None]

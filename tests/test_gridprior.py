"""The raster prior against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import gridprior as gp
from strataflow.operators import priors

NY, NX, DY, DX = 40, 50, 0.7, 1.1
ROW, COL = (a.ravel() for a in np.meshgrid(np.arange(NY), np.arange(NX), indexing="ij"))
XY = np.stack([COL * DX, ROW * DY], 1)


def raster(spark):
    return spark.createDataFrame([(int(r), int(c), int(r * NX + c), float(c * DX), float(r * DY), "ab"[int(c) // 20 % 2] if (r + c) % 7 else None, 1 + 0.01 * float(r)) for r, c in zip(ROW, COL)],
                                 "row int, col int, cell long, x double, y double, region string, scale double")


def dense(nu, masked=False, scaled=False):
    c = priors.covariance(XY, XY, 1.3, 4.0, nu)
    if masked:
        region = np.array(["ab"[k // 20 % 2] if (r + k) % 7 else "" for r, k in zip(ROW, COL)])
        c = c * (region[:, None] == region[None, :])
    if scaled:
        s = 1 + 0.01 * ROW
        c = c * s[:, None] * s[None, :]
    return c


def as_array(rows, name="value"):
    out = np.full(NY * NX, np.nan)
    for r in rows:
        out[r["row"] * NX + r["col"]] = r[name] if r[name] is not None else np.nan
    return out


@pytest.mark.parametrize("nu", [0.5, 1.5, 2.5, float("inf")])
def test_product_is_dense(spark, nu):
    rng = np.random.default_rng(1)
    v = {"p": rng.normal(size=NY * NX), "q": np.where(rng.random(NY * NX) < 0.01, 1.0, 0.0)}
    fields = spark.createDataFrame([(k, int(r), int(c), float(x)) for k, f in v.items() for r, c, x in zip(ROW, COL, f) if x], "k string, row int, col int, value double")
    got = gp.grid_product(fields, ["k"], (NY, NX), (DY, DX), 1.3, 4.0, nu).collect()
    for k, f in v.items():
        assert np.abs(as_array([r for r in got if r["k"] == k]) - dense(nu) @ f).max() < 1e-9


def test_masked_and_scaled(spark):
    f = np.random.default_rng(2).normal(size=NY * NX)
    fields = spark.createDataFrame([("p", int(r), int(c), float(x)) for r, c, x in zip(ROW, COL, f)], "k string, row int, col int, value double")
    got = gp.prior_product(fields, raster(spark), ["k"], (NY, NX), (DY, DX), 1.3, 4.0, 1.5, "region", "scale").collect()
    assert np.abs(as_array(got) - dense(1.5, True, True) @ f).max() < 1e-9


def footprints(spark, keys=True):
    rng = np.random.default_rng(3)
    rows = []
    for obs in range(6):
        for _ in range(4):
            r, c = int(rng.integers(0, NY)), int(rng.integers(0, NX))
            rows.append((obs % 2, obs, r, c, 0.25, 0.1 + obs / 50))
    return rows, spark.createDataFrame(rows, "k int, obs long, row int, col int, w double, noise double")


@pytest.mark.parametrize("masked", [False, True])
def test_resolution_is_dense(spark, masked):
    rows, feet = footprints(spark)
    got = gp.grid_resolution(raster(spark), feet, ["k"], (NY, NX), (DY, DX), 1.3, 4.0, 1.5, "region" if masked else None, "scale", tile=16).collect()
    assert len(got) == 2 * NY * NX
    c = dense(1.5, masked, True)
    for k in (0, 1):
        obs = sorted({r[1] for r in rows if r[0] == k})
        g, noise = np.zeros((len(obs), NY * NX)), np.zeros(len(obs))
        for kk, o, r, col, w, n in rows:
            if kk == k:
                g[obs.index(o), r * NX + col] += w
                noise[obs.index(o)] = n
        mine = [r for r in got if r["k"] == k]
        # The scale is in the dense diagonal too.
        assert np.abs(as_array(mine, "resolved") - priors.resolved(c, g, noise)).max() < 1e-9
        want = priors.resolution_width(priors.averaging_kernel(c, g, noise), XY)
        have = as_array(mine, "width")
        # Where all weights are rounding errors of the transform, a width means nothing.
        some = np.abs(priors.averaging_kernel(c, g, noise)).sum(1) > 1e-9
        assert some.sum() > 500 and np.abs(have - want)[some].max() < 1e-5


def test_without_keys(spark):
    rows, feet = footprints(spark)
    got = gp.grid_resolution(raster(spark), feet.drop("k"), [], (NY, NX), (DY, DX), 1.3, 4.0).collect()
    g, noise = np.zeros((6, NY * NX)), np.zeros(6)
    for _, o, r, col, w, n in rows:
        g[o, r * NX + col] += w
        noise[o] = n
    assert np.abs(as_array(got, "resolved") - priors.resolved(dense(1.5), g, noise)).max() < 1e-9


def test_cells_anywhere(spark):
    rng = np.random.default_rng(4)
    n = 300
    xy, region = rng.random((n, 2)) * 30, rng.integers(0, 3, n)
    cells = spark.createDataFrame([(i, float(a), float(b), int(r) or None) for i, ((a, b), r) in enumerate(zip(xy, region))], "cell long, x double, y double, region int")
    w = {("u", 1): rng.normal(size=n), ("v", 2): np.where(rng.random(n) < 0.05, 1.0, 0.0)}
    vectors = spark.createDataFrame([(*k, i, float(x)) for k, v in w.items() for i, x in enumerate(v) if x] + [("v", 2, 0, None)], "a string, b int, cell long, w double")
    c = priors.covariance(xy, xy, 2.0, 3.0, 2.5) * (region[:, None] == region[None, :])
    got = gp.masked_product(cells, vectors, ["a", "b"], 2.0, 3.0, 2.5, "region", tile=7.0, spread=3).collect()
    for (a, b), v in w.items():
        out = np.zeros(n)
        for r in got:
            if (r["a"], r["b"]) == (a, b):
                out[r["cell"]] = r["value"]
        assert np.abs(out - c @ v).max() < 1e-9


def test_only_complete_rasters(spark):
    assert gp.raster_of(raster(spark)) == pytest.approx((NY, NX, DY, DX))
    for wrong in (raster(spark).filter("cell <> 7"), raster(spark).unionByName(raster(spark).limit(1)), raster(spark).withColumn("x", F.col("x") * F.col("x")), raster(spark).limit(0)):
        with pytest.raises(ValueError):
            gp.raster_of(wrong)


def test_cells_outside_are_refused(spark):
    with pytest.raises(Exception, match="not all in a raster"):
        gp.grid_product(spark.createDataFrame([(1, 0, 50, 1.0)], "k int, row int, col int, value double"), ["k"], (NY, NX), (DY, DX), 1.0, 1.0).collect()

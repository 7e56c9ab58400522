"""Queries on tables of many rows of cells and of stations at the same places, against their SQL or forms that don't merge copies."""

import duckdb
import numpy as np
import pytest
from oracle import difference, tables

from strataflow import plans
from strataflow.operators import coda, geostat, gridprior, priors, spatial


def made(folder, cells, stations):
    """part and supplier with these keys."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT p_partkey, p_partkey % 7 AS name, CAST(p_partkey * 31 % 50 AS INTEGER) AS p_size, 900.0::DOUBLE + p_partkey * 7919 % 1000 AS p_retailprice FROM (SELECT unnest({[*cells]}::BIGINT[]) AS p_partkey)) TO '{folder}/part.parquet'")
    con.sql(f"COPY (SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey * 7919 % 20000 - 9000) / 2.0::DOUBLE END AS s_acctbal FROM (SELECT unnest({[*stations]}::BIGINT[]) AS s_suppkey)) TO '{folder}/supplier.parquet'")
    return str(folder)


def differs(spark, name, folder):
    return difference(spark, tables(folder), plans.QUERIES[name], plans.SQL[name], folder)


def test_places_off_the_earth(spark, tmp_path):
    assert differs(spark, "regrid_projected", made(tmp_path, (40 * r + c for r in range(0, 1200, 12) for c in range(0, 40, 2)), [1])) == ""


def test_footprint_covariance_of_many_blocks(spark):
    """Pairs of blocks, regions, scales, keys, repeated entries and cells that there are not, against the products on the raster."""
    rng = np.random.default_rng(5)
    cells = spark.createDataFrame([(r, c, "ab"[c // 5 % 2] if (r + c) % 7 else None, 1 + 0.01 * r) for r in range(12) for c in range(15) if (r * c) % 11 != 3], "row int, col int, region string, scale double")
    rows = [(k, f"o{rng.integers(0, 20)}", int(rng.integers(0, 12)), int(rng.integers(0, 15)), float(rng.random())) for k in (0, 1) for _ in range(70)]
    feet = spark.createDataFrame(rows + rows[:3], "k int, obs string, row int, col int, w double")
    for region, scale in ((None, None), ("region", "scale")):
        columns = gridprior.prior_product(feet.withColumnRenamed("w", "value"), cells, ["k", "obs"], (12, 15), (0.7, 1.1), 1.3, 4.0, 1.5, region, scale)
        want = {tuple(r[:3]): r[3] for r in gridprior.observed_covariance(feet, columns, ["k"]).filter("obs <= other").collect()}
        for block in (3, 256):
            got = {tuple(r[:3]): r[3] for r in gridprior.footprint_covariance(feet, cells, ["k"], (0.7, 1.1), 1.3, 4.0, 1.5, region, scale, block).collect()}
            assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_stations_at_one_place(spark, tmp_path, monkeypatch):
    """Each pair of stations is there, while the covariances asked for are of places only."""
    asked, whole = [], gridprior.footprint_covariance
    monkeypatch.setattr(gridprior, "footprint_covariance", lambda feet, *a, **b: asked.append(feet.select("obs").distinct().count()) or whole(feet, *a, **b))
    folder = made(tmp_path, range(2500), [100 * k + j for k in range(4) for j in (0, 7, 9, 31)])
    assert differs(spark, "observed_prior", folder) == "" and asked == [4]


def counting(monkeypatch, module, name, at):
    """A list that gets the number of rows of an argument of each call of module.name."""
    seen, whole = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: seen.append(a[at].count()) or whole(*a, **b))
    return seen


STATIONS = [100 * k + j for k in range(4) for j in (0, 7, 9, 31)]


def test_resolution_needs_no_products_on_the_raster(spark, tmp_path, monkeypatch):
    """Equal to stations that are not merged, by dense matrices; prior_product() is not called."""
    monkeypatch.setattr(gridprior, "prior_product", None)
    folder = made(tmp_path, range(2080), STATIONS)
    got = {(r.zone, r.cell): r for r in plans.QUERIES["resolution_map"](spark, folder).collect()}
    xy = np.array([(c % 40, c // 40) for c in range(2080)], float)
    pid = np.array(STATIONS)
    px, py = pid * 37 % 100 * 0.4, pid * 53 % 100 * 0.5
    d2 = (xy[:, 0] + 0.5 - px[:, None]) ** 2 + (xy[:, 1] + 0.5 - py[:, None]) ** 2
    w = np.where(d2 <= 9, np.exp(-d2 / 2), 0)
    w = w[w.sum(1) > 0]
    w /= w.sum(1, keepdims=True)
    assert len(got) == 2080 and len(w) == len(STATIONS)
    for zone in range(4):
        mine = np.flatnonzero(xy[:, 1] % 4 == zone)
        g = w[:, mine][w[:, mine].sum(1) > 0]
        prior, noise = priors.covariance(xy[mine], xy[mine], 1.0, 3.0), np.full(len(g), 0.1)
        assert np.abs(priors.resolved(prior, g, noise) - [got[zone, c].resolved for c in mine]).max() < 1e-9
        width = priors.resolution_width(priors.averaging_kernel(prior, g, noise), xy[mine])
        assert np.abs(width - [got[zone, c].width for c in mine]).max() < 1e-6


def test_updates_merge_what_lies_at_one_place(spark, monkeypatch):
    rng = np.random.default_rng(7)
    obs = [(0, float(i % 5), float(i % 3), float(rng.normal()) if i % 9 else None, float(0.2 + i % 4)) for i in range(90)] + [(0, 9.0, 9.0, 1.5, 0.0)]
    cells = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((40, 2)) * 10)]
    seen = counting(monkeypatch, geostat, "by_block", 1)
    found = geostat.blue_groups(spark.createDataFrame(obs, "g int, px double, py double, v double, s double"), spark.createDataFrame(cells, "g int, cell long, x double, y double"), ["g"], "v", "s", 2.0, 12.0).orderBy("cell").toPandas()
    o, c = np.array([x for x in obs if x[3] is not None], float), np.array(cells, float)
    mean, reduction, dfs = geostat.blue(c[:, 2], c[:, 3], *o[:, 1:].T, 2.0, 12.0)
    assert np.abs(found["mean"] - mean).max() < 1e-8 and np.abs(found["reduction"] - reduction).max() < 1e-8 and np.abs(found["dfs"] - dfs).max() < 1e-8
    assert seen == [16]


def test_losses_together(spark):
    rng = np.random.default_rng(8)
    xy, y = rng.random((30, 2)) * 20, rng.normal(size=30)
    lengths, nuggets = np.array([0.7, 5.0, 150.0]), np.array([1e-4, 0.3, 0.95])
    d = np.hypot(xy[:, None, 0] - xy[:, 0], xy[:, None, 1] - xy[:, 1])
    for nu in (0.5, 1.5, 2.5):
        assert priors.reml_losses(d, y, lengths, nu, nuggets) == pytest.approx([priors.reml(xy, y, a, nu, b)[0] for a, b in zip(lengths, nuggets)], rel=1e-9)


def test_small_groups_are_spread(spark, tmp_path):
    """Fits take much work for few bytes; they aren't put together in one task."""
    found = plans.QUERIES["fitted_priors"](spark, made(tmp_path, [1], range(1, 201)))
    assert found.count() == 12
    points = spark.createDataFrame([(i // 12, float(i % 12), float(i * i % 12), float(i * 37 % 11)) for i in range(120)], "zone long, px double, py double, v double")
    assert priors.matern_groups(points, ["zone"], "v", nus=(0.5,)).rdd.getNumPartitions() > 8


def test_profiles_are_sorted_once(spark, tmp_path):
    folder = made(tmp_path, range(500), [1])
    assert differs(spark, "profile_vs30", folder) == ""
    assert plans.QUERIES["profile_vs30"](spark, folder)._jdf.queryExecution().analyzed().toString().count("array_sort") == 1


def test_sensitivity_of_pairs_of_places(spark, tmp_path, monkeypatch):
    folder = made(tmp_path, range(1200), STATIONS)
    seen = counting(monkeypatch, coda, "network_sensitivity", 1)
    assert differs(spark, "coda_sensitivity", folder) == "" and seen[0] <= 10


def test_variogram_of_places(spark, tmp_path, monkeypatch):
    """With null values; rows of one pid are no pair."""
    folder = made(tmp_path, [1], [*STATIONS, *STATIONS[:3], 11, 22, 33])
    seen = counting(monkeypatch, spatial, "near_pairs", 0)
    assert differs(spark, "semivariogram_bins", folder) == "" and seen[0] == 7


def test_a_grid_meets_its_coarse_form_once(spark, tmp_path):
    folder = made(tmp_path, [c for c in range(3000) if c % 17], [1])
    assert differs(spark, "grid_convergence", folder) == ""
    plan = plans.QUERIES["grid_convergence"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1

"""Simulation, kriging, update and forest queries; none has an SQL form, their invariants are in the tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import folds, geostat, learn
from strataflow.plans.registry import query, read
from strataflow.plans.series import NUMBERED, daily
from strataflow.plans.space import grid, points


_BUDGET = ["runoff", "recharge", "interflow", "aet", "cap_rise", "baseflow", "theta", "wt_depth"]


@query(
    f"WITH RECURSIVE {NUMBERED}, f(user_id, day, n, s, h, runoff, recharge, interflow, aet, cap_rise, baseflow) AS (SELECT user_id, day, n - 1, 280.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM d WHERE n = 1 UNION ALL "
    "SELECT user_id, day, n, s5, h1 - dr, direct + over, gone - aside, aside, aet, rise, greatest(dr, 0.0) * 0.3 * 1000 FROM ("
    "SELECT *, greatest(6.0 - (5.0 - h1), 0.0) * rate AS dr FROM ("
    "SELECT *, h + (gone - aside) / 1000 / 0.3 AS h1, least(greatest(s4 - gone, 100.0), 450.0) AS s5 FROM ("
    "SELECT *, gone * (1 - 1 / (1 + 20.0 * slope)) AS aside FROM ("
    f"SELECT *, greatest(s4 - 280.0, 0.0) * {1 - math.exp(-0.5)!r}::DOUBLE AS gone FROM ("
    "SELECT *, s3 - aet AS s4 FROM (SELECT *, least(e, greatest(s3 - 100.0, 0.0)) AS aet FROM (SELECT *, s2 - over AS s3 FROM (SELECT *, greatest(s2 - 450.0, 0.0) AS over FROM ("
    "SELECT *, s + rise + p - direct AS s2 FROM (SELECT *, "
    f"least(s + 30.0 * {1 / folds.MONTH_DAYS!r}::DOUBLE * least(greatest((2.0 - (5.0 - h)) / 2.0, 0.0), 1.0) * least(greatest((450.0 - s) / 350.0, 0.0), 1.0), 450.0) - s AS rise, "
    "greatest(p - 1000 * greatest(0.3 * (5.0 - h), 0.0), 0.0) AS direct, least(greatest(1.0 / 1000 / 0.3 / 1.0, 0.0), 1.0) AS rate FROM ("
    "SELECT d.user_id, d.day, d.n, d.p, d.e, (d.user_id % 7) / 50.0::DOUBLE AS slope, f.s, f.h FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1)))))))))))) "
    "SELECT user_id, day, round(runoff, 6) AS runoff, round(recharge, 6) AS recharge, round(interflow, 6) AS interflow, round(aet, 6) AS aet, round(cap_rise, 6) AS cap_rise, round(baseflow, 6) AS baseflow, round(s / 1000, 6) AS theta, round(5.0 - h, 6) AS wt_depth FROM f WHERE n > 0"
)
def coupled_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Daily steps on slopes, a table at 5 m under a river at 6 m."""
    d = daily(spark, sf).withColumn("slope", F.col("user_id") % 7 / 50.0)
    found = folds.coupled_budget(d, ["user_id"], "day", "p", "e", 0.10, 0.28, 0.45, 5.0, days=1.0, slope="slope", hand=6.0)
    return found.select("user_id", "day", *[F.round(c, 6).alias(c) for c in _BUDGET])


def _curve(x: str, alpha: float) -> str:
    m = 1 - 1 / 1.8
    return f"({1 / alpha!r} * pow(pow(least(greatest({x}, 0.001), 0.999999), {-1 / m!r}) - 1, {1 / 1.8!r}))"


@query(
    f"WITH RECURSIVE {NUMBERED}, x AS (SELECT user_id, day, n, least(greatest(least(0.99::DOUBLE, p / 500 + 0.05), 0.001), 0.999999) AS w FROM d), "
    f"f(user_id, day, n, prev, dir, ser, hr, h) AS (SELECT user_id, day, n, w, -1.0::DOUBLE, w, {_curve('w', 0.05)}, {_curve('w', 0.05)} FROM x WHERE n = 1 UNION ALL "
    f"SELECT user_id, day, n, w, turn, s, r, {_curve('w', 0.1)} + (CASE WHEN turn < 0 THEN 1 - (1 - anchor) * least(greatest(w / s, 0.0), 1.0) ELSE anchor * least(greatest((1 - w) / greatest(1 - s, 1e-9), 0.0), 1.0) END) * ({_curve('w', 0.05)} - {_curve('w', 0.1)}) FROM ("
    f"SELECT *, least(greatest((r - {_curve('s', 0.1)}) / greatest({_curve('s', 0.05)} - {_curve('s', 0.1)}, 1e-12), 0.0), 1.0) AS anchor FROM ("
    "SELECT user_id, day, n, w, turn, CASE WHEN turn <> dir THEN prev ELSE ser END AS s, CASE WHEN turn <> dir THEN h ELSE hr END AS r FROM ("
    "SELECT x.user_id, x.day, x.n, x.w, f.prev, f.dir, f.ser, f.hr, f.h, CASE WHEN x.w > f.prev + 1e-12 THEN 1.0::DOUBLE WHEN x.w < f.prev - 1e-12 THEN -1.0::DOUBLE ELSE f.dir END AS turn FROM f JOIN x ON x.user_id = f.user_id AND x.n = f.n + 1)))) "
    "SELECT user_id, day, round(h, 6) AS suction FROM f"
)
def hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("se", F.least(F.lit(0.99), F.col("p") / 500 + 0.05))
    return folds.hysteretic_suction(d, ["user_id"], "day", "se", 0.05, 1.8).withColumn("suction", F.round("suction", 6))


def _network(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stations and cells of two groups; every group has its block of cells."""
    obs = points(spark, sf).withColumn("grp", (F.col("pid") % 2).cast("int")).withColumn("noise", F.lit(0.5))
    cells = grid(spark, sf).select("cell", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), (F.col("cell") % 2).cast("int").alias("grp"))
    return obs, cells


@query()
def ok_krige(spark: SparkSession, sf: str) -> DataFrame:
    obs, cells = _network(spark, sf)
    return geostat.krige_groups(obs, cells, ["grp"], "v", (0.1, 9.0, 15.0), least=3)


@query()
def blue_update(spark: SparkSession, sf: str) -> DataFrame:
    obs, cells = _network(spark, sf)
    return geostat.blue_groups(obs, cells, ["grp"], "v", "noise", 2.0, 12.0)


def _training(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf).select("cell", "row", "col", F.col("hand").cast("double").alias("hand"), (F.col("z") + F.col("hand") * 20).alias("y"))
    return learn.spatial_fold(g, "col", "row", 2.0, 5)


@query()
def rf_spread(spark: SparkSession, sf: str) -> DataFrame:
    df = _training(spark, sf)
    model, assembler = learn.forest(df.filter("fold <> 0"), ["row", "col", "hand"], "y")
    return learn.predict_with_spread(model, assembler, df.filter("fold = 0"))


@query()
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    df = _training(spark, sf)
    model, assembler = learn.forest(df.filter("fold <> 0"), ["row", "col", "hand"], "y")
    return learn.permutation_importance(model, assembler, df.filter("fold = 0"), ["row", "col", "hand"], "y")

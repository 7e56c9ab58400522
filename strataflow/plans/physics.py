"""Scalar formula queries: part rows as soil columns, cells and wells; lineitem dates as days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import hydro, normal
from strataflow.operators import evaluation
from strataflow.plans.registry import query, read

SOIL = "SELECT p_partkey AS cell, (20 + p_size) / 100.0::DOUBLE AS s, (5 + p_partkey % 30) / 100.0::DOUBLE AS c, 2.5::DOUBLE AS om FROM part"


@query(
    f"WITH q AS ({SOIL}), a AS (SELECT *, -0.024*s+0.487*c+0.006*om+0.005*s*om-0.013*c*om+0.068*s*c+0.031 AS t15, -0.251*s+0.195*c+0.011*om+0.006*s*om-0.027*c*om+0.452*s*c+0.299 AS t33, "
    "0.278*s+0.034*c+0.022*om-0.018*s*om-0.027*c*om-0.584*s*c+0.078 AS ts FROM q), b AS (SELECT *, t15+(0.14*t15-0.02) AS wp, t33+1.283*t33*t33-0.374*t33-0.015 AS fc FROM a), "
    "d AS (SELECT *, fc+(ts+0.636*ts-0.107)-0.097*s+0.043 AS sat FROM b), e AS (SELECT *, 1930*power(greatest(sat-fc, 1e-6), 3-(ln(fc)-ln(wp))/(ln(1500.0::DOUBLE)-ln(33.0::DOUBLE))) AS ks, least(greatest(wp, 0.01), 0.5) AS w1 FROM d), "
    "g AS (SELECT *, least(greatest(fc, w1+0.01), 0.6) AS f1 FROM e) SELECT cell, round(w1, 9) AS theta_wp, round(f1, 9) AS theta_fc, round(least(greatest(sat, f1+0.01), 0.75), 9) AS theta_sat, round(ks, 6) AS ksat_mm_h FROM g"
)
def saxton_rawls(spark: SparkSession, sf: str) -> DataFrame:
    out = hydro.saxton_rawls((20 + F.col("p_size")).cast("double"), (5 + F.col("p_partkey") % 30).cast("double"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), *[F.round(c, 6 if k == "ksat_mm_h" else 9).alias(k) for k, c in out.items()])


@query(
    "SELECT p_partkey AS cell, round(power(10.0::DOUBLE, 0.40220+0.26122*ph+0.44565-0.02329*clay-0.01265*silt-0.01038*cec), 6) AS ksat, "
    "round(power(10.0::DOUBLE, 0.40220+0.26122*ph+0.44565-0.02329*clay-0.01265*silt-0.01038*cec) * p_size * 2.5, 6) AS transmissivity FROM "
    "(SELECT *, 5.0::DOUBLE + p_size / 50.0 AS ph, (p_partkey % 40)::DOUBLE AS clay, (p_partkey % 35)::DOUBLE AS silt, 15.0::DOUBLE AS cec FROM part)"
)
def ksat_ptf(spark: SparkSession, sf: str) -> DataFrame:
    k = hydro.ksat_pedotransfer(5.0 + F.col("p_size") / 50.0, (F.col("p_partkey") % 40).cast("double"), (F.col("p_partkey") % 35).cast("double"), F.lit(15.0))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), F.round(k, 6).alias("ksat"), F.round(hydro.transmissivity(k, F.col("p_size"), 2.5), 6).alias("transmissivity"))


@query(
    "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), j AS (SELECT day, 2*pi()*dayofyear(day)/365 AS j, radians(47.5::DOUBLE) AS phi, dayofyear(day) % 25 AS t FROM d), "
    "k AS (SELECT *, 0.409*sin(j-1.39) AS de FROM j), r AS (SELECT *, acos(least(greatest(-tan(phi)*tan(de), -1.0), 1.0)) AS ws FROM k), "
    "a AS (SELECT *, 0.408*(1440/pi())*0.0820*(1+0.033*cos(j))*(ws*sin(phi)*sin(de)+cos(phi)*cos(de)*sin(ws)) AS ra FROM r) "
    "SELECT day, round(ra, 6) AS ra_mm, round(greatest(0.0023*(t+17.8)*sqrt(greatest(10.0::DOUBLE, 0.0))*ra, 0.0), 6) AS pet_mm FROM a"
)
def hargreaves_pet(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    doy, t = F.dayofyear("day"), (F.dayofyear("day") % 25).cast("double")
    lat = F.lit(47.5)
    return d.select("day", F.round(hydro.extraterrestrial_mm(doy, lat), 6).alias("ra_mm"), F.round(hydro.hargreaves_pet(t + 5, t - 5, t, doy, lat), 6).alias("pet_mm"))


@query(
    "SELECT p_partkey AS cell, round(9806.65::DOUBLE * greatest(100 - z, 0), 6) AS pressure, round(9806.65::DOUBLE * greatest(100 - z, 0) * power(cos(b), 2), 6) AS slope_pressure, "
    "round(greatest(100 - z, 0) + 0.0::DOUBLE, 6) AS head_m, round(z + greatest(100 - z, 0), 6) AS hydraulic_head FROM (SELECT p_partkey, 80.0::DOUBLE + p_size AS z, radians(p_size / 2.0::DOUBLE) AS b FROM part)"
)
def pore_pressure(spark: SparkSession, sf: str) -> DataFrame:
    z, h, b = 80.0 + F.col("p_size"), F.lit(100.0), F.radians(F.col("p_size") / 2.0)
    p = hydro.pore_pressure(h, z)
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("cell"), F.round(p, 6).alias("pressure"), F.round(hydro.pore_pressure_slope(h, z, b), 6).alias("slope_pressure"),
        F.round(hydro.pressure_head(p), 6).alias("head_m"), F.round(z + hydro.pressure_head(p), 6).alias("hydraulic_head"),
    )


@query(
    "WITH q AS (SELECT p_partkey AS cell, p_size / 100.0::DOUBLE AS th FROM part), h AS (SELECT *, th / 0.55 AS se, "
    "(1/0.08::DOUBLE)*power(power(least(greatest(th/0.55, 1e-3), 1-1e-6), -1/(1-1/1.6::DOUBLE))-1, 1/1.6::DOUBLE) AS pc FROM q) "
    "SELECT cell, round(pc, 6) AS suction, round(sqrt(75.0*power(greatest(10.0+se*pc, 1.0)/100.0, 1/3.0::DOUBLE)*1e6/(2650.0*(1-0.55)+1000.0*th)), 6) AS vs FROM h"
)
def vs_suction(spark: SparkSession, sf: str) -> DataFrame:
    th = F.col("p_size") / 100.0
    se = th / 0.55
    pc = hydro.vg_suction(se, 0.08, 1.6)
    return read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), F.round(pc, 6).alias("suction"), F.round(hydro.shear_velocity(th, se, pc, F.lit(0.55)), 6).alias("vs"))


@query("SELECT p_partkey AS cell, round(2.0 + (p_size / 100.0::DOUBLE) / 0.15, 9) AS head, round(0.15 * ((p_size / 100.0::DOUBLE) / 0.15), 9) AS storage, CASE WHEN p_size > 0 THEN least(greatest((p_partkey % 60) / p_size::DOUBLE, 0.0), 1.0) END AS saturation FROM part")
def hydro_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    ds = F.col("p_size") / 100.0
    head = hydro.head_from_storage(ds, F.lit(0.15), 2.0)
    back = hydro.storage_from_head(hydro.head_from_storage(ds, F.lit(0.15)), F.lit(0.15))
    sat = hydro.saturation_fraction((F.col("p_partkey") % 60).cast("double"), F.col("p_size").cast("double"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), F.round(head, 9).alias("head"), F.round(back, 9).alias("storage"), sat.alias("saturation"))


@query(
    "WITH q AS (SELECT p_partkey AS cell, p_retailprice * 90 AS a, p_size / 4.0::DOUBLE AS b FROM part), t AS (SELECT *, ln(a/tan(radians(b))) AS t1, ln((a/90.0)/tan(radians(greatest(b, 0.1)))) AS t2 FROM q) "
    "SELECT cell, round(t1, 9) AS twi, round(t2, 9) AS twi_specific, round(greatest(5.0 - 0.6 * (t2 - avg(t2) OVER ()), 0.0), 6) AS depth FROM t"
)
def twi_topmodel(spark: SparkSession, sf: str) -> DataFrame:
    area, slope = F.col("p_retailprice") * 90, F.col("p_size") / 4.0
    t = read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), hydro.twi(area, slope).alias("t1"), hydro.twi(area, slope, 90.0).alias("t2"))
    mean = t.agg(F.avg("t2").alias("m"))  # one row
    depth = F.greatest(5.0 - 0.6 * (F.col("t2") - F.col("m")), F.lit(0.0))
    return t.join(F.broadcast(mean)).select("cell", F.round("t1", 9).alias("twi"), F.round("t2", 9).alias("twi_specific"), F.round(depth, 6).alias("depth"))


@query(
    "SELECT p_partkey AS pair, round(exp(-d/12.0), 9) AS m05, round((1+sqrt(3.0::DOUBLE)*d/12.0)*exp(-sqrt(3.0::DOUBLE)*d/12.0), 9) AS m15, "
    "round((1+sqrt(5.0::DOUBLE)*d/12.0+(sqrt(5.0::DOUBLE)*d/12.0)*(sqrt(5.0::DOUBLE)*d/12.0)/3)*exp(-sqrt(5.0::DOUBLE)*d/12.0), 9) AS m25, round(exp(-d/5.0), 9) AS ou, "
    "least(greatest(round(0.5*ln((1+d)/0.5), 9), 0.0), 4.0) AS gain FROM (SELECT p_partkey, p_size::DOUBLE AS d FROM part)"
)
def matern_ou(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("p_size").cast("double")
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("pair"), *[F.round(hydro.matern(d, 12.0, nu), 9).alias(n) for n, nu in (("m05", 0.5), ("m15", 1.5), ("m25", 2.5))],
        F.round(hydro.ou_correlation(d, 5.0), 9).alias("ou"), F.round(hydro.information_gain(1 + d, F.lit(0.5)), 9).alias("gain"),
    )


_E, _E2, _N, _BIG, _RHO0 = hydro._cone()


@query(
    f"WITH p AS (SELECT s_suppkey AS site, radians(-124 + s_suppkey / 20.0 + 96.0) AS lon, sin(radians(42 + s_suppkey / 25.0)) AS s FROM supplier), "
    f"q AS (SELECT site, {_N!r} * lon AS theta, 6378137.0 * sqrt({_BIG!r} - {_N!r} * {1 - _E2!r} * (s / (1 - {_E2!r} * s * s) - ln((1 - {_E!r} * s) / (1 + {_E!r} * s)) / (2 * {_E!r}))) / {_N!r} AS rho FROM p) "
    f"SELECT site, round(rho * sin(theta), 3) AS x_5070, round({_RHO0!r} - rho * cos(theta), 3) AS y_5070 FROM q"
)
def albers_project(spark: SparkSession, sf: str) -> DataFrame:
    x, y = hydro.albers(-124 + F.col("s_suppkey") / 20.0, 42 + F.col("s_suppkey") / 25.0)
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.round(x, 3).alias("x_5070"), F.round(y, 3).alias("y_5070"))


PRED = "SELECT n_name AS domain, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS mu, 5.0 + l_tax * 100 AS sigma FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    sites = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return read(spark, sf, "lineitem").join(sites, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("n_name").alias("domain"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("mu"), (5.0 + F.col("l_tax") * 100).alias("sigma")
    )


@query(
    f"SELECT domain, count(*) AS n, round(sqrt(avg((mu-y)*(mu-y))), 6) AS rmse, round(avg(abs(mu-y)), 6) AS mae, round(avg(mu-y), 6) AS bias, round(1-sum((mu-y)*(mu-y))/(var_pop(y)*count(y)), 6) AS r2 FROM ({PRED}) GROUP BY domain"
)
def cv_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluation.errors(predictions(spark, sf), ["domain"], F.col("y"), F.col("mu"))
    return r.select("domain", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias", "r2")])


@query(
    "WITH e AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'valley_fill' WHEN 1 THEN 'basin' WHEN 2 THEN 'coastal' ELSE 'fractured_upland' END AS domain, l_discount * 10 AS y, l_tax * 10 AS mu FROM lineitem), "
    "r AS (SELECT domain, count(*) AS n, sqrt(avg((mu-y)*(mu-y))) AS rmse, avg(mu-y) AS bias FROM e GROUP BY domain) SELECT domain, n, round(rmse, 6) AS rmse, round(bias, 6) AS bias, "
    "CASE domain WHEN 'valley_fill' THEN CASE WHEN n < 20 THEN 'unvalidated' WHEN rmse <= 1.5 AND abs(bias) <= 0.25 THEN 'pass' ELSE 'FAIL' END "
    "WHEN 'basin' THEN CASE WHEN n < 20 THEN 'unvalidated' WHEN rmse <= 2.5 AND abs(bias) <= 0.5 THEN 'pass' ELSE 'FAIL' END "
    "WHEN 'coastal' THEN CASE WHEN n < 20 THEN 'unvalidated' WHEN rmse <= 2.0 AND abs(bias) <= 0.3 THEN 'pass' ELSE 'FAIL' END ELSE 'report_only' END AS status, "
    "CASE domain WHEN 'valley_fill' THEN n >= 20 AND rmse <= 0.75 AND abs(bias) <= 0.25 WHEN 'basin' THEN n >= 20 AND rmse <= 1.5 AND abs(bias) <= 0.5 "
    "WHEN 'coastal' THEN n >= 20 AND rmse <= 1.0 AND abs(bias) <= 0.3 ELSE false END AS meets_target FROM r"
)
def domain_gate_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    name = F.when(k == 0, "valley_fill").when(k == 1, "basin").when(k == 2, "coastal").otherwise("fractured_upland")
    rows = read(spark, sf, "lineitem").select(name.alias("domain"), (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 10).alias("mu"))
    report = evaluation.gate_status(evaluation.errors(rows, ["domain"], F.col("y"), F.col("mu")), "domain")
    return report.select("domain", "n", F.round("rmse", 6).alias("rmse"), F.round("bias", 6).alias("bias"), "status", "meets_target")


@query(
    "SELECT domain, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN abs((y-mu)/sigma) <= {q!r} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS cov{k}" for k, q in evaluation.LEVELS.items()) + f" FROM ({PRED}) GROUP BY domain"
)
def coverage_levels(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluation.interval_coverage(predictions(spark, sf), ["domain"], F.col("y"), F.col("mu"), F.col("sigma"))
    return r.select("domain", "n", *[F.round(f"cov{k}", 9).alias(f"cov{k}") for k in evaluation.LEVELS])


@query("SELECT l_orderkey AS cell, round(sqrt(sum(s*s)), 6) AS sigma_total FROM (SELECT l_orderkey, l_discount AS s FROM lineitem UNION ALL SELECT l_orderkey, l_tax FROM lineitem) GROUP BY l_orderkey")
def uncertainty_quadrature(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell"), F.explode(F.array("l_discount", "l_tax")).alias("s"))
    return evaluation.quadrature(l, ["cell"], "s").withColumn("sigma_total", F.round("sigma_total", 6))


@query(
    f"WITH p AS (SELECT domain, greatest(sigma, 1e-9) AS s, (y - mu) / greatest(sigma, 1e-9) AS z FROM ({PRED})), c AS (SELECT domain, s, z, {normal.cdf_sql('z')} AS c FROM p) "
    "SELECT domain, round(avg(c), 9) AS pit_mean, round(stddev_pop(c), 9) AS pit_sd, round(avg(s * (z * (2 * c - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 6) AS crps FROM c GROUP BY domain"
)
def pit_crps(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    y, mu, s = F.col("y"), F.col("mu"), F.col("sigma")
    return p.select("domain", normal.pit(y, mu, s).alias("pit"), normal.crps(y, mu, s).alias("crps")).groupBy("domain").agg(F.round(F.avg("pit"), 9).alias("pit_mean"), F.round(F.stddev_pop("pit"), 9).alias("pit_sd"), F.round(F.avg("crps"), 6).alias("crps"))

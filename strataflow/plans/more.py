"""Queries of state conversions, soil and site formulas, terrain, resampling, months, wells and evaluation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import hydro, site
from strataflow.functions.normal import cdf_sql, ppf_sql
from strataflow.operators import evaluation, grid, months, priors, spatial, variogram, wells
from strataflow.plans.registry import query, read
from strataflow.plans.space import D8_SQL, GRID, POINTS, points
from strataflow.plans.space import grid as cells
from strataflow.plans.wells import MONTHLY
from strataflow.plans.wells import months as site_months
from strataflow.session import checkpointed

R = partial(F.round, scale=6)
PART = "SELECT p_partkey AS cell, p_size::DOUBLE AS s, (p_partkey % 37)::DOUBLE AS c, p_retailprice AS z, CAST(p_partkey % 40 AS INT) AS col, CAST(p_partkey // 40 AS INT) AS row FROM part"


def part(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        k.alias("cell"), F.col("p_size").cast("double").alias("s"), (k % 37).cast("double").alias("c"), F.col("p_retailprice").alias("z"),
        (k % 40).cast("int").alias("col"), F.expr("cast(p_partkey div 40 as int)").alias("row"),
    )


@query(f"SELECT cell, round(z - s, 6) AS depth, round(z - c, 6) AS elevation, -s AS depth_anomaly, -c AS head_anomaly, 0.005 + c / 100 AS sy FROM ({PART})")
def state_conversions(spark: SparkSession, sf: str) -> DataFrame:
    s, c, z = F.col("s"), F.col("c"), F.col("z")
    return part(spark, sf).select(
        "cell", R(hydro.depth_to_water(z, s)).alias("depth"), R(hydro.water_table_elevation(z, c)).alias("elevation"), hydro.depth_anomaly(s).alias("depth_anomaly"),
        hydro.head_anomaly(c).alias("head_anomaly"), hydro.checked_specific_yield(0.005 + c / 100).alias("sy"),
    )


COUPLING = (
    f"WITH q AS (SELECT cell, s AS sand, c AS clay, 0.08::DOUBLE AS wp, 0.45::DOUBLE AS sat, 0.1 + s / 200 AS th, 0.1 + c / 200 AS th0 FROM ({PART})), "
    "e AS (SELECT *, least(greatest(0.02+0.13*sand/100-0.05*clay/100, 0.005), 0.25) AS a, least(greatest(1.2+1.3*sand/100-0.4*clay/100, 1.1), 2.8) AS n FROM q), "
    "f AS (SELECT *, least(greatest((th-wp)/(sat-wp), 1e-3), 1.0) AS se, least(greatest((th0-wp)/(sat-wp), 1e-3), 1.0) AS se0 FROM e), "
    "g AS (SELECT *, (1/a)*power(power(se, -1/(1-1/n))-1, 1/n) AS pc, (1/a)*power(power(se0, -1/(1-1/n))-1, 1/n) AS pc0 FROM f), "
    "v AS (SELECT *, sqrt(75.0*power(greatest(10.0+se*pc, 1.0)/100.0, 1/3.0::DOUBLE)*1e6/(2650.0*(1-sat)+1000.0*th)) AS v1, "
    "sqrt(75.0*power(greatest(10.0+se0*pc0, 1.0)/100.0, 1/3.0::DOUBLE)*1e6/(2650.0*(1-sat)+1000.0*th0)) AS v0 FROM g) "
)


@query(COUPLING + "SELECT cell, round(a, 9) AS alpha, round(n, 9) AS n, round(v1, 6) AS velocity, 5.0e-4 * (sand - 20) AS low, round((v1 - v0) / v0, 9) AS high FROM v")
def velocity_coupling(spark: SparkSession, sf: str) -> DataFrame:
    wp, sat, th, th0 = F.lit(0.08), F.lit(0.45), 0.1 + F.col("s") / 200, 0.1 + F.col("c") / 200
    a, n = hydro.van_genuchten_of(F.col("s"), F.col("c"))
    low, high = hydro.velocity_changes(F.col("s") - 20, th, th0, wp, sat, a, n)
    return part(spark, sf).select(
        "cell", F.round(a, 9).alias("alpha"), F.round(n, 9).alias("n"), R(hydro.vadose_velocity(th, wp, sat, a, n)).alias("velocity"), low.alias("low"), F.round(high, 9).alias("high")
    )


@query(
    f"SELECT cell, s / 5.0e-4 AS head, abs(c / 5.0e-4) AS head_sd, -s AS moisture, abs(c) AS moisture_sd, s AS vs30, c AS vs30_sd, "
    f"round(exp(-s*s/(4*8.0*greatest(c, 1e-6)))/(4*pi()*8.0*greatest(c, 1e-6)), 9) AS energy FROM ({PART})"
)
def velocity_inversions(spark: SparkSession, sf: str) -> DataFrame:
    s, c = F.col("s"), F.col("c")
    (h, hs), (m, ms), (v, vs) = hydro.head_change_of(s, c), hydro.moisture_change_of(s, c), hydro.vs30_change_of(s, c)
    return part(spark, sf).select(
        "cell", h.alias("head"), hs.alias("head_sd"), m.alias("moisture"), ms.alias("moisture_sd"), v.alias("vs30"), vs.alias("vs30_sd"), F.round(hydro.intensity_2d(s, c), 9).alias("energy")
    )


@query(
    COUPLING + "SELECT cell, round(depth, 6) AS depth, round(0.08 + k / 40.0 * 0.37, 9) AS theta FROM (SELECT v.cell, 5.0 + 5.0e-4 * (sand - 20) / 5.0e-4 AS depth, t.k, "
    "abs((sqrt(75.0*power(greatest(10.0+least(greatest(t.k/40.0, 1e-3), 1.0)*(1/a)*power(power(least(greatest(t.k/40.0, 1e-3), 1.0), -1/(1-1/n))-1, 1/n), 1.0)/100.0, 1/3.0::DOUBLE)*1e6"
    "/(2650.0*(1-sat)+1000.0*(0.08+t.k/40.0*0.37)))-v0)/v0 - (v1-v0)/v0) AS gap FROM v, (SELECT unnest(range(41))::DOUBLE AS k) t) "
    "QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(gap, 12), k) = 1"
)
def velocity_to_states(spark: SparkSession, sf: str) -> DataFrame:
    wp, sat, th, th0 = F.lit(0.08), F.lit(0.45), 0.1 + F.col("s") / 200, 0.1 + F.col("c") / 200
    a, n = hydro.van_genuchten_of(F.col("s"), F.col("c"))
    rows = part(spark, sf).select("cell", a.alias("a"), n.alias("n"), th0.alias("th0"), *[x.alias(k) for x, k in zip(hydro.velocity_changes(F.col("s") - 20, th, th0, wp, sat, a, n), ("low", "high"))])
    depth, theta = hydro.states_of_changes(F.col("low"), F.col("high"), F.lit(5.0), F.col("th0"), wp, sat, F.col("a"), F.col("n"))
    return rows.select("cell", R(depth).alias("depth"), F.round(theta, 9).alias("theta"))


@query(
    f"SELECT cell, k, round(k * s, 6) AS t_plain, round(k * s * 2.5, 6) AS t_aniso, round(k * c, 6) AS t_decay, round(least(0.1 + w * 0.2, 0.4), 9) AS theta, "
    "round(sqrt(power((1-w)*0.03, 2)+power(w*0.03, 2)+power(0.12*0.2, 2)), 9) AS theta_sd FROM "
    f"(SELECT *, round(z / 1000, 6) AS k, least(greatest(s / 40, 0.0), 1.0) AS w FROM ({PART}))"
)
def soil_hydraulics(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("s"), F.col("k")
    theta, sd = hydro.moisture_from_wetness(s / 40, F.lit(0.1), F.lit(0.3), F.lit(0.4))
    t = [hydro.soil_hydraulics("provided", m, s, ksat_field=k, decay_depth=F.col("c"))["transmissivity"] for m in ("ksat_x_thickness", "ksat_x_thickness_anisotropy", "topmodel_exponential")]
    return part(spark, sf).withColumn("k", R(F.col("z") / 1000)).select("cell", "k", *[R(x).alias(n) for x, n in zip(t, ("t_plain", "t_aniso", "t_decay"))], F.round(theta, 9).alias("theta"), F.round(sd, 9).alias("theta_sd"))


@query(
    f"SELECT cell, round(exp(-2*s/5.0), 9) AS resolution, round(exp(-c/120.0)*0.3, 9) AS g, round(2.0*(1-exp(-2*c/120.0))+0.1, 9) AS noise, round(0.5*exp(-2*s/120.0), 9) AS effective FROM ({PART})"
)
def temporal_observability(spark: SparkSession, sf: str) -> DataFrame:
    s, c = F.col("s"), F.col("c")
    g, noise = hydro.lagged_observation(F.lit(0.3), c, hydro.MEMORY_DAYS["gwl"], F.lit(2.0), F.lit(0.1))
    return part(spark, sf).select(
        "cell", F.round(hydro.temporal_resolution(s, hydro.MEMORY_DAYS["soil_moisture"]), 9).alias("resolution"), F.round(g, 9).alias("g"), F.round(noise, 9).alias("noise"),
        F.round(hydro.effective_observability(F.lit(0.5), s, "gwl"), 9).alias("effective"),
    )


PROFILE = f"SELECT cell, unnest([2.0, 10.0, 25.0, 60.0]::DOUBLE[]) AS d, unnest([150 + s, 200 + 2 * s, 200 + 2 * s, 500 + c]) AS v FROM ({PART})"


@query(
    f"WITH p AS ({PROFILE}), q AS (SELECT * FROM p UNION ALL SELECT cell, 0.0, v FROM p WHERE d = 2.0), g AS (SELECT *, lead(d) OVER w AS d2, lead(v) OVER w AS v2 FROM q WINDOW w AS (PARTITION BY cell ORDER BY d)), "
    "h AS (SELECT cell, d, v, least(d2, 30.0) AS d2, CASE WHEN d2 > 30 THEN v + (30 - d) / (d2 - d) * (v2 - v) ELSE v2 END AS v2 FROM g WHERE d < 30 AND d2 IS NOT NULL) "
    "SELECT cell, round(30.0 / sum((d2 - d) / CASE WHEN abs(v2 - v) < 1e-9 THEN 0.5 * (v + v2) ELSE (v2 - v) / ln(v2 / v) END), 6) AS vs30 FROM h GROUP BY cell"
)
def profile_vs30(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s")
    samples = F.array(*[F.struct(F.lit(z).alias("z"), v.alias("vs")) for z, v in ((60.0, 500 + F.col("c")), (2.0, 150 + s), (10.0, 200 + 2 * s), (25.0, 200 + 2 * s))])
    return part(spark, sf).select("cell", R(site.profile_velocity(samples)).alias("vs30"))


_EDGES = [f"{cdf_sql(f'z{i}')} AS c{i}" for i in range(len(site.CLASS_BOUNDS))]
_SHARES = [f"{f'c{i}' if i < len(site.CLASS_BOUNDS) else '1.0::DOUBLE'} - {f'c{i - 1}' if i else '0.0::DOUBLE'}" for i in range(len(site.CLASS_NAMES))]

_LIKELIEST = " ".join(f"WHEN p_{k} = greatest({', '.join(f'p_{n}' for n in site.CLASS_NAMES)}) THEN '{k}'" for k in site.CLASS_NAMES)


@query(
    f"WITH g AS ({PART}), z AS (SELECT cell, {', '.join(f'({b!r}::DOUBLE - (150 + z / 2)) / (10 + s) AS z{i}' for i, b in enumerate(site.CLASS_BOUNDS))} FROM g), c AS (SELECT cell, {', '.join(_EDGES)} FROM z), "
    f"p AS (SELECT cell, {', '.join(f'{x} AS p_{k}' for x, k in zip(_SHARES, site.CLASS_NAMES))} FROM c) "
    f"SELECT cell, {', '.join(f'round(p_{k}, 9) AS p_{k}' for k in site.CLASS_NAMES)}, CASE {_LIKELIEST} END AS class FROM p"
)
def site_class_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    mean, sd = 150 + F.col("z") / 2, 10 + F.col("s")
    likely = site.likeliest_class(mean, sd)
    return part(spark, sf).select("cell", *[F.round(p, 9).alias(f"p_{k}") for k, p in site.class_probabilities(mean, sd).items()], likely["class"].alias("class"))


@query(
    f"WITH g AS ({PART}), n AS (SELECT a.row, a.col, coalesce(b.z, a.z) - a.z AS d, s.i, s.j FROM g a CROSS JOIN (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE i <> 0 OR j <> 0) s "
    "LEFT JOIN g b ON b.row = a.row + s.i AND b.col = a.col + s.j), t AS (SELECT row, col, sum(j * CASE WHEN i = 0 THEN 2 ELSE 1 END * d) AS dx, sum(-i * CASE WHEN j = 0 THEN 2 ELSE 1 END * d) AS dy FROM n GROUP BY ALL) "
    "SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy) / (8 * 90.0))), 6) AS slope FROM t"
)
def slope_horn(spark: SparkSession, sf: str) -> DataFrame:
    return grid.slope_degrees(part(spark, sf), "z", 90.0).select("row", "col", R("slope").alias("slope"))


PATHS = D8_SQL.replace("WITH g", "WITH RECURSIVE g") + (
    ", e AS (SELECT g.row * 40 + g.col AS node, t.nrow * 40 + t.ncol AS nxt, g.z FROM g LEFT JOIN t USING (row, col)), "
)


@query(PATHS + "p AS (SELECT node, node AS here FROM e UNION ALL SELECT p.node, e.nxt FROM p JOIN e ON e.node = p.here WHERE e.nxt IS NOT NULL) SELECT CAST(here AS BIGINT) AS node, count(*) AS cells FROM p GROUP BY here")
def contributing_area(spark: SparkSession, sf: str) -> DataFrame:
    return grid.contributing_cells(grid.drainage(cells(spark, sf), "z", 40), checkpointed)


@query(
    PATHS + "w AS (SELECT * , node % 7 = 0 AS wet FROM e), p AS (SELECT node, node AS here FROM w UNION ALL SELECT p.node, w.nxt FROM p JOIN w ON w.node = p.here WHERE w.nxt IS NOT NULL AND NOT w.wet), "
    "r AS (SELECT p.node, p.here FROM p JOIN w ON w.node = p.here WHERE w.wet OR w.nxt IS NULL) SELECT CAST(r.node AS BIGINT) AS node, CASE WHEN b.wet THEN round(greatest(a.z - b.z, 0), 6) END AS hand FROM r JOIN w a ON a.node = r.node JOIN w b ON b.node = r.here"
)
def hand(spark: SparkSession, sf: str) -> DataFrame:
    graph = grid.drainage(cells(spark, sf), "z", 40)
    streams = graph.filter("node % 7 = 0").select("node")
    found = grid.height_above_drainage(graph, streams, partial(spatial.drain_to, materialize=checkpointed))
    return found.select("node", R("hand").alias("hand"))


BILINEAR = (
    f"WITH g AS ({PART}), o AS (SELECT row // 5 AS row, col // 5 AS col, avg(z) AS v FROM g GROUP BY ALL), f AS (SELECT row, col, (row + 0.5::DOUBLE) / 5 - 0.5 AS u, (col + 0.5::DOUBLE) / 5 - 0.5 AS w FROM g), "
    "n AS (SELECT f.row, f.col, floor(u) + i AS r, floor(w) + j AS c, (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS wt "
    "FROM f, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)), b AS (SELECT n.row, n.col, sum(wt * v) / sum(wt) AS v FROM n JOIN o ON o.row = n.r AND o.col = n.c GROUP BY ALL) "
)


@query(BILINEAR + "SELECT row, col, round(v, 6) AS v FROM b")
def bilinear_regrid(spark: SparkSession, sf: str) -> DataFrame:
    fine = part(spark, sf)
    return grid.downscale(grid.averaged(fine, "z", 5, "v"), fine.select("row", "col"), "v", 5).select("row", "col", R("v").alias("v"))


@query(
    BILINEAR + ", k AS (SELECT row // 5 AS row, col // 5 AS col, avg(s) AS x FROM g GROUP BY ALL), l AS (SELECT regr_slope(v, x) AS b, regr_intercept(v, x) AS a FROM o JOIN k USING (row, col)), "
    "p AS (SELECT g.row, g.col, a + b * s AS p FROM g, l), m AS (SELECT row // 5 AS row, col // 5 AS col, avg(p) AS mp FROM p GROUP BY ALL) "
    "SELECT p.row, p.col, round(p.p + o.v - m.mp, 4) AS v FROM p JOIN o ON o.row = p.row // 5 AND o.col = p.col // 5 JOIN m ON m.row = o.row AND m.col = o.col WHERE (SELECT count(*) FROM o) >= 12 "
    "UNION ALL SELECT row, col, round(v, 4) FROM b WHERE (SELECT count(*) FROM o) < 12"
)
def regression_downscale(spark: SparkSession, sf: str) -> DataFrame:
    fine = part(spark, sf)
    found = grid.downscale(grid.averaged(fine, "z", 5, "v"), fine.select("row", "col", "s"), "v", 5, "regression", ["s"])
    return found.select("row", "col", F.round("v", 4).alias("v"))


@query(f"SELECT CAST(c AS INT) AS zone, count(z) AS n, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, min(z) AS min, max(z) AS max FROM ({PART}) GROUP BY ALL")
def zonal_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = part(spark, sf)
    found = grid.zonal(p.select("row", "col", "z"), p.select("row", "col", F.col("c").cast("int").alias("zone")), "z")
    return found.withColumn("mean", R("mean")).withColumn("sd", R("sd"))


@query(
    f"SELECT cell, CASE WHEN 2 * (col + 0.5) + (row + 0.5) < 30 THEN 'triangle' WHEN (col + 0.5) BETWEEN 20 AND 30 AND (row + 0.5) BETWEEN 1 AND 3 THEN 'box' END AS code FROM ({PART})"
)
def rasterized_shapes(spark: SparkSession, sf: str) -> DataFrame:
    shapes = spark.createDataFrame(
        [("triangle", 1, [(0.0, 0.0), (15.0, 0.0), (0.0, 30.0)]), ("box", 2, [(20.0, 1.0), (30.0, 1.0), (30.0, 3.0), (20.0, 3.0)])], "code string, rank int, ring array<struct<x: double, y: double>>"
    )
    centres = part(spark, sf).select("cell", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return grid.cells_in_shapes(centres, shapes, 10.0).select("cell", "code")


MONTHS = f"SELECT site, make_date(year, month, 1) AS m, value FROM ({MONTHLY})"


def month_rows(spark: SparkSession, sf: str) -> DataFrame:
    return site_months(spark, sf).select("site", F.make_date("year", "month", F.lit(1)).alias("m"), "value")


@query(
    f"WITH q AS ({MONTHS}), s AS (SELECT *, lead(m) OVER w AS nm, lead(value) OVER w AS nv FROM q WINDOW w AS (PARTITION BY site ORDER BY m)), "
    "t AS (SELECT *, unnest(range(coalesce(date_diff('month', m, nm), 1))) AS k, date_diff('month', m, nm) AS gap FROM s) "
    "SELECT site, CAST(m + to_months(CAST(k AS INT)) AS DATE) AS m, CASE WHEN k = 0 THEN round(value, 6) WHEN k <= 3 THEN round(value + (nv - value) * k / gap, 6) END AS value FROM t"
)
def filled_months(spark: SparkSession, sf: str) -> DataFrame:
    return months.regular_months(month_rows(spark, sf), ["site"], "m", "value").withColumn("value", R("value"))


@query(
    f"SELECT month, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value) AS n, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM ({MONTHLY}) GROUP BY month"
)
def seasonal_cycle_se(spark: SparkSession, sf: str) -> DataFrame:
    found = months.seasonal_cycle(site_months(spark, sf), F.col("month"), F.col("value"))
    return found.select("month", R("mean").alias("mean"), R("sd").alias("sd"), "n", R("se").alias("se"))


@query(
    f"WITH c AS (SELECT site, month, avg(value) AS mean FROM ({MONTHLY}) GROUP BY ALL) SELECT site, arg_max(month, (mean, -month)) AS peak, round(max(mean) - min(mean), 6) AS amplitude, "
    "least(abs(arg_max(month, (mean, -month)) - 11), 12 - abs(arg_max(month, (mean, -month)) - 11)) AS off FROM c GROUP BY site"
)
def monthly_amplitude(spark: SparkSession, sf: str) -> DataFrame:
    cycle = site_months(spark, sf).groupBy("site", "month").agg(F.avg("value").alias("mean"))
    found = months.amplitude(cycle, ["site"], "month", "mean")
    return found.select("site", "peak", R("amplitude").alias("amplitude"), months.months_apart(F.col("peak"), F.lit(11)).alias("off"))


@query(
    f"WITH q AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY m) - 1 AS n FROM ({MONTHS})), p AS (SELECT site, arg_max(n, (value, -n)) AS pk, count(*) AS c FROM q GROUP BY site) "
    "SELECT p.site, coalesce((SELECT min(q.n) FROM q WHERE q.site = p.site AND q.n >= p.pk AND q.value < 30000), p.c) AS melt_out FROM p"
)
def melt_out(spark: SparkSession, sf: str) -> DataFrame:
    return months.melt_out(month_rows(spark, sf), ["site"], "m", "value", 30000.0)


@query(f"SELECT site, m, round(greatest(coalesce(lag(value) OVER (PARTITION BY site ORDER BY m), 0.0) - value, 0.0), 6) AS loss FROM ({MONTHS})")
def clipped_losses(spark: SparkSession, sf: str) -> DataFrame:
    return months.losses(month_rows(spark, sf), ["site"], "m", "value", "loss").select("site", "m", R("loss").alias("loss"))


@query(f"SELECT site, round(corr(value, quantity), 6) AS r, count(*) AS n FROM ({MONTHLY}) GROUP BY site HAVING count(*) >= 12 AND stddev_pop(value) > 0 AND stddev_pop(quantity) > 0")
def cell_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return months.correlations(site_months(spark, sf), ["site"], F.col("value"), F.col("quantity")).withColumn("r", R("r"))


@query(
    f"WITH q AS ({MONTHLY}), s AS (SELECT site, avg(value) AS mo, avg(quantity) AS mm, stddev_pop(value) AS so, stddev_pop(quantity) AS sm FROM q GROUP BY site) "
    "SELECT q.site, year, month, round(mo + (quantity - mm) * (so / (sm + 1e-9)), 4) AS corrected FROM q JOIN s ON s.site = q.site"
)
def bias_correction(spark: SparkSession, sf: str) -> DataFrame:
    found = months.bias_corrected(site_months(spark, sf), ["site"], "value", "quantity", "corrected")
    return found.select("site", "year", "month", F.round("corrected", 4).alias("corrected"))


@query(
    "SELECT l_suppkey AS site, round(sum(l_tax) / greatest(sum(l_discount), 1e-9), 6) AS bfi, round(sum(l_discount) / greatest(sum(l_quantity), 1e-9), 6) AS runoff_ratio FROM lineitem GROUP BY 1"
)
def flux_ratios(spark: SparkSession, sf: str) -> DataFrame:
    found = months.flux_ratios(read(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "site"), ["site"], "l_discount", "l_tax", "l_quantity")
    return found.select("site", R("bfi").alias("bfi"), R("runoff_ratio").alias("runoff_ratio"))


def _fits(spark: SparkSession, sf: str) -> DataFrame:
    rows = site_months(spark, sf).withColumn("t", F.col("year") * 12 + F.col("month")).withColumn("spi", F.sin(F.col("t").cast("double"))).withColumn("pdo", F.cos(F.col("t") / 3))
    return months.lagged_fits(rows, ["site"], "t", "value", ["spi", "pdo"], "quantity", 3, 24)


_MOMENTS = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for i, a in enumerate(("u", "v", "w", "y")) for b in ("u", "v", "w", "y")[i:])
#: Fits of y on u, v and the lagged w by their covariances (Cramer's rule), with a constant.
FITS = (
    f"WITH m AS ({MONTHLY}), r AS (SELECT site, year * 12 + month AS t, value AS y, sin((year * 12 + month)::DOUBLE) AS u, cos((year * 12 + month) / 3.0::DOUBLE) AS v, quantity FROM m), "
    "l AS (SELECT site, k AS lag, y, u, v, CASE k WHEN 0 THEN quantity WHEN 1 THEN lag(quantity, 1) OVER w1 WHEN 2 THEN lag(quantity, 2) OVER w1 ELSE lag(quantity, 3) OVER w1 END AS w "
    "FROM r, (SELECT unnest([0, 1, 2, 3]) AS k) WINDOW w1 AS (PARTITION BY site, k ORDER BY t)), "
    f"s AS (SELECT site, lag, count(*) AS n, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, avg(w) AS mw, {_MOMENTS} FROM l WHERE y IS NOT NULL AND w IS NOT NULL GROUP BY site, lag HAVING count(*) >= 24), "
    "d AS (SELECT *, uu * (vv * ww - vw * vw) - uv * (uv * ww - vw * uw) + uw * (uv * vw - vv * uw) AS det FROM s), "
    "b AS (SELECT *, (uy * (vv * ww - vw * vw) - uv * (vy * ww - vw * wy) + uw * (vy * vw - vv * wy)) / det AS b1, "
    "(uu * (vy * ww - wy * vw) - uy * (uv * ww - vw * uw) + uw * (uv * wy - vy * uw)) / det AS b2, "
    "(uu * (vv * wy - vw * vy) - uv * (uv * wy - vy * uw) + uy * (uv * vw - vv * uw)) / det AS b3 FROM d), "
    "e AS (SELECT *, yy - b1 * uy - b2 * vy - b3 * wy AS rss FROM b), fits AS (SELECT site, lag, n, 1 - rss / yy AS r2, sqrt(rss) AS resid_std, n * ln(rss) + 8 AS aic, my - b1 * mu - b2 * mv - b3 * mw AS b0, b1, b2, b3 FROM e) "
)


@query(
    FITS + "SELECT site, lag, n, round(r2, 6) AS r2, round(resid_std, 4) AS resid_std, round(aic, 5) AS aic, round(b0, 3) AS b0, round(b1, 3) AS b_spi, round(b2, 3) AS b_pdo, round(b3, 4) AS b_quantity FROM fits "
    "QUALIFY row_number() OVER (PARTITION BY site ORDER BY aic, lag) = 1"
)
def lagged_fits(spark: SparkSession, sf: str) -> DataFrame:
    found = months.best_fit(_fits(spark, sf), ["site"])
    digits = {"r2": 6, "resid_std": 4, "aic": 5, "b0": 3, "b_spi": 3, "b_pdo": 3, "b_quantity": 4}
    return found.select("site", "lag", "n", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query(FITS + "SELECT zone, lag FROM (SELECT site % 3 AS zone, lag, median(aic) AS m FROM fits GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY zone ORDER BY m, lag) = 1")
def zone_lag(spark: SparkSession, sf: str) -> DataFrame:
    return months.best_lag(_fits(spark, sf).withColumn("zone", F.col("site") % 3), "zone")


@query(
    "SELECT CAST(least(floor((l_extendedprice - 900) / 1000.0), 99) AS INT) AS bin, 900 + 1000.0 * least(floor((l_extendedprice - 900) / 1000.0), 99) AS lower, "
    "900 + 1000.0 * (least(floor((l_extendedprice - 900) / 1000.0), 99) + 1) AS upper, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 100900 GROUP BY ALL"
)
def histogram_linear(spark: SparkSession, sf: str) -> DataFrame:
    return months.histogram(read(spark, sf, "lineitem"), F.col("l_extendedprice"), 900.0, 100900.0, 100)


@query(
    "WITH q AS (SELECT least(floor((log10(l_extendedprice) - 2) / 0.25), 15) AS k FROM lineitem WHERE l_extendedprice BETWEEN 100 AND 1000000) "
    "SELECT CAST(k AS INT) AS bin, round(power(10.0, 2 + k * 0.25), 4) AS lower, round(power(10.0, 2 + (k + 1) * 0.25), 4) AS upper, count(*) AS n FROM q GROUP BY k"
)
def histogram_log(spark: SparkSession, sf: str) -> DataFrame:
    found = months.histogram(read(spark, sf, "lineitem"), F.col("l_extendedprice"), 100.0, 1e6, 16, log=True)
    return found.withColumn("lower", F.round("lower", 4)).withColumn("upper", F.round("upper", 4))


@query(f"SELECT cell, round(sin(2*pi()/8.0*(col+0.5))*sin(2*pi()/8.0*(row+0.5)), 9) AS truth FROM ({PART}) WHERE row % 2 = 0 AND col % 2 = 0")
def thinned_checkerboard(spark: SparkSession, sf: str) -> DataFrame:
    truth = months.checkerboard(F.col("col") + 0.5, F.col("row") + 0.5, 8.0)
    return months.thinned(part(spark, sf), 2).select("cell", F.round(truth, 9).alias("truth"))


@query(BILINEAR + "SELECT count(*) AS n, round(sqrt(avg((b.v - g.z) * (b.v - g.z))), 6) AS rms, round(max(abs(b.v - g.z)), 6) AS max_abs FROM b JOIN g USING (row, col)")
def grid_convergence(spark: SparkSession, sf: str) -> DataFrame:
    fine = part(spark, sf)
    up = grid.bilinear(grid.averaged(fine, "z", 5), fine.select("row", "col", "z"), "z", 5, "up")
    return months.difference_of(up, "up", "z").select("n", R("rms").alias("rms"), R("max_abs").alias("max_abs"))


SITES = (
    "SELECT p_partkey AS site, CASE WHEN p_partkey % 9 <> 0 THEN p_size::DOUBLE END AS well_depth_m, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice > 1800 END AS is_deep_well, "
    "p_retailprice / 100 AS median_dtw_m FROM part"
)


def sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        k.alias("site"), F.when(k % 9 != 0, F.col("p_size").cast("double")).alias("well_depth_m"), F.when(k % 5 != 0, F.col("p_retailprice") > 1800).alias("is_deep_well"),
        (F.col("p_retailprice") / 100).alias("median_dtw_m"),
    )


@query(f"SELECT site, well_depth_m FROM ({SITES}) WHERE (well_depth_m <= 30 OR well_depth_m IS NULL) AND NOT coalesce(is_deep_well, false)")
def water_table_wells(spark: SparkSession, sf: str) -> DataFrame:
    return wells.water_table_wells(sites(spark, sf)).select("site", "well_depth_m")


@query(f"SELECT site FROM ({SITES}) WHERE NOT coalesce(is_deep_well, false) AND median_dtw_m > 0 AND (well_depth_m <= 20 OR well_depth_m IS NULL)")
def baseline_sites(spark: SparkSession, sf: str) -> DataFrame:
    return wells.baseline_sites(sites(spark, sf), max_depth=20.0).select("site")


@query(
    f"WITH q AS (SELECT *, CASE WHEN coalesce(is_deep_well, false) OR well_depth_m >= 60 THEN 'deep_confined' WHEN well_depth_m <= 30 THEN 'shallow_watertable' ELSE 'ambiguous' END AS k FROM ({SITES})) "
    "SELECT n.hydro_class, count(q.site) AS n, median(well_depth_m) AS median_depth_m, round(median(median_dtw_m), 6) AS median_dtw_m FROM (SELECT unnest(['shallow_watertable', 'ambiguous', 'deep_confined']) AS hydro_class) n "
    "LEFT JOIN q ON q.k = n.hydro_class GROUP BY n.hydro_class"
)
def screening_summary(spark: SparkSession, sf: str) -> DataFrame:
    from strataflow.functions.classify import hydro_class

    found = wells.screening_summary(sites(spark, sf), hydro_class("well_depth_m", "is_deep_well"), "well_depth_m", "median_dtw_m")
    return found.withColumn("median_dtw_m", R("median_dtw_m"))


@query(
    f"SELECT site, CASE WHEN screen <= 30 THEN 'water_table' ELSE 'unknown' END AS measurement_target FROM (SELECT *, median_dtw_m * 2 AS screen FROM ({SITES}) WHERE NOT coalesce(is_deep_well, false)) "
    "WHERE screen <= 30 OR (screen < 60 AND screen > 30 AND coalesce(well_depth_m, 0) = 0)"
)
def water_table_observations(spark: SparkSession, sf: str) -> DataFrame:
    from strataflow.functions.classify import measurement_target

    rows = sites(spark, sf).filter("not coalesce(is_deep_well, false)").withColumn("screen", F.col("median_dtw_m") * 2)
    none = F.lit(None).cast("double")
    target = measurement_target(F.when(F.col("well_depth_m") > 1e9, F.col("well_depth_m")), F.col("screen"), none, F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))
    rows = rows.filter("screen < 60 and (screen <= 30 or coalesce(well_depth_m, 0) = 0)")
    return wells.water_table_observations(rows, target, include_unknown=True).select("site", "measurement_target")


@query(
    "SELECT l_orderkey, l_linenumber, s_nationkey AS nation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey % 4 <> 0"
)
def readings_with_sites(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey")).alias("lat"), F.col("s_nationkey").alias("lon"))
    return wells.with_sites(read(spark, sf, "lineitem"), s.unionAll(s), "l_suppkey").select("l_orderkey", "l_linenumber", F.col("lat").alias("nation"))


@query(
    "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"
)
def latest_retry(spark: SparkSession, sf: str) -> DataFrame:
    return wells.latest_per_key(read(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts")


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def kinds_of_keys(spark: SparkSession, sf: str) -> DataFrame:
    return wells.kinds_of_keys(read(spark, sf, "events"), ["user_id"], "event_type")


@query(
    "WITH m AS (SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) SELECT s_suppkey AS site FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM m)"
)
def download_resume(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "site")
    marks = wells.checkpoint(rows.filter("l_returnflag = 'R' and l_quantity > 45"), rows.filter("l_returnflag = 'A'"), "site")
    return wells.still_to_do(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("site")), marks, "site")


BUDGET = f"SELECT cell, unnest(['static', 'driver', 'scale']) AS component, unnest([s / 100, c / 100, CASE WHEN cell % 3 = 0 THEN 0.2::DOUBLE END]) AS sigma FROM ({PART})"


def budget(spark: SparkSession, sf: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("component"), v.alias("sigma")) for n, v in (("static", F.col("s") / 100), ("driver", F.col("c") / 100), ("scale", F.when(F.col("cell") % 3 == 0, 0.2)))])
    return part(spark, sf).select("cell", F.inline(each))


@query(f"WITH v AS (SELECT component, avg(sigma * sigma) AS v FROM ({BUDGET}) GROUP BY component) SELECT component, round(v / (SELECT sum(v) FROM v), 9) AS fraction FROM v")
def budget_fractions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.fractions(budget(spark, sf), "component", "sigma").withColumn("fraction", F.round("fraction", 9))


@query(
    f"WITH q AS (SELECT month, site % 4 AS member, year, avg(quantity) AS v FROM ({MONTHLY}) GROUP BY ALL), a AS (SELECT month, year, avg(v) AS m, stddev_pop(v) AS s FROM q GROUP BY ALL HAVING count(DISTINCT member) = (SELECT count(DISTINCT member) FROM q)) "
    "SELECT month, round(avg(m), 6) AS mean, round(avg(s), 6) AS sigma FROM a GROUP BY month"
)
def forcing_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    rows = site_months(spark, sf).groupBy("month", (F.col("site") % 4).alias("member"), "year").agg(F.avg("quantity").alias("v"))
    return evaluation.ensemble(rows, ["month"], "year", "member", "v").select("month", R("mean").alias("mean"), R("sigma").alias("sigma"))


@query(f"SELECT site, round(quantile_cont(quantity, 0.1), 6) AS quantity FROM ({MONTHLY}) GROUP BY site")
def seasonal_high_water(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.seasonal_high(site_months(spark, sf), ["site"], "quantity").withColumn("quantity", R("quantity"))


@query(
    "WITH q AS (SELECT l_suppkey AS site, l_tax AS d, l_quantity AS v FROM lineitem WHERE l_suppkey % 2 = 0 OR l_tax > 0.05), f AS (SELECT site, min(d) AS m FROM q GROUP BY site) "
    "SELECT q.site, round(avg(v), 6) AS v FROM q JOIN f ON f.site = q.site WHERE d <= 0.03 OR (m > 0.03 AND d <= m + 1e-9) GROUP BY q.site"
)
def top_layer(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").filter("l_suppkey % 2 = 0 or l_tax > 0.05").select(F.col("l_suppkey").alias("site"), F.col("l_tax").alias("d"), F.col("l_quantity").alias("v"))
    return evaluation.top_layer_mean(rows, ["site"], "d", "v").withColumn("v", R("v"))


@query(
    f"WITH p AS (SELECT *, v * 0.8 + 0.3 AS m FROM ({POINTS})), a AS (SELECT a.pid, sum(w * (b.v - b.m)) / greatest(sum(w), 1e-9) AS adj FROM (SELECT a.pid, b.v, b.m, exp(-((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))/(2*2.0*2.0)) AS w "
    "FROM p a JOIN p b ON a.pid <> b.pid AND (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py) <= 256.0) b JOIN p a ON a.pid = b.pid GROUP BY a.pid), e AS (SELECT m - v AS e0, m - v + coalesce(adj, 0) AS e1 FROM p LEFT JOIN a USING (pid)) "
    "SELECT round(avg(e0), 6) AS bias_model, round(sqrt(avg(e0*e0)), 6) AS rmse_model, round(avg(e1), 6) AS bias_anchored, round(sqrt(avg(e1*e1)), 6) AS rmse_anchored FROM e"
)
def leave_one_out_anchor(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluation.leave_one_out_anchor(points(spark, sf).withColumn("m", F.col("v") * 0.8 + 0.3), "v", "m", 2.0)
    return found.select(*[R(c).alias(c) for c in found.columns])


@query(
    f"SELECT cell, round(level, 6) AS level, round(z - level, 6) AS depth, z - level < 0 AS negative_depth, round(res, 6) AS residual FROM (SELECT *, CASE WHEN cell % 4 <> 0 THEN z - s + c END AS level, (z - 3) - (z - s) AS res FROM ({PART}))"
)
def residual_assembly(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.prior_residuals(part(spark, sf), F.col("z") - 3, F.col("z"), F.col("s"))
    found = evaluation.assembled(rows, F.col("prior_level"), F.col("c"), F.col("z"), F.col("cell") % 4 != 0)
    return found.select("cell", R("level").alias("level"), R("depth").alias("depth"), "negative_depth", R("residual").alias("residual"))


@query(
    f"WITH q AS (SELECT cell, 1 / (1 + power(s / 10.0, 2)) AS conf, CASE WHEN cell % 3 <> 0 THEN c END AS pred, least(greatest(z / 10, 0.5), 120.0) AS prior FROM ({PART})) "
    "SELECT cell, round(conf, 9) AS conf, round(CASE WHEN pred IS NOT NULL THEN conf * pred + (1 - conf) * prior ELSE prior END, 6) AS depth FROM q"
)
def confidence_blend(spark: SparkSession, sf: str) -> DataFrame:
    conf = evaluation.confidence(F.col("s"), F.lit(10.0))
    depth = evaluation.blended(F.when(F.col("cell") % 3 != 0, F.col("c")), F.col("z") / 10, conf)
    return part(spark, sf).select("cell", F.round(conf, 9).alias("conf"), R(depth).alias("depth"))


@query(
    f"WITH p AS ({PART}), c AS (SELECT a.col AS i, b.col AS j, covar_pop(a.s, b.s) AS depth, covar_pop((a.z - a.s) - a.z, (b.z - b.s) - b.z) AS head FROM p a JOIN p b ON a.row = b.row AND a.col < 8 AND b.col < 8 GROUP BY a.col, b.col) "
    "SELECT round(max(abs(depth - head)), 9) AS worst FROM c"
)
def covariance_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Covariances of depth anomalies and of the head anomalies that go with them, over the rows of the grid."""

    def covariances(value: Column) -> DataFrame:
        p = part(spark, sf).filter("col < 8").select("row", "col", value.alias("v"))
        other = p.select("row", F.col("col").alias("j"), F.col("v").alias("u"))
        return p.join(other, "row").groupBy(F.col("col").alias("i"), "j").agg(F.covar_pop("v", "u").alias("cov"))

    heads = hydro.water_table_elevation(F.col("z"), F.col("s")) - F.col("z")
    return evaluation.same_covariances(covariances(F.col("s")), covariances(heads), 1e-9).select(F.round("worst", 9).alias("worst"))


SEMI = f"SELECT CAST(floor(d / (10.0 / 15)) AS INT) AS lag, avg(0.5 * (v1 - v2) * (v1 - v2)) AS gamma FROM (SELECT sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)) AS d, a.v AS v1, b.v AS v2 FROM ({POINTS}) a JOIN ({POINTS}) b ON a.pid < b.pid) WHERE d < 10 GROUP BY lag"


@query(
    f"WITH b AS ({SEMI}), t AS (SELECT max(gamma) AS sill, count(*) AS n FROM b) SELECT CASE WHEN n >= 3 AND sill > 0 THEN round(least(greatest((SELECT min((lag + 0.5) * (10.0 / 15)) FROM b, t WHERE gamma >= 0.95 * sill), 0.5), 8.0), 6) ELSE 1.0 END AS range FROM t"
)
def variogram_range(spark: SparkSession, sf: str) -> DataFrame:
    return variogram.variogram_range(points(spark, sf), "v", 10.0, 15, 0.5, 8.0, 1.0).select(R("range").alias("range"))


@query()
def fitted_variogram(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([variogram.fit_variogram(points(spark, sf), "v", 10.0, 20)], "nugget double, sill double, range double")


@query(
    f"WITH m AS ({MONTHLY}), r AS (SELECT site, year, month, rank() OVER (PARTITION BY month ORDER BY quantity) - 1 + (count(*) OVER (PARTITION BY month, quantity) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY month) AS n FROM m WHERE quantity IS NOT NULL), "
    "p AS (SELECT site, year, month, CASE WHEN n > 1 THEN greatest(least(CAST(k AS DOUBLE) / (n - 1), 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) END AS p FROM r) "
    f"SELECT site, year, month, round({ppf_sql('p')}, 6) AS score FROM p"
)
def normal_scores(spark: SparkSession, sf: str) -> DataFrame:
    return variogram.normal_scores(site_months(spark, sf), ["month"], "quantity", "score").select("site", "year", "month", R("score").alias("score"))


@query(
    f"WITH q AS (SELECT p.pid, c.cell, exp(-((c.col+0.5-px)*(c.col+0.5-px)+(c.row+0.5-py)*(c.row+0.5-py))/(2*0.25)) AS g FROM ({GRID}) c JOIN ({POINTS}) p ON (c.col+0.5-px)*(c.col+0.5-px)+(c.row+0.5-py)*(c.row+0.5-py) <= 16.0) "
    "SELECT pid, cell, round(g / sum(g) OVER (PARTITION BY pid), 9) AS w FROM q"
)
def point_footprints(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).select("cell", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return priors.point_footprints(c, points(spark, sf)).withColumn("w", F.round("w", 9))


@query(
    f"WITH q AS (SELECT cell, row % 3 <> 1 AS land, CAST(floor(col / 3.0) AS BIGINT) AS pixel_x, CAST(floor((row - (SELECT min(row) FROM ({GRID}))) / 3.0) AS BIGINT) AS pixel_y FROM ({GRID})) "
    "SELECT pixel_x, pixel_y, cell, 1.0::DOUBLE / count(*) OVER (PARTITION BY pixel_x, pixel_y) AS w FROM q WHERE land"
)
def pixel_footprints(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).select("cell", (F.col("col") + 0.0).alias("x"), (F.col("row") + 0.0).alias("y"), (F.col("row") % 3 != 1).alias("land"))
    return priors.pixel_footprints(c, 3.0, "land")


@query()
def fitted_priors(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.expr("cast((pid - 1) div 50 as int)")
    return priors.best_smoothness(priors.matern_groups(points(spark, sf).withColumn("zone", zone), ["zone"], "v"), ["zone"])

"""Ordered-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.functions.core import month_of
from strataflow.operators import folds, series
from strataflow.functions.normal import ppf_sql
from strataflow.plans.registry import query, read
from strataflow.plans.wells import MONTHLY, months


@query(f"WITH m AS ({MONTHLY}) SELECT site, year, month, round(value - median(value) OVER (PARTITION BY site), 6) AS anomaly FROM m")
def wte_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return series.anomaly(months(spark, sf), ["site"], "value", "anomaly").select("site", "year", "month", F.round("anomaly", 6).alias("anomaly"))


@query(f"WITH m AS ({MONTHLY}) SELECT site, month, round(avg(value), 6) AS mean_value, count(*) AS n FROM m GROUP BY ALL")
def seasonal_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return months(spark, sf).groupBy("site", "month").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


@query(f"WITH m AS ({MONTHLY}) SELECT month, quantile_cont(value, 0.25) AS q25, median(value) AS q50, quantile_cont(value, 0.75) AS q75 FROM m GROUP BY month")
def monthly_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return months(spark, sf).groupBy("month").agg(*[F.percentile("value", q).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.75)])


@query(
    f"WITH m AS ({MONTHLY}) SELECT site, year, month, CASE WHEN count(quantity) OVER w = 3 THEN sum(quantity) OVER w END AS sum3 FROM m "
    "WINDOW w AS (PARTITION BY site ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
)
def rolling3(spark: SparkSession, sf: str) -> DataFrame:
    return series.rolling_sum(months(spark, sf), ["site"], ["year", "month"], "quantity", 3, "sum3").select("site", "year", "month", "sum3")


@query(
    f"WITH m AS ({MONTHLY}), s AS (SELECT site, year, month, CASE WHEN count(quantity) OVER w = 3 THEN sum(quantity) OVER w END AS s3 FROM m WINDOW w AS "
    "(PARTITION BY site ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), v AS (SELECT * FROM s WHERE s3 IS NOT NULL), "
    "r AS (SELECT month, site, year, rank() OVER (PARTITION BY site, month ORDER BY s3) + (count(*) OVER (PARTITION BY site, month, s3) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY site, month) AS n FROM v) "
    "SELECT site, year, month, CASE WHEN n >= 4 THEN round((rk - 1) / (n - 1), 9) END AS p FROM r"
)
def spi3_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.rolling_sum(months(spark, sf), ["site"], ["year", "month"], "quantity", 3, "s3").filter("s3 IS NOT NULL")
    return series.average_rank(rows, ["site", "month"], "s3", "p", 4).select("site", "year", "month", F.round("p", 9).alias("p"))


@query(
    f"WITH m AS ({MONTHLY}), s AS (SELECT site, year, month, CASE WHEN count(quantity) OVER w = 3 THEN sum(quantity) OVER w END AS s3 FROM m WINDOW w AS "
    "(PARTITION BY site ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), v AS (SELECT * FROM s WHERE s3 IS NOT NULL), "
    "r AS (SELECT month, site, year, rank() OVER (PARTITION BY site, month ORDER BY s3) + (count(*) OVER (PARTITION BY site, month, s3) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY site, month) AS n FROM v), "
    "p AS (SELECT site, year, month, CASE WHEN n >= 4 THEN greatest(least(CAST((rk - 1) / (n - 1) AS DOUBLE), 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) END AS p FROM r) "
    f"SELECT s.site, s.year, s.month, round({ppf_sql('p.p')}, 6) AS spi3 FROM s LEFT JOIN p ON p.site = s.site AND p.year = s.year AND p.month = s.month"
)
def spi3(spark: SparkSession, sf: str) -> DataFrame:
    found = series.standardised_index(months(spark, sf), ["site"], ["year", "month"], "month", "quantity", "spi3", rows=3, least=4)
    return found.select("site", "year", "month", F.round("spi3", 6).alias("spi3"))


@query(
    f"WITH m AS ({MONTHLY}) SELECT site, year, month, lag(value, 2) OVER (PARTITION BY site ORDER BY year, month) AS lag2 FROM m"
)
def row_lag(spark: SparkSession, sf: str) -> DataFrame:
    return series.row_lag(months(spark, sf), ["site"], ["year", "month"], "value", 2, "lag2").select("site", "year", "month", "lag2")


@query(
    f"WITH m AS (SELECT *, make_date(year, month, 1) AS ms FROM ({MONTHLY})) SELECT a.site, a.ms, a.value, b.value AS lag1 FROM m a LEFT JOIN m b ON a.site = b.site AND b.ms + INTERVAL 1 MONTH = a.ms"
)
def month_lag(spark: SparkSession, sf: str) -> DataFrame:
    m = months(spark, sf).select("site", F.make_date("year", "month", F.lit(1)).alias("ms"), "value")
    return series.month_lag(m, ["site"], "ms", "value", 1, "lag1").select("site", "ms", "value", "lag1")


YEARLY = "SELECT l_suppkey AS site, CAST(year(l_shipdate) AS INT) AS year, median(l_extendedprice) AS value FROM lineitem GROUP BY ALL"


@query(f"WITH y AS ({YEARLY}) SELECT a.site, round(median((b.value - a.value) / (b.year - a.year)), 6) AS slope, count(*) AS n_pairs FROM y a JOIN y b ON a.site = b.site AND a.year < b.year GROUP BY a.site")
def theil_sen(spark: SparkSession, sf: str) -> DataFrame:
    y = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year")).agg(F.median("l_extendedprice").alias("value"))
    return series.theil_sen(y, ["site"], "year", "value").withColumn("slope", F.round("slope", 6))


@query(
    f"WITH m AS ({MONTHLY}), c AS (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, avg(o_totalprice) AS idx FROM orders GROUP BY ALL) "
    "SELECT site, round(regr_slope(value, idx), 6) AS slope, round(regr_r2(value, idx), 6) AS r2, count(*) AS n FROM m JOIN c USING (year, month) GROUP BY site"
)
def lag_ols(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("idx"))
    fit = series.ols_sums(months(spark, sf).join(c, ["year", "month"]), ["site"], F.col("idx"), F.col("value"))
    return fit.select("site", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "n")


@query(
    f"WITH m AS ({MONTHLY}), d AS (SELECT site, month, value - avg(value) OVER (PARTITION BY site, month) AS v, quantity - avg(quantity) OVER (PARTITION BY site, month) AS q FROM m) "
    "SELECT site, round(corr(v, q), 6) AS r FROM d GROUP BY site"
)
def deseasonalised_corr(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("site", "month")
    d = months(spark, sf).select("site", (F.col("value") - F.avg("value").over(w)).alias("v"), (F.col("quantity") - F.avg("quantity").over(w)).alias("q"))
    return d.groupBy("site").agg(F.round(F.corr("v", "q"), 6).alias("r"))


@query("SELECT decile, count(*) AS n, min(value) AS lo, max(value) AS hi FROM (SELECT value, ntile(10) OVER (ORDER BY value, event_id) AS decile FROM events WHERE event_type = 'purchase') GROUP BY decile")
def decile_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Tenths by exact rank. Ranks come from value buckets and their running counts, so no task orders all rows."""
    rows = read(spark, sf, "events").filter("event_type = 'purchase'").select("value", "event_id").withColumn("b", F.floor("value"))
    counts = rows.groupBy("b").count()
    before = counts.select("b", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy()).alias("total"))
    ranked = rows.join(before, "b").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("value", "event_id")))
    big, size = F.col("total") % 10, F.floor(F.col("total") / 10)
    at = F.col("rank") - 1
    decile = F.when(at < big * (size + 1), F.floor(at / (size + 1))).otherwise(big + F.floor((at - big * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return ranked.groupBy(decile.cast("long").alias("decile")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(
    "SELECT l_suppkey AS site, " + ", ".join(f"count(*) FILTER (month(l_shipdate) = {k}) AS m{k}" for k in range(1, 13)) + " FROM lineitem GROUP BY l_suppkey"
)
def site_month_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), F.month("l_shipdate").alias("m"))
    wide = rows.groupBy("site").pivot("m", list(range(1, 13))).count()
    return wide.select("site", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"m{k}") for k in range(1, 13)])


@query(f"WITH m AS ({MONTHLY}) SELECT site, year, month, value FROM m QUALIFY row_number() OVER (PARTITION BY site ORDER BY year DESC, month DESC) <= 3")
def recent_months_topk(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("site").orderBy(F.desc("year"), F.desc("month"))
    return months(spark, sf).withColumn("n", F.row_number().over(w)).filter("n <= 3").select("site", "year", "month", "value")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders INTERSECT SELECT CAST(date_trunc('month', l_shipdate) AS DATE) FROM lineitem")
def month_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(month_of("o_orderdate").alias("m")).intersect(read(spark, sf, "lineitem").select(month_of("l_shipdate").alias("m")))


@query("SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 5 DAY) t(d) EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders")
def missing_inits_except(spark: SparkSession, sf: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.expr("sequence(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 5 DAY)")).alias("d"))
    return days.exceptAll(days.join(read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct(), "d", "left_semi"))


DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS p, count(*) * 20.0::DOUBLE AS e FROM events GROUP BY ALL"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("p"), (F.count("*") * 20.0).alias("e"))


@query(
    f"WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM ({DAILY})), "
    "f AS (SELECT user_id, day, n, least(greatest(b - 0.6::DOUBLE * greatest(b - 250.0::DOUBLE, 0.0::DOUBLE), 100.0::DOUBLE), 450.0::DOUBLE) AS s FROM "
    "(SELECT user_id, day, n, 250.0::DOUBLE + p - least(e, greatest(250.0::DOUBLE + p - 100.0::DOUBLE, 0.0::DOUBLE)) AS b FROM d WHERE n = 1) UNION ALL "
    "SELECT user_id, day, n, least(greatest(b - 0.6::DOUBLE * greatest(b - 250.0::DOUBLE, 0.0::DOUBLE), 100.0::DOUBLE), 450.0::DOUBLE) FROM "
    "(SELECT d.user_id, d.day, d.n, f.s + d.p - least(d.e, greatest(f.s + d.p - 100.0::DOUBLE, 0.0::DOUBLE)) AS b FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1)) "
    "SELECT user_id, day, round(s / 1000, 6) AS theta FROM f"
)
def total_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return folds.total_bucket(daily(spark, sf), ["user_id"], "day", "p", "e", 0.10, 0.25, 0.45).withColumn("theta", F.round("theta", 6))


@query(
    f"WITH RECURSIVE d AS (SELECT user_id, day, p, CAST(day(day) % 12 AS DOUBLE) - 5 AS t, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM ({DAILY})), "
    "x AS (SELECT *, least(greatest((3.0::DOUBLE - t) / 4.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS fr, 3.0::DOUBLE * greatest(t, 0.0::DOUBLE) AS m FROM d), "
    "f AS (SELECT user_id, day, n, fr * p - least(fr * p, m) AS swe, (1 - fr) * p + least(fr * p, m) AS liquid FROM x WHERE n = 1 UNION ALL "
    "SELECT x.user_id, x.day, x.n, f.swe + x.fr * x.p - least(f.swe + x.fr * x.p, x.m), (1 - x.fr) * x.p + least(f.swe + x.fr * x.p, x.m) FROM f JOIN x ON x.user_id = f.user_id AND x.n = f.n + 1) "
    "SELECT user_id, day, round(liquid, 6) AS liquid FROM f"
)
def snow_degree_day(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("t", (F.day("day") % 12).cast("double") - 5)
    return folds.snow_liquid(d, ["user_id"], "day", "p", "t", 1.0).withColumn("liquid", F.round("liquid", 6))


NUMBERED = f"d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM ({DAILY}))"


@query(
    f"WITH RECURSIVE {NUMBERED}, f(user_id, day, n, s, loss) AS (SELECT user_id, day, n - 1, 50.0::DOUBLE, greatest(e - p, 0.0::DOUBLE) FROM d WHERE n = 1 UNION ALL "
    "SELECT user_id, day, n, CASE WHEN p >= e THEN filled ELSE 100 * exp(-(loss + (e - p)) / 100) END, CASE WHEN p < e THEN loss + (e - p) WHEN filled >= 100 THEN 0 ELSE -100 * ln(least(greatest(filled / 100, 1e-6), 1.0)) END FROM "
    "(SELECT d.user_id, d.day, d.n, d.p, d.e, f.loss, least(f.s + d.p - d.e, 100.0::DOUBLE) AS filled FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1)) "
    "SELECT user_id, day, round(least(greatest(s / 100, 0.0), 1.0), 6) AS wetness FROM f WHERE n > 0"
)
def thornthwaite(spark: SparkSession, sf: str) -> DataFrame:
    return folds.thornthwaite_mather(daily(spark, sf), ["user_id"], "day", "p", "e", 100.0).withColumn("wetness", F.round("wetness", 6))


def _filter_pass(name: str, source: str) -> str:
    """One pass of the digital filter over source(user_id, n, c, q) in the order of n."""
    return (
        f"{name}(user_id, n, c, q, f) AS (SELECT user_id, n, c, q, 0.0::DOUBLE FROM {source} WHERE n = 1 UNION ALL SELECT s.user_id, s.n, s.c, s.q, 0.925::DOUBLE * {name}.f + (1 + 0.925::DOUBLE) / 2 * (s.c - {name}.c) "
        f"FROM {name} JOIN {source} s ON s.user_id = {name}.user_id AND s.n = {name}.n + 1), {name}b AS (SELECT user_id, n, q, least(greatest(c - greatest(f, 0.0::DOUBLE), 0.0::DOUBLE), q) AS c FROM {name})"
    )


@query(
    f"WITH RECURSIVE {NUMBERED}, m AS (SELECT user_id, max(n) + 1 AS m FROM d GROUP BY user_id), s1 AS (SELECT user_id, n, p AS c, p AS q FROM d), {_filter_pass('a', 's1')}, "
    f"s2 AS (SELECT ab.user_id, m - n AS n, c, q FROM ab JOIN m ON m.user_id = ab.user_id), {_filter_pass('b', 's2')}, s3 AS (SELECT bb.user_id, m - n AS n, c, q FROM bb JOIN m ON m.user_id = bb.user_id), {_filter_pass('g', 's3')} "
    "SELECT d.user_id, d.day, d.p, round(gb.c, 6) AS baseflow FROM gb JOIN d ON d.user_id = gb.user_id AND d.n = gb.n"
)
def baseflow_filter(spark: SparkSession, sf: str) -> DataFrame:
    return folds.baseflow(daily(spark, sf), ["user_id"], "day", "p").withColumn("baseflow", F.round("baseflow", 6))


@query(
    "SELECT user_id, CAST(time_bucket(INTERVAL 1 DAY, ts) AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL"
)
def tumbling_daily(spark: SparkSession, sf: str) -> DataFrame:
    w = F.window("ts", "1 day")
    return read(spark, sf, "events").groupBy("user_id", w).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select("user_id", F.to_date("window.start").alias("day"), "n", "mean_value")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid"
)
def session_gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.min("ts").alias("started")).select("user_id", "started", "n")

"""More station, grid and string queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.operators import series
from strataflow.plans.registry import query, read
from strataflow.plans.space import GRID, PAIRS, POINTS, grid, pairs, points
from strataflow.plans.wells import MONTHLY, months
from strataflow.sources.readers import status_code


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "SELECT conv_id, coalesce(list_extract(list_filter(list_transform(list(role ORDER BY turn), lambda x: CASE x WHEN 'user' THEN '' WHEN 'assistant' THEN 'P' WHEN 'system' THEN 'D' ELSE '' END), lambda c: c <> ''), 1), '') AS code "
    "FROM conversations GROUP BY conv_id"
)
def qualifier_first_code(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("user", "static", "assistant", "Pumping", "system", "dry")])
    per = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", names[F.col("role")].alias("q")))).alias("t"))
    return per.select("conv_id", status_code(F.transform("t", lambda x: x["q"])).alias("code"))


@query("SELECT p_partkey AS part, regexp_extract(p_brand, '#(\\d+)', 1) AS code, regexp_extract(p_type, '^(\\w+)', 1) AS head FROM part")
def regex_month(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("code"), F.regexp_extract("p_type", r"^(\w+)", 1).alias("head"))


@query(
    "SELECT a.event_id, arg_min(b.value, (abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, b.value)) AS nearest_value FROM "
    "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') a LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') b "
    "ON a.user_id = b.user_id GROUP BY a.event_id"
)
def nearest_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("ts2"), "value")
    return series.asof_nearest(left, right, ["user_id"], "ts", "ts2", "value").select("event_id", "nearest_value")


@query(
    f"WITH m AS ({MONTHLY}), c AS (SELECT site, month, avg(quantity) AS clim FROM m WHERE year < 1999 GROUP BY ALL) "
    "SELECT k.site, k.month, round(coalesce(m.quantity, c.clim), 6) AS filled FROM (SELECT s_suppkey AS site, CAST(unnest(range(1, 13)) AS INT) AS month FROM supplier) k "
    "LEFT JOIN m ON m.site = k.site AND m.month = k.month AND m.year = 1999 LEFT JOIN c ON c.site = k.site AND c.month = k.month"
)
def climatology_fallback(spark: SparkSession, sf: str) -> DataFrame:
    m = months(spark, sf)
    keys = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    clim = m.filter("year < 1999").groupBy("site", "month").agg(F.avg("quantity").alias("clim"))
    own = m.filter("year = 1999").select("site", "month", "quantity")
    return keys.join(own, ["site", "month"], "left").join(clim, ["site", "month"], "left").select("site", "month", F.round(F.coalesce("quantity", "clim"), 6).alias("filled"))


@query(
    "SELECT o_orderkey AS k, count(*) AS n, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey"
)
def range_window_join(spark: SparkSession, sf: str) -> DataFrame:
    o, l = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    near = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return o.join(l, (F.col("o_orderkey") == F.col("l_orderkey")) & near).groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"SELECT pid, CASE WHEN px BETWEEN 0 AND 15 AND py BETWEEN 0 AND 20 THEN '17' WHEN px BETWEEN 10 AND 30 AND py BETWEEN 10 AND 40 THEN '18' ELSE '99' END AS code FROM ({POINTS})")
def huc_first_match(spark: SparkSession, sf: str) -> DataFrame:
    boxes = spark.createDataFrame([("18", 2, 10.0, 30.0, 10.0, 40.0), ("17", 1, 0.0, 15.0, 0.0, 20.0)], "code string, rank int, x0 double, x1 double, y0 double, y1 double")
    return series.first_match(points(spark, sf), boxes, "px", "py", "99").select("pid", "code")


@query(f"SELECT cell, round(hand * (1 + z / max(z) OVER ()), 6) AS runoff FROM ({GRID})")
def accumulate_runoff(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    top = g.agg(F.max("z").alias("top"))  # one row
    return g.join(F.broadcast(top)).select("cell", F.round(F.col("hand") * (1 + F.col("z") / F.col("top")), 6).alias("runoff"))


@query(
    f"WITH b AS (SELECT row // 5 AS r, col // 5 AS c, avg(z) AS fine, avg(hand) * 30 AS coarse FROM ({GRID}) GROUP BY ALL) SELECT count(*) AS n, round(avg(fine - coarse), 6) AS bias, "
    "round(sqrt(avg((fine - coarse) * (fine - coarse))), 6) AS rmse, round(corr(fine, coarse), 6) AS corr FROM b"
)
def native_scale_stats(spark: SparkSession, sf: str) -> DataFrame:
    b = grid(spark, sf).groupBy(F.expr("row div 5").alias("r"), F.expr("col div 5").alias("c")).agg(F.avg("z").alias("fine"), (F.avg("hand") * 30).alias("coarse"))
    d = F.col("fine") - F.col("coarse")
    return b.agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("bias"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), F.round(F.corr("fine", "coarse"), 6).alias("corr"))


@query(
    f"WITH w AS (SELECT cell, pid % 2 AS src, sum(exp(-d*d/(2*4.0*4.0)) / CASE pid % 2 WHEN 0 THEN 0.0004 ELSE 0.04 END) AS w FROM ({PAIRS}) WHERE d <= 10 GROUP BY ALL) "
    "SELECT cell, round(coalesce(sum(w) FILTER (src = 0), 0) / (sum(w) + 400), 6) AS share_a, round(coalesce(sum(w) FILTER (src = 1), 0) / (sum(w) + 400), 6) AS share_b, round(400 / (sum(w) + 400), 6) AS share_model FROM w GROUP BY cell"
)
def attribution_shares(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf, 10.0)
    w = F.exp(-F.col("d") * F.col("d") / 32.0) / F.when(F.col("pid") % 2 == 0, 0.0004).otherwise(0.04)
    s = p.groupBy("cell").agg(F.coalesce(F.sum(F.when(F.col("pid") % 2 == 0, w)), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(F.col("pid") % 2 == 1, w)), F.lit(0.0)).alias("b"))
    total = F.col("a") + F.col("b") + 400
    return s.select("cell", F.round(F.col("a") / total, 6).alias("share_a"), F.round(F.col("b") / total, 6).alias("share_b"), F.round(400 / total, 6).alias("share_model"))


@query("SELECT year, quarter, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, 1 AS n FROM orders) GROUP BY CUBE (year, quarter)")
def order_cube(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    return o.cube("year", "quarter").agg(F.count("*").alias("n"))


@query(f"WITH m AS ({MONTHLY}) SELECT site, year, month, round(avg(value) OVER (PARTITION BY site ORDER BY year, month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS mean12 FROM m")
def rolling_mean12(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("site").orderBy("year", "month").rowsBetween(-11, 0)
    return months(spark, sf).select("site", "year", "month", F.round(F.avg("value").over(w), 6).alias("mean12"))

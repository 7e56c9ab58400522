"""Quality control and aggregation queries on the driver's tables: lineitem as readings, supplier as sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import classify
from strataflow.operators import wells
from strataflow.plans.registry import query, read


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("status")
    )


def steps() -> dict[str, Column]:
    return {"status": ~F.coalesce(F.col("status").isin("R"), F.lit(False)), "date": F.col("date") >= F.lit("1996-01-01").cast("date"), "value": F.col("value") >= 2000}


@query(
    "SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events "
    "WHERE coalesce(event_type NOT IN ('click', 'error'), true) AND value > 1"
)
def qc_status_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").filter(~F.coalesce(F.col("event_type").isin("click", "error"), F.lit(False)) & (F.col("value") > 1))
    return e.select("event_id", "user_id", "value", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(
    "SELECT count(*) AS n_input, count(*) FILTER (l_returnflag = 'R') AS dropped_status, "
    "count(*) FILTER (l_returnflag <> 'R' AND l_shipdate < DATE '1996-01-01') AS dropped_date, "
    "count(*) FILTER (l_returnflag <> 'R' AND l_shipdate >= DATE '1996-01-01' AND l_extendedprice < 2000) AS dropped_value, "
    "count(*) FILTER (l_returnflag <> 'R' AND l_shipdate >= DATE '1996-01-01' AND l_extendedprice >= 2000) AS n_output FROM lineitem"
)
def qc_report_counts(spark: SparkSession, sf: str) -> DataFrame:
    return wells.filter_report(readings(spark, sf), steps())


@query(
    "WITH r AS (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS value FROM lineitem WHERE l_returnflag <> 'R' "
    "AND l_shipdate >= DATE '1996-01-01' AND l_extendedprice >= 2000), "
    "k AS (SELECT site FROM r GROUP BY site HAVING count(*) >= 10) "
    "SELECT r.site, n_name AS nation, round(r.value * 0.3048, 6) AS value_m, s_acctbal > 5000 AS is_deep FROM r JOIN k USING (site) "
    "JOIN supplier ON s_suppkey = r.site JOIN nation ON n_nationkey = s_nationkey"
)
def qc_chain(spark: SparkSession, sf: str) -> DataFrame:
    kept = wells.at_least(wells.filter_chain(readings(spark, sf), steps()), ["site"], 10)
    sites = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return kept.join(sites, F.col("site") == F.col("s_suppkey")).select(
        "site", F.col("n_name").alias("nation"), F.round(F.col("value") * 0.3048, 6).alias("value_m"), (F.col("s_acctbal") > 5000).alias("is_deep")
    )


@query("SELECT s_suppkey AS site, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_shipdate < DATE '1996-06-01')")
def qc_sparse_anti(spark: SparkSession, sf: str) -> DataFrame:
    seen = read(spark, sf, "lineitem").filter("l_quantity > 49.5 AND l_shipdate < '1996-06-01'")
    return read(spark, sf, "supplier").join(seen, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("name"))


@query("SELECT s_suppkey AS site FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49.5)")
def flowing_semi(spark: SparkSession, sf: str) -> DataFrame:
    flows = read(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 49.5")
    return read(spark, sf, "supplier").join(flows, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(F.col("s_suppkey").alias("site"))


MONTHLY = (
    "SELECT l_suppkey AS site, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, median(l_extendedprice) AS value, "
    "median(l_quantity) AS quantity, count(*) AS n_obs FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'R' GROUP BY ALL"
)


def months(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").filter("not l_returnflag <=> 'R'")
    return wells.monthly(rows.withColumnRenamed("l_suppkey", "site"), "site", "l_shipdate", {"value": "l_extendedprice", "quantity": "l_quantity"})


@query(MONTHLY)
def monthly_median(spark: SparkSession, sf: str) -> DataFrame:
    return months(spark, sf)


@query(
    f"WITH m AS ({MONTHLY}) SELECT site, round(avg(value), 6) AS mean_value, median(value) AS median_value, round(stddev_samp(value), 6) AS std_value, "
    "count(value) AS n_observed_months, min(year) AS first_year, max(year) AS last_year FROM m GROUP BY site"
)
def site_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = wells.site_summary(months(spark, sf), "site", "value")
    return out.withColumn("mean_value", F.round("mean_value", 6)).withColumn("std_value", F.round("std_value", 6))


@query(
    f"WITH m AS (SELECT site, year * 12 + month AS ym FROM ({MONTHLY})), g AS (SELECT site, ym, ym - lag(ym) OVER (PARTITION BY site ORDER BY ym) - 1 AS gap FROM m), "
    "s AS (SELECT site, count(*) AS n_observed_months, CAST(max(ym) - min(ym) + 1 AS INT) AS n_possible_months, CAST(coalesce(max(gap), 0) AS INT) AS max_gap_months FROM g GROUP BY site) "
    "SELECT *, round(n_observed_months / n_possible_months, 4) AS coverage_fraction, round(n_possible_months / 12, 2) AS record_span_years, "
    "round(n_observed_months / n_possible_months, 4) < 0.10 AS is_sparse_timeseries, max_gap_months > 36 AS has_long_gap FROM s"
)
def site_coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return wells.coverage(months(spark, sf), "site")


TARGET = (
    "SELECT p_partkey AS site, p_size AS depth, CASE WHEN flowing AND (p_size >= 40 OR deep OR confined) THEN 'aquifer_head' WHEN flowing AND base = 'water_table' THEN 'unknown' ELSE base END AS target FROM ("
    "SELECT *, CASE WHEN confined THEN 'aquifer_head' WHEN top > 20 AND bottom IS NOT NULL THEN 'aquifer_head' WHEN top >= 40 THEN 'aquifer_head' WHEN top <= 20 THEN 'water_table' "
    "WHEN p_size >= 40 OR deep THEN 'aquifer_head' WHEN p_size <= 20 THEN 'water_table' ELSE 'unknown' END AS base FROM ("
    "SELECT p_partkey, p_size, p_retailprice > 1900 AS deep, p_brand = 'Brand#11' AS confined, p_partkey % 7 = 0 AS flowing, "
    "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 60 AS DOUBLE) END AS top, CASE WHEN p_partkey % 6 = 0 THEN 99.0 END AS bottom FROM part))"
)


def targets(spark: SparkSession, sf: str) -> DataFrame:
    p, key = read(spark, sf, "part"), F.col("p_partkey")
    target = classify.measurement_target(
        F.col("p_size"), F.when(key % 3 == 0, (key % 60).cast("double")), F.when(key % 6 == 0, 99.0), F.when(F.col("p_brand") == "Brand#11", "c"), key % 7 == 0, F.col("p_retailprice") > 1900, 20, 40
    )
    return p.select(key.alias("site"), F.col("p_size").alias("depth"), target.alias("target"))


@query(TARGET)
def measurement_target(spark: SparkSession, sf: str) -> DataFrame:
    return targets(spark, sf)


@query(f"SELECT coalesce(target, 'all') AS target, count(*) AS n, median(depth) AS median_depth FROM ({TARGET}) GROUP BY ROLLUP (target)")
def target_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return targets(spark, sf).rollup("target").agg(F.count("*").alias("n"), F.median("depth").alias("median_depth")).withColumn("target", F.coalesce("target", F.lit("all")))


@query("SELECT p_partkey AS site, CASE WHEN p_retailprice > 1900 OR p_size >= 40 THEN 'deep_confined' WHEN p_size <= 20 THEN 'shallow_watertable' ELSE 'ambiguous' END AS hydro_class FROM part")
def hydro_class(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("site"), classify.hydro_class("p_size", F.col("p_retailprice") > 1900, 20, 40).alias("hydro_class"))


@query(
    "SELECT p_partkey AS cell, CAST(CASE WHEN lith IS NULL THEN 255 WHEN coast <= 2000 AND p_size <= 10 THEN 5 WHEN lith = 3 THEN 4 WHEN lith = 2 THEN 3 WHEN lith = 1 THEN 2 "
    "WHEN p_size <= 8 THEN 0 ELSE 1 END AS SMALLINT) AS domain FROM (SELECT *, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 4 END AS lith, p_retailprice * 2 AS coast FROM part)"
)
def classify_domains(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    lith = F.when(key % 11 != 0, key % 4)
    return read(spark, sf, "part").select(key.alias("cell"), classify.domain_class(F.col("p_size"), lith, F.col("p_retailprice") * 2).alias("domain"))


@query("SELECT p_partkey AS cell, CASE WHEN p_size < 5 THEN 'valley' WHEN p_size < 20 THEN 'transition' ELSE 'upland' END AS zone FROM part")
def terrain_zone(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), classify.terrain_zone("p_size").alias("zone"))


@query(
    "SELECT p_partkey AS cell, CASE WHEN t < 0.0022 THEN 180.0 WHEN t < 0.0063 THEN 240.0 WHEN t < 0.018 THEN 300.0 WHEN t < 0.05 THEN 360.0 WHEN t < 0.10 THEN 490.0 "
    "WHEN t < 0.138 THEN 620.0 ELSE 760.0 END::DOUBLE AS vs30 FROM (SELECT p_partkey, tan(radians(p_size / 5.0)) AS t FROM part)"
)
def slope_vs30(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), classify.slope_vs30(F.col("p_size") / 5.0).alias("vs30"))


@query("SELECT p_partkey AS cell, CASE WHEN p_retailprice < 180 THEN 'E' WHEN p_retailprice < 360 THEN 'D' WHEN p_retailprice < 760 THEN 'C' WHEN p_retailprice < 1500 THEN 'B' ELSE 'A' END AS class FROM part")
def site_class(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("cell"), classify.site_class("p_retailprice").alias("class"))


@query(
    "SELECT p_partkey AS unit, CASE WHEN lith IS NOT NULL AND regexp_matches(p_type, 'STEEL|BRASS') THEN 3 ELSE lith END AS lithology FROM "
    "(SELECT *, CASE lower(trim(p_brand)) WHEN 'brand#11' THEN 0 WHEN 'brand#12' THEN 0 WHEN 'brand#21' THEN 1 WHEN 'brand#31' THEN 2 END AS lith FROM part)"
)
def lithology_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    walk = F.create_map(*[F.lit(x) for x in ("brand#11", 0, "brand#12", 0, "brand#21", 1, "brand#31", 2)])
    lith = walk[F.lower(F.trim("p_brand"))]
    return read(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.when(lith.isNotNull() & F.col("p_type").rlike("STEEL|BRASS"), 3).otherwise(lith).alias("lithology"))


@query("SELECT DISTINCT l_suppkey AS site FROM lineitem WHERE l_returnflag = 'A'")
def distinct_sites(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_suppkey").alias("site")).distinct()


@query(
    "SELECT 's' AS network, CAST(s_suppkey AS VARCHAR) AS station, s_acctbal AS level, NULL::DOUBLE AS theta FROM supplier UNION ALL "
    "SELECT 'c', CAST(c_custkey AS VARCHAR), NULL, c_acctbal FROM customer"
)
def station_union(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "supplier").select(F.lit("s").alias("network"), F.col("s_suppkey").cast("string").alias("station"), F.col("s_acctbal").alias("level"))
    b = read(spark, sf, "customer").select(F.lit("c").alias("network"), F.col("c_custkey").cast("string").alias("station"), F.col("c_acctbal").alias("theta"))
    return wells.union_sources(a, None, b)


@query(
    "SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1"
)
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = wells.dedup_first(read(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")])
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("part"))

"""Quality control, monthly and site tables of station readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.core import flag, optional
from strataflow.functions.hydro import albers


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def filter_chain(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows for which every step holds; a step that is NULL keeps the row only if the caller says so with coalesce."""
    return df.filter(reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in steps.values()]))


def filter_report(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """n_input, one dropped_<step> per step in chain order, n_output, from a single pass."""
    passed, cols = F.lit(True), [F.count("*").alias("n_input")]
    for name, step in steps.items():
        ok = F.coalesce(step, F.lit(False))
        cols.append(F.count_if(passed & ~ok).alias(f"dropped_{name}"))
        passed = passed & ok
    return df.agg(*cols, F.count_if(passed).alias("n_output"))


def at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows whose key has n rows or more. Counted apart, so a hot key is pre-aggregated, not gathered."""
    enough = df.groupBy(*keys).count().filter(F.col("count") >= n).select(*keys)
    return df.join(enough, keys, "left_semi")


def monthly(df: DataFrame, site: str, date: str, values: dict[str, str]) -> DataFrame:
    """site, year, month, median of each value, n_obs."""
    return df.groupBy(site, F.year(date).alias("year"), F.month(date).alias("month")).agg(
        *[F.median(c).alias(name) for name, c in values.items()], F.count("*").alias("n_obs")
    )


def coverage(months: DataFrame, site: str) -> DataFrame:
    """Per site of monthly(): n_observed_months, n_possible_months, coverage_fraction, max_gap_months, record_span_years, flags."""
    ym = F.col("year") * 12 + F.col("month")
    w = Window.partitionBy(site).orderBy("ym")
    gaps = months.withColumn("ym", ym).withColumn("gap", F.col("ym") - F.lag("ym").over(w) - 1)
    out = gaps.groupBy(site).agg(
        F.count("*").alias("n_observed_months"),
        (F.max("ym") - F.min("ym") + 1).cast("int").alias("n_possible_months"),
        F.coalesce(F.max("gap"), F.lit(0)).cast("int").alias("max_gap_months"),
    )
    fraction = F.round(F.col("n_observed_months") / F.col("n_possible_months"), 4)
    return (
        out.withColumn("coverage_fraction", fraction)
        .withColumn("record_span_years", F.round(F.col("n_possible_months") / 12, 2))
        .withColumn("is_sparse_timeseries", F.col("coverage_fraction") < 0.10)
        .withColumn("has_long_gap", F.col("max_gap_months") > 36)
    )


def site_summary(months: DataFrame, site: str, value: str) -> DataFrame:
    return months.groupBy(site).agg(
        F.avg(value).alias(f"mean_{value}"),
        F.median(value).alias(f"median_{value}"),
        F.stddev_samp(value).alias(f"std_{value}"),
        F.count(value).alias("n_observed_months"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def union_sources(*frames: DataFrame | None) -> DataFrame:
    """UNION ALL by name of those that exist; columns a source lacks are NULL."""
    found = [f for f in frames if f is not None]
    if not found:
        raise ValueError("no source")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


# -- which wells observe the water table


def water_table_wells(sites: DataFrame, depth: str = "well_depth_m", deep: str = "is_deep_well", most: float = 30.0, keep_unknown: bool = True) -> DataFrame:
    """Sites not deeper than `most` and not flagged deep; those of unknown depth stay unless told otherwise."""
    d = F.col(depth).try_cast("double")
    shallow = F.coalesce(d <= most, F.lit(False))
    return sites.filter((shallow | d.isNull() if keep_unknown else shallow) & ~F.coalesce(F.col(deep), F.lit(False)))


def water_table_observations(sites: DataFrame, target: Column, include_unknown: bool = False) -> DataFrame:
    """Sites whose measurement target is the water table (or unknown), with measurement_target."""
    wanted = ["water_table", "unknown"] if include_unknown else ["water_table"]
    return sites.withColumn("measurement_target", target).filter(F.col("measurement_target").isin(*wanted))


def screening_summary(sites: DataFrame, hydro_class: Column, depth: str, level: str) -> DataFrame:
    """hydro_class, n, median_depth_m, median_dtw_m for each of the three classes, also of none."""
    found = sites.groupBy(hydro_class.alias("hydro_class")).agg(F.count("*").alias("n"), F.median(depth).alias("median_depth_m"), F.median(level).alias("median_dtw_m"))
    names = sites.sparkSession.createDataFrame([("shallow_watertable",), ("ambiguous",), ("deep_confined",)], "hydro_class string")
    return names.join(found, "hydro_class", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def usable_sites(sites: DataFrame, level: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Sites that are neither sparse nor with a long gap and have a place and a level, with x_5070, y_5070."""
    missing = {level, lat, lon, "is_sparse_timeseries", "has_long_gap"} - set(sites.columns)
    if missing:
        raise KeyError(f"missing columns: {sorted(missing)}")
    x, y = albers(F.col(lon), F.col(lat))
    kept = sites.filter(~F.col("is_sparse_timeseries") & ~F.col("has_long_gap")).dropna(subset=[lat, lon, level])
    return kept.withColumn("x_5070", x).withColumn("y_5070", y)


def baseline_sites(sites: DataFrame, level: str = "median_dtw_m", max_depth: float | None = None) -> DataFrame:
    """Sites to fit a baseline on: not sparse, not deep, of a level above 0; with max_depth only water-table wells."""
    sites = optional(sites, is_sparse_timeseries="boolean", is_deep_well="boolean", well_depth_m="double")
    kept = sites.filter(~flag("is_sparse_timeseries") & ~flag("is_deep_well") & (F.col(level) > 0))
    return kept if max_depth is None else water_table_wells(kept, most=max_depth)


def with_sites(readings: DataFrame, sites: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """readings joined to the first row of each site; those of sites that are unknown or without a place go."""
    first = dedup_first(sites, [key], [F.col(c).asc_nulls_last() for c in (lat, lon)])
    return readings.join(first, key, "left").filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def latest_per_key(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key: what a retry gave counts, not what failed before."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("_at"), *rest)).alias("_row")).select(*keys, *[f"_row.{c}" for c in rest])


def kinds_of_keys(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """kind, n: how many different keys there are of each kind."""
    return df.select(*keys, kind).distinct().groupBy(kind).agg(F.count("*").alias("n"))


# -- checkpoints of a download, as tables


def checkpoint(done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """key, state ('done' or 'failed'); a key that is in both is done."""
    both = done.select(key).withColumn("state", F.lit("done")).unionByName(failed.select(key).withColumn("state", F.lit("failed")))
    return both.groupBy(key).agg(F.min("state").alias("state"))


def still_to_do(wanted: DataFrame, marks: DataFrame, key: str, retry_failed: bool = True) -> DataFrame:
    over = marks.filter(F.col("state") == "done") if retry_failed else marks
    return wanted.join(over.select(key).distinct(), key, "left_anti")

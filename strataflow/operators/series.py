"""Ordered series: anomalies, lags, rolling windows, ranks, trends, as-of and calendar joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.normal import norm_ppf


def anomaly(df: DataFrame, keys: list[str], value: str, out: str, centre: str = "median") -> DataFrame:
    """value minus the key's median or mean. The centre is joined, so a hot key is never gathered for a mean."""
    agg = {"median": F.median, "mean": F.avg}[centre](value).alias("_centre")
    return df.join(df.groupBy(*keys).agg(agg), keys).withColumn(out, F.col(value) - F.col("_centre")).drop("_centre")


def rolling_sum(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, out: str) -> DataFrame:
    """Sum of the last `rows` rows, NULL until there are that many."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == rows, F.sum(value).over(w)))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, least: int = 1) -> DataFrame:
    """(average rank - 1) / (n - 1) among the key's n values, NULL for keys of fewer than `least` of them and where the value is."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    n, ties = F.count(value).over(Window.partitionBy(*keys)), F.count("*").over(Window.partitionBy(*keys, value))
    rank = F.rank().over(order) + (ties - 1) / 2
    return df.withColumn(out, F.when(F.col(value).isNotNull() & (n >= F.lit(max(least, 2))), (rank - 1) / (n - 1)))


def standardised_index(
    df: DataFrame, keys: list[str], order: list[str], season: str, value: str, out: str, rows: int = 3, least: int = 10
) -> DataFrame:
    """The normal quantile of a rolling sum's rank among those of its key and season (a calendar month): SPI of so many rows.

    Ends are held at the quantiles of 1e-7; NULL for fewer than `least` sums.
    """
    sums = rolling_sum(df, keys, order, value, rows, "_sum")
    known = average_rank(sums.filter("_sum is not null"), [*keys, season], "_sum", "_p", least).select(*keys, *order, "_p")
    p = F.when(F.col("_p").isNotNull(), F.greatest(F.least(F.col("_p"), F.lit(1 - 1e-7)), F.lit(1e-7)))
    return sums.join(known, [*keys, *order], "left").withColumn(out, norm_ppf(p)).drop("_sum", "_p")


def row_lag(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, out: str) -> DataFrame:
    """The value k rows before: gaps in the calendar are passed over."""
    return df.withColumn(out, F.lag(value, k).over(Window.partitionBy(*keys).orderBy(*order)))


def month_lag(df: DataFrame, keys: list[str], month: str, value: str, k: int, out: str) -> DataFrame:
    """The value of the calendar month k before, NULL where that month is missing."""
    before = df.select(*keys, F.add_months(month, k).alias(month), F.col(value).alias(out))
    return df.join(before, [*keys, month], "left")


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median slope over all pairs of a key's rows; meant for yearly or monthly series, whose length time bounds."""
    a, b = df.select(*keys, F.col(x).alias("x1"), F.col(y).alias("y1")), df.select(*keys, F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(b, keys).filter("x1 < x2")
    return pairs.groupBy(*keys).agg(F.median((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("slope"), F.count("*").alias("n_pairs"))


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str, within: float | None = None) -> DataFrame:
    """left with the right value nearest in time (earlier wins; of one time the smallest), at most `within` seconds away.

    Both sides are put in order of time together, so any distance is bridged in one pass; equal left rows all stay.
    """
    at = F.struct(F.col(rt).cast("timestamp").alias("t"), F.col(value).alias("v"))
    once = right.filter(F.col(rt).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, rt).agg(F.min(value).alias(value))
    points = once.select(*keys, F.col(rt).cast("timestamp").alias("_t"), at.alias("_point"), F.lit(None).cast(left.schema).alias("_row"))
    asks = left.select(*keys, F.col(lt).cast("timestamp").alias("_t"), F.lit(None).cast(points.schema["_point"].dataType).alias("_point"), F.struct(*left.columns).alias("_row"))
    both = points.unionByName(asks)
    before = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.col("_t").desc_nulls_last(), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_before", F.last("_point", ignorenulls=True).over(before)).withColumn("_after", F.last("_point", ignorenulls=True).over(after))
    gap = [F.abs(F.unix_micros(F.col("_t")) - F.unix_micros(F.col(f"{c}.t"))) for c in ("_before", "_after")]
    near = F.when(F.col("_after").isNull() | (gap[0] <= gap[1]), F.struct(gap[0].alias("gap"), F.col("_before.v").alias("v"))).otherwise(
        F.struct(gap[1].alias("gap"), F.col("_after.v").alias("v"))
    )
    found = seen.filter("_row is not null").select("_row.*", near.alias("_near"))
    ok = F.col("_near.gap").isNotNull() if within is None else F.col("_near.gap") <= int(within * 1e6)
    return found.withColumn(f"nearest_{value}", F.when(ok, F.col("_near.v"))).drop("_near")


def first_match(df: DataFrame, boxes: DataFrame, x: str, y: str, default: str) -> DataFrame:
    """df with the code of the first box (code, rank, x0, x1, y0, y1) that holds the point; boxes is a short constant table."""
    rows = boxes.orderBy("rank").collect()
    out = None
    for r in rows:
        inside = F.col(x).between(r["x0"], r["x1"]) & F.col(y).between(r["y0"], r["y1"])
        out = F.when(inside, r["code"]) if out is None else out.when(inside, r["code"])
    return df.withColumn("code", out.otherwise(default) if out is not None else F.lit(default))


def ols_sums(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """slope, intercept, r2, n of a line fitted to each key's complete rows."""
    ok = x.isNotNull() & y.isNotNull()
    return df.filter(ok).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n")
    )

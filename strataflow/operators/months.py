"""Monthly and daily series as tables: regular months, seasonal cycles, amplitudes, lagged fits, comparisons with observations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_months(df: DataFrame, keys: list[str], month: str, value: str, most: int = 3) -> DataFrame:
    """keys, month, value of every month from a key's first to its last; of a gap the first `most` months are interpolated.

    Months are given by any of their days and come as their first; rows of one month count as their mean, null values as none.
    Months come from the gap before each row, so a key's series is never gathered.
    """
    known = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.trunc(month, "month").alias("_m")).agg(F.avg(F.col(value).cast("double")).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_m")
    steps = known.withColumn("_next", F.lead("_m").over(w)).withColumn("_nv", F.lead("_v").over(w))
    gap = F.coalesce(F.months_between("_next", "_m").cast("int"), F.lit(1))
    rows = steps.withColumn("_gap", gap).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)))
    filled = F.when(F.col("_k") == 0, F.col("_v")).when(F.col("_k") <= most, F.col("_v") + (F.col("_nv") - F.col("_v")) * F.col("_k") / F.col("_gap"))
    return rows.select(*keys, F.add_months("_m", F.col("_k")).alias(month), filled.alias(value))


def seasonal_cycle(df: DataFrame, month: Column, value: Column) -> DataFrame:
    """month, mean, sd, n, se of the mean."""
    return df.groupBy(month.alias("month")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).withColumn(
        "se", F.col("sd") / F.sqrt(F.col("n").cast("double"))
    )


def classical_decomposition(df: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """trend (centred 2 x 12 mean), seasonal (its mean residual by calendar month, centred) and rest of regular_months()'s rows.

    NULL within half a year of an end or where a month of the window is missing.
    """
    order = Window.partitionBy(*keys).orderBy(month)
    inner, ends = order.rowsBetween(-5, 5), (F.lag(value, 6).over(order) + F.lead(value, 6).over(order)) / 2
    trend = F.when(F.count(value).over(inner) == 11, (F.sum(value).over(inner) + ends) / 12)
    rows = df.withColumn("trend", trend).withColumn("_moy", F.month(month)).withColumn("_d", F.col(value) - F.col("trend"))
    cycle = rows.groupBy(*keys, "_moy").agg(F.avg("_d").alias("_s"))
    mean = cycle.groupBy(*keys).agg(F.avg("_s").alias("_c"))
    found = rows.join(cycle, [*keys, "_moy"]).join(mean, keys).withColumn("seasonal", F.col("_s") - F.col("_c"))
    return found.withColumn("rest", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_moy", "_d", "_s", "_c")


def amplitude(cycle: DataFrame, keys: list[str], month: str, mean: str) -> DataFrame:
    """keys, peak (the first month of the highest mean), amplitude."""
    return cycle.groupBy(*keys).agg(F.max_by(month, F.struct(F.col(mean), -F.col(month))).alias("peak"), (F.max(mean) - F.min(mean)).alias("amplitude"))


def months_apart(a: Column, b: Column) -> Column:
    """Between two calendar months, the shorter way round the year."""
    d = F.abs(a - b)
    return F.least(d, 12 - d)


def melt_out(df: DataFrame, keys: list[str], order: str, swe: str, below: float = 10.0) -> DataFrame:
    """keys, melt_out: the first step from the (first) highest storage on with less than `below`; the number of steps if there is none.

    Steps are counted from 0 in order.
    """
    placed = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    peak = placed.groupBy(*keys).agg(F.max_by("_n", F.struct(F.col(swe), -F.col("_n"))).alias("_peak"), F.count("*").alias("_all"))
    low = placed.join(peak, keys).filter((F.col("_n") >= F.col("_peak")) & (F.col(swe) < below)).groupBy(*keys).agg(F.min("_n").alias("_out"))
    return peak.join(low, keys, "left").select(*keys, F.coalesce("_out", "_all").cast("long").alias("melt_out"))


def losses(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """How much the value fell since the last row that has one (from 0 before the first), never below 0; NULL where the value is."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(value, ignorenulls=True).over(earlier), F.lit(0.0))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(before - F.col(value), F.lit(0.0))))


def correlations(df: DataFrame, keys: list[str], a: Column, b: Column, least: int = 12) -> DataFrame:
    """keys, r, n of keys with enough complete rows that vary in both."""
    rows = df.filter(a.isNotNull() & b.isNotNull())
    found = rows.groupBy(*keys).agg(F.corr(a, b).alias("r"), F.count("*").alias("n"), F.stddev_pop(a).alias("_a"), F.stddev_pop(b).alias("_b"))
    return found.filter((F.col("n") >= least) & (F.col("_a") > 0) & (F.col("_b") > 0)).drop("_a", "_b")


def bias_corrected(df: DataFrame, keys: list[str], observed: str, modelled: str, out: str) -> DataFrame:
    """The modelled values with the mean and the spread of the observed ones of their key."""
    stats = df.groupBy(*keys).agg(
        F.avg(observed).alias("_mo"), F.avg(modelled).alias("_mm"), F.stddev_pop(observed).alias("_so"), F.stddev_pop(modelled).alias("_sm")
    )
    corrected = F.col("_mo") + (F.col(modelled) - F.col("_mm")) * (F.col("_so") / (F.col("_sm") + 1e-9))
    return df.join(stats, keys).withColumn(out, corrected).drop("_mo", "_mm", "_so", "_sm")


def flux_ratios(df: DataFrame, keys: list[str], flow: str, baseflow: str, precip: str) -> DataFrame:
    """keys, bfi (share of baseflow), runoff_ratio (flow over precipitation) of the sums."""
    sums = df.groupBy(*keys).agg(F.sum(flow).alias("_q"), F.sum(baseflow).alias("_b"), F.sum(precip).alias("_p"))
    return sums.select(*keys, (F.col("_b") / F.greatest("_q", F.lit(1e-9))).alias("bfi"), (F.col("_q") / F.greatest("_p", F.lit(1e-9))).alias("runoff_ratio"))


def lagged_fits(df: DataFrame, keys: list[str], order: str, target: str, fixed: list[str], lagged: str, max_lag: int, least: int) -> DataFrame:
    """keys, lag, n, r2, resid_std, aic, b0 (constant), b_<name>: the target on fixed and the lagged regressor, for lags of 0 to max_lag rows.

    Only complete rows count, `least` at least. One window gives every row its lagged values, one aggregate the moments of each key
    and lag about a row of the key; what is left for numpy is a small system a key and lag, many at a time. Regressors that depend
    on each other get the shortest coefficients.
    """
    names = [*fixed, lagged]
    w = Window.partitionBy(*keys).orderBy(order)
    late = df.select(*keys, F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(fixed)],
                     *[F.lag(F.col(lagged).cast("double"), k).over(w).alias(f"_l{k}") for k in range(max_lag + 1)])
    each = late.withColumn("_l", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("v")) for k in range(max_lag + 1)])))
    rows = each.select(*keys, "_l.lag", "_y", *[f"_x{i}" for i in range(len(fixed))], F.col("_l.v").alias(f"_x{len(fixed)}")).dropna(subset=["_y", *[f"_x{i}" for i in range(len(names))]])
    cols = [*[f"_x{i}" for i in range(len(names))], "_y"]
    found = rows.groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("_m"),
                                           F.array(*[F.covar_pop(a, b) for i, a in enumerate(cols) for b in cols[i:]]).alias("_s")).filter(F.col("n") >= least)
    m = len(names)
    upper = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            mean = batch.column("_m").flatten().to_numpy().reshape(-1, m + 1)
            flat = batch.column("_s").flatten().to_numpy().reshape(-1, len(upper))
            s = np.zeros((len(n), m + 1, m + 1))
            for k, (i, j) in enumerate(upper):
                s[:, i, j] = s[:, j, i] = flat[:, k]
            size = np.sqrt(np.maximum(np.einsum("kii->ki", s[:, :m, :m]), 0))
            size = np.where(size > 0, size, 1)
            b = (np.linalg.pinv(s[:, :m, :m] / size[:, :, None] / size[:, None, :], rcond=1e-12, hermitian=True) @ (s[:, :m, m] / size)[:, :, None])[:, :, 0] / size
            left = s[:, m, m] - 2 * (b * s[:, :m, m]).sum(1) + np.einsum("ki,kij,kj->k", b, s[:, :m, :m], b)
            whole, left = s[:, m, m], np.maximum(left, 0)
            left = np.where(left <= 1e-13 * whole, 0.0, left)
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.where(whole > 0, 1 - left / whole, np.where(left == 0, 1.0, 0.0))
                aic = np.where(left > 0, n * np.log(left) + 2 * (m + 1), np.inf)
            out = {c: batch.column(c) for c in [*keys, "lag", "n"]} | {"r2": r2, "resid_std": np.sqrt(left), "aic": aic, "b0": mean[:, m] - (b * mean[:, :m]).sum(1)}
            yield pa.RecordBatch.from_pydict(out | {f"b_{c}": b[:, i] for i, c in enumerate(names)})

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return found.mapInArrow(solve, kinds + "lag int, n long, r2 double, resid_std double, aic double, b0 double, " + ", ".join(f"`b_{c}` double" for c in names))


def best_fit(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's fit of the least AIC, the shorter lag of equals."""
    rest = [c for c in fits.columns if c not in keys]
    best = fits.groupBy(*keys).agg(F.min(F.struct("aic", "lag", *[c for c in rest if c not in ("aic", "lag")])).alias("_b"))
    return best.select(*keys, *[f"_b.{c}" for c in rest])


def best_lag(fits: DataFrame, zone: str) -> DataFrame:
    """zone, lag: the lag of the least median AIC of a zone's fits, the shorter of equals."""
    median = fits.groupBy(zone, "lag").agg(F.median("aic").alias("_m"))
    return median.groupBy(zone).agg(F.min(F.struct("_m", "lag")).alias("_b")).select(zone, "_b.lag")


def reconstructed(spi: Column, swe: Column, pdo: Column, b0: Column, b_spi: Column, b_swe: Column, b_pdo: Column) -> Column:
    """The anomaly that lagged_fits()'s coefficients give for the regressors they were fitted to; NULL without an index of the month, no snow is 0."""
    return b0 + b_spi * spi + b_swe * F.coalesce(swe, F.lit(0.0)) + b_pdo * pdo


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    """bin, lower, upper, n of evenly spaced (or, with log, evenly scaled) bins; the last one holds its upper edge. Empty bins are left out."""
    a, b = (math.log10(low), math.log10(high)) if log else (low, high)
    x = F.log10(value) if log else value
    width = (b - a) / bins
    k = F.least(F.floor((x - a) / width), F.lit(bins - 1)).cast("int")
    found = df.filter((value >= low) & (value <= high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    edge = [F.lit(a) + (F.col("bin") + i) * width for i in (0, 1)]
    return found.select("bin", *[(F.pow(F.lit(10.0), e) if log else e).alias(n) for e, n in zip(edge, ("lower", "upper"))], "n")


def thinned(grid: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column."""
    return grid.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))


def drawn(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows, the same on every run: those of the smallest hashes of their keys."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).orderBy("_h", *keys).limit(n).drop("_h")


def grid_difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: n, rms, max_abs of a - b over the cells of both."""
    return difference_of(a.select("row", "col", F.col(value).alias("_a")).join(b.select("row", "col", F.col(value).alias("_b")), ["row", "col"]), "_a", "_b")


def difference_of(both: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, rms, max_abs of the column a less the column b."""
    d = F.col(a) - F.col(b)
    return both.agg(F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_abs"))


def checkerboard(x: Column, y: Column, wavelength: float) -> Column:
    k = 2 * math.pi / wavelength
    return F.sin(k * x) * F.sin(k * y)


def effective_support(weights: DataFrame, keys: list[str], w: str = "w", lost: float = 1e-12) -> DataFrame:
    """The largest weights of each key that hold all but a share `lost` of the absolute sum."""
    size = F.abs(F.col(w))
    order = Window.partitionBy(*keys).orderBy(size.desc(), *[c for c in weights.columns if c not in [*keys, w]])
    total = weights.groupBy(*keys).agg(F.sum(size).alias("_t"))
    placed = weights.withColumn("_upto", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(total, keys)
    return placed.filter((F.col("_t") > 0) & (F.col("_upto") - size < (1 - lost) * F.col("_t"))).drop("_upto", "_t")

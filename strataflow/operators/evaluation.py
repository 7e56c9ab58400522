"""Evaluation reports: errors by fold and domain, gates, interval coverage, uncertainty budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.core import clip
from strataflow.operators.spatial import near_pairs

#: Central interval levels and their standard normal half-widths.
LEVELS = {"50": 0.6744897501960817, "80": 1.2815515655446004, "90": 1.6448536269514722, "95": 1.959963984540054}
#: What each gated domain must reach.
GATES = {"valley_fill": (0.75, 1.5, 0.25), "basin": (1.5, 2.5, 0.5), "coastal": (1.0, 2.0, 0.3)}


def errors(df: DataFrame, keys: list[str], y: Column, mu: Column) -> DataFrame:
    """n, rmse, mae, bias, r2 of predictions mu of y, over the rows that have both; a key without any has n = 0 and NULLs."""
    y, mu = F.when(mu.isNotNull(), y), F.when(y.isNotNull(), mu)
    e = mu - y
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"),
    )


def gate_status(report: DataFrame, domain: str, least: int = 20) -> DataFrame:
    """report with status (pass, FAIL, unvalidated, report_only) and meets_target; too few points fail a gated domain."""
    status, target = F.lit("report_only"), F.lit(False)
    for name, (goal, limit, bias) in GATES.items():
        ok = (F.col("rmse") <= limit) & (F.abs("bias") <= bias)
        here = F.col(domain) == name
        status = F.when(here, F.when(F.col("n") < least, "unvalidated").when(ok, "pass").otherwise("FAIL")).otherwise(status)
        target = F.when(here, (F.col("n") >= least) & ok & (F.col("rmse") <= goal)).otherwise(target)
    return report.withColumn("status", status).withColumn("meets_target", target)


def interval_coverage(df: DataFrame, keys: list[str], y: Column, mu: Column, sigma: Column) -> DataFrame:
    """n and the share of y within the central intervals of N(mu, sigma), over the rows that have all three."""
    z = F.when(sigma.isNotNull(), F.abs((y - mu) / F.greatest(sigma, F.lit(1e-9))))
    return df.groupBy(*keys).agg(F.count(z).alias("n"), *[F.avg((z <= q).cast("double")).alias(f"cov{k}") for k, q in LEVELS.items()])


def quadrature(df: DataFrame, keys: list[str], sigma: str) -> DataFrame:
    """Root of the sum of squares of a cell's components; NULL if all are."""
    s = F.col(sigma)
    return df.groupBy(*keys).agg(F.when(F.count(s) > 0, F.sqrt(F.sum(s * s))).alias("sigma_total"))


def fractions(df: DataFrame, component: str, sigma: str) -> DataFrame:
    """component, fraction: each component's mean variance as a share of all; the table has a row for each."""
    s = F.col(sigma)
    means = df.groupBy(component).agg(F.avg(s * s).alias("_v"))
    total = means.agg(F.sum("_v").alias("_t"))  # one row
    return means.join(F.broadcast(total)).select(component, (F.col("_v") / F.when(F.col("_t") > 0, F.col("_t")).otherwise(1.0)).alias("fraction"))


def provenance(spark: SparkSession, steps: list[tuple[str, str, float, float, str]]) -> DataFrame:
    """What each quantity came from: quantity, source, source_res_m, target_res_m, method."""
    return spark.createDataFrame(steps, "quantity string, source string, source_res_m double, target_res_m double, method string")


def ensemble(df: DataFrame, keys: list[str], time: str, member: str, value: str) -> DataFrame:
    """keys, mean over the members' common times and sigma: the mean over time of the spread between members."""
    members = df.select(member).distinct().count()
    at = df.groupBy(*keys, time).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count_distinct(member).alias("_n")).filter(F.col("_n") == members)
    return at.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.avg("_s").alias("sigma"))


def seasonal_high(df: DataFrame, keys: list[str], depth: str, quantile: float = 0.1) -> DataFrame:
    """keys, depth at a low quantile over time: how near the surface the water table seasonally comes."""
    return df.groupBy(*keys).agg(F.percentile(depth, F.lit(quantile)).alias(depth))


def top_layer_mean(df: DataFrame, keys: list[str], depth: str, value: str, top: float = 0.03) -> DataFrame:
    """Mean over the samples down to `top`, or of the uppermost if none is that shallow."""
    first = df.groupBy(*keys).agg(F.min(depth).alias("_d"))
    inside = (F.col(depth) <= top) | ((F.col("_d") > top) & (F.col(depth) <= F.col("_d") + 1e-9))
    return df.join(first, keys).filter(inside).groupBy(*keys).agg(F.avg(value).alias(value))


def leave_one_out_anchor(stations: DataFrame, observed: str, modelled: str, length: float, reach_lengths: float = 8.0) -> DataFrame:
    """One row: bias and rmse of the model at stations(pid, px, py), before and after the distance-weighted residuals of the others are added.

    Stations beyond reach_lengths lengths (weight under 1e-13) count nothing.
    """
    others = stations.select(F.col("pid").alias("_q"), "px", "py", (F.col(observed) - F.col(modelled)).alias("_r"))
    own = stations.select("pid", F.col("px").alias("x"), F.col("py").alias("y"))
    w = F.exp(-F.col("d") * F.col("d") / (2 * length * length))
    pulled = near_pairs(own, others, length * reach_lengths).filter("pid <> _q").groupBy("pid").agg((F.sum(w * F.col("_r")) / F.greatest(F.sum(w), F.lit(1e-9))).alias("_a"))
    e0 = F.col(modelled) - F.col(observed)
    e1 = e0 + F.coalesce(F.col("_a"), F.lit(0.0))
    return stations.join(pulled, "pid", "left").agg(
        F.avg(e0).alias("bias_model"), F.sqrt(F.avg(e0 * e0)).alias("rmse_model"), F.avg(e1).alias("bias_anchored"), F.sqrt(F.avg(e1 * e1)).alias("rmse_anchored")
    )


def prior_residuals(df: DataFrame, level: Column, surface: Column, prior_depth: Column) -> DataFrame:
    """df with the prior level (surface less prior depth) and the residual of the observed one."""
    return df.withColumn("prior_level", surface - prior_depth).withColumn("residual", level - F.col("prior_level"))


def assembled(df: DataFrame, prior_level: Column, kriged_residual: Column, surface: Column, supported: Column) -> DataFrame:
    """df with level (prior plus residual), depth and negative_depth; all missing where no well is near."""
    level = F.when(F.coalesce(supported, F.lit(False)), prior_level + kriged_residual)
    return df.withColumn("level", level).withColumn("depth", surface - F.col("level")).withColumn("negative_depth", F.col("depth") < 0)


def confidence(distance: Column, reference: Column) -> Column:
    """1 / (1 + (distance / reference)^2): how far a cell is from what a model has seen."""
    return 1 / (1 + F.pow(distance / F.greatest(reference, F.lit(1e-6)), 2))


def blended(predicted: Column, prior: Column, trust: Column, low: float = 0.5, high: float = 120.0) -> Column:
    """The prediction weighted by its confidence, the prior (held in [low, high]) by the rest; the prior alone where there is none."""
    p = clip(prior, low, high)
    c = F.coalesce(trust, F.lit(0.0))
    return F.when(predicted.isNotNull(), c * predicted + (1 - c) * p).otherwise(p)


def same_covariances(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row, worst: the largest difference of two tables (i, j, cov), which must hold the same pairs; beyond the tolerance the query ends."""
    both = a.select("i", "j", F.col("cov").alias("_a")).join(b.select("i", "j", F.col("cov").alias("_b")), ["i", "j"], "full_outer")
    found = both.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("worst"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("_alone"))
    bad = (F.col("_alone") > 0) | (F.col("worst") > tolerance)
    return found.select(F.when(bad, F.raise_error(F.concat(F.lit("covariances differ by "), F.coalesce(F.col("worst").cast("string"), F.lit("their pairs")))).cast("double")).otherwise(F.col("worst")).alias("worst"))

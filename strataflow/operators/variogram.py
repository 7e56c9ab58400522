"""Variograms: binned pairs, the range at which they level off, fitted exponential models, normal scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.normal import norm_ppf
from strataflow.operators.spatial import near_pairs, semivariogram

#: Block sizes in metres: without enough points, and the least and the most that a range may give.
DEFAULT_BLOCK, LEAST_BLOCK, MOST_BLOCK = 10_000.0, 2_000.0, 50_000.0


def levels_off_at(bins: DataFrame, reach: float, lags: int, share: float = 0.95, least: float = LEAST_BLOCK, most: float = MOST_BLOCK, default: float = DEFAULT_BLOCK) -> DataFrame:
    """One row, range: the centre of the first of semivariogram()'s bins that reaches a share of the highest one.

    The default where fewer than three bins have pairs or none is above 0. There is a row per lag, so one task may look at all.
    """
    width = reach / lags
    top = bins.agg(F.max("gamma").alias("sill"), F.count("gamma").alias("n_bins"))
    first = bins.join(F.broadcast(top)).filter(F.col("gamma") >= share * F.col("sill")).agg(
        F.min((F.col("lag") + 0.5) * width).alias("at"), F.max("sill").alias("sill"), F.max("n_bins").alias("n_bins")
    )
    ok = (F.col("n_bins") >= 3) & (F.col("sill") > 0)
    return first.select(F.when(ok, F.least(F.greatest("at", F.lit(least)), F.lit(most))).otherwise(F.lit(default)).alias("range"))


def variogram_range(points: DataFrame, value: str, reach: float, lags: int = 15, least: float = LEAST_BLOCK, most: float = MOST_BLOCK, default: float = DEFAULT_BLOCK) -> DataFrame:
    return levels_off_at(semivariogram(points, value, reach, lags), reach, lags, least=least, most=most, default=default)


def pair_reach(points: DataFrame, reach: float, share: float = 0.9) -> DataFrame:
    """One row, reach: the distance below which that share of the pairs within `reach` lie."""
    other = points.select(F.col("pid").alias("qid"), F.col("px").alias("x"), F.col("py").alias("y"))
    pairs = near_pairs(other, points, reach).filter("pid < qid")
    return pairs.agg(F.percentile_approx("d", share, 10_000).alias("reach"))


def fit_exponential(bins: list[tuple[float, float, int]], max_range: float) -> tuple[float, float, float]:
    """nugget, sill (without the nugget) and range of gamma(h) = nugget + sill (1 - exp(-3 h / range)) by weighted least squares.

    bins are (distance, gamma, pairs), as many as there are lags. Ranges are tried on a fine scale; for each, nugget and
    sill are a linear fit held at 0 or above.
    """
    h, g, n = (np.array(c, float) for c in zip(*bins))
    w = np.sqrt(n)
    best = None
    for r in np.geomspace(max_range / 200, max_range * 2, 400):
        basis = 1 - np.exp(-3 * h / r)
        a = np.stack([w, w * basis], 1)
        fits = [np.linalg.lstsq(a, w * g, rcond=None)[0]]
        fits += [np.array([0.0, max(0.0, (a[:, 1] @ (w * g)) / max(a[:, 1] @ a[:, 1], 1e-300))]), np.array([max(0.0, (w * w * g).sum() / (w * w).sum()), 0.0])]
        for c in fits:
            if (c >= -1e-12).all():
                loss = float(((a @ c - w * g) ** 2).sum())
                if best is None or loss < best[0] - 1e-15:
                    best = loss, float(max(c[0], 0)), float(max(c[1], 0)), float(r)
    return best[1], best[2], best[3]


def fit_variogram(points: DataFrame, value: str, reach: float, lags: int = 70) -> tuple[float, float, float]:
    """fit_exponential() of the points' bins; the driver sees one row a lag."""
    bins = semivariogram(points, value, reach, lags).filter("gamma is not null").collect()
    if len(bins) < 3:
        var = points.agg(F.var_pop(value)).first()[0] or 0.0
        return 0.0, float(var), 0.3 * reach
    width = reach / lags
    return fit_exponential([((b["lag"] + 0.5) * width, b["gamma"], b["n"]) for b in bins], reach)


def normal_scores(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The normal quantile of (average rank - 1) / (n - 1), held at those of 1e-7; NULL for a key's single value."""
    order = Window.partitionBy(*keys).orderBy(value)
    known = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    upto = F.sum("_ties").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = known.withColumn("_rank", F.coalesce(upto, F.lit(0)) + (F.col("_ties") - 1) / 2).withColumn("_n", F.sum("_ties").over(Window.partitionBy(*keys)))
    p = F.when(F.col("_n") > 1, F.greatest(F.least(F.col("_rank") / (F.col("_n") - 1), F.lit(1 - 1e-7)), F.lit(1e-7)))
    scores = ranked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_value"), norm_ppf(p).alias(out))
    same = [df[k].eqNullSafe(scores[f"_{k}"]) for k in keys] + [df[value] == scores["_value"]]
    return df.join(scores, reduce(lambda a, b: a & b, same), "left").drop("_value", *[f"_{k}" for k in keys])


def back_transform(score: Column, knots: list[tuple[float, float]]) -> Column:
    """The value at a normal score, linear between knots (score, value) in ascending order, the end values beyond."""
    out = F.when(score <= knots[0][0], F.lit(knots[0][1]))
    for (a, u), (b, v) in zip(knots, knots[1:]):
        out = out.when(score <= b, u + (score - a) * ((v - u) / (b - a) if b > a else 0.0))
    return F.when(score.isNotNull(), out.otherwise(F.lit(knots[-1][1])))

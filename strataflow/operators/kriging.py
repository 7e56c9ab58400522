"""Kriging with external drift and with a covariate, in blocks of cells with a halo of stations.

A task holds one block of cells and the stations within reach of it, so neither a region's cells nor a continent's stations
come together; a block's system is factored once for all its cells. With a reach beyond the region the result is that of
one dense system. Stations at one place count as their mean.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.geostat import exponential


def with_halo(cells: DataFrame, obs: DataFrame, keys: list[str], reach: float, block: float):
    """The cogroup of blocks of cells(keys, x, y) with the obs(keys, px, py) within reach of the block."""
    placed = cells.withColumn("_bx", F.floor(F.col("x") / block)).withColumn("_by", F.floor(F.col("y") / block))

    def ahead(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - reach) / block), F.floor((F.col(c) + reach) / block))

    blocks = placed.select(*keys, "_bx", "_by").distinct()
    near = obs.filter(F.col("px").isNotNull() & F.col("py").isNotNull())
    if reach / block < 64:
        sent = near.withColumn("_bx", F.explode(ahead("px"))).withColumn("_by", F.explode(ahead("py"))).join(blocks, [*keys, "_bx", "_by"], "left_semi")
    else:  # the reach is beyond most blocks: go by the blocks that there are
        sent = near.join(blocks, keys).filter(F.col("_bx").between(F.floor((F.col("px") - reach) / block), F.floor((F.col("px") + reach) / block)) & F.col("_by").between(F.floor((F.col("py") - reach) / block), F.floor((F.col("py") + reach) / block)))
    sent = sent.select(*[F.col(c).alias(c) for c in [*obs.columns, "_bx", "_by"]])
    full = [*keys, "_bx", "_by"]
    return sent.alias("o").groupBy(*[F.col(f"o.{k}") for k in full]).cogroup(placed.alias("c").groupBy(*[F.col(f"c.{k}") for k in full]))


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _distance(o: pd.DataFrame, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.hypot(o["px"].to_numpy()[:, None] - x[None], o["py"].to_numpy()[:, None] - y[None])


def _empty(keys: list[str], *names: str) -> pd.DataFrame:
    return pd.DataFrame({c: [] for c in [*keys, "cell", *names]})


def drift_krige(
    obs: DataFrame, cells: DataFrame, keys: list[str], value: str, drift: list[str], model: tuple[float, float, float], reach: float, block: float, least: int = 8
) -> DataFrame:
    """keys, cell, estimate, sd: obs(keys, px, py, value, drift) kriged to cells(keys, cell, x, y, drift) with the drift columns as external drift.

    The value is a linear function of the drift columns, with coefficients that each block finds for itself, plus a field with the exponential
    semivariogram model (nugget, sill, range). Rows with a null value or drift do not count; a block with fewer than `least`
    stations, or fewer than it has coefficients, gives no rows. Without drift this is ordinary kriging.
    """

    def solve(key: tuple, o: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        o = o.dropna(subset=[value, *drift]).groupby(["px", "py"], as_index=False)[[value, *drift]].mean()
        c = c.dropna(subset=["x", "y", *drift])
        n, p = len(o), 1 + len(drift)
        if n < max(least, p + 1) or c.empty:
            return _empty(keys, "estimate", "sd")
        x, y = c["x"].to_numpy(float), c["y"].to_numpy(float)
        centre, spread = o[drift].mean().to_numpy(float), np.maximum(o[drift].std(ddof=0).to_numpy(float), 1e-12)
        f_obs = np.column_stack([np.ones(n), (o[drift].to_numpy(float) - centre) / spread])
        f_cell = np.column_stack([np.ones(len(c)), (c[drift].to_numpy(float) - centre) / spread])
        a = np.zeros((n + p, n + p))
        a[:n, :n] = exponential(_distance(o, o["px"].to_numpy(), o["py"].to_numpy()), *model)
        a[:n, n:], a[n:, :n] = f_obs, f_obs.T
        b = np.vstack([exponential(_distance(o, x, y), *model), f_cell.T])
        try:
            w = np.linalg.solve(a, b)
        except np.linalg.LinAlgError:  # a drift that is constant over the block's stations
            w = np.linalg.lstsq(a, b, rcond=None)[0]
        found = {"cell": c["cell"].to_numpy(), "estimate": w[:n].T @ o[value].to_numpy(float), "sd": np.sqrt(np.maximum((w * b).sum(0), 0))}
        return pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, **found})

    used = obs.select(*keys, "px", "py", value, *drift), cells.select(*keys, "cell", "x", "y", *drift)
    return with_halo(used[1], used[0], keys, reach, block).applyInPandas(solve, _kinds(obs, keys) + "cell long, estimate double, sd double")


def cokrige(
    obs: DataFrame, cells: DataFrame, keys: list[str], score: str, covariate: str, rho: str | float, nugget: float, reach_of_model: float, reach: float, block: float, least: int = 3
) -> DataFrame:
    """keys, cell, estimate, sd of simple collocated co-kriging: obs(keys, px, py, score) and the covariate at each of cells(keys, cell, x, y, covariate).

    Both variables are normal scores (mean 0, variance 1); they covary as rho times the score's own correlation (the first Markov
    model of coregionalisation), whose model is exponential with a nugget share and a range. rho is a number or a column of cells that is
    the same within a block (a region's). Cells without a covariate are kriged without it; a block with fewer than `least` stations gives no rows.
    """

    def solve(key: tuple, o: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        o = o.dropna(subset=[score]).groupby(["px", "py"], as_index=False)[score].mean()
        c = c.dropna(subset=["x", "y"])
        if len(o) < least or c.empty:
            return _empty(keys, "estimate", "sd")
        like = lambda d: np.where(d > 0, (1 - nugget) * np.exp(-3 * d / reach_of_model), 1.0)
        cross = like(_distance(o, c["x"].to_numpy(float), c["y"].to_numpy(float)))
        own = like(_distance(o, o["px"].to_numpy(), o["py"].to_numpy()))
        w = np.linalg.solve(own, cross)
        known, z, seen = (cross * w).sum(0), o[score].to_numpy(float), c[covariate].notna().to_numpy()
        r = np.where(seen, c["_rho"].to_numpy(float), 0.0)
        # The covariate's weight comes from the last row of the system, the stations' shrink by what it tells.
        extra = r * (1 - known) / np.maximum(1 - r * r * known, 1e-12)
        shrink = 1 - r * extra
        estimate = shrink * (z @ w) + extra * np.where(seen, c[covariate].fillna(0.0).to_numpy(float), 0.0)
        sd = np.sqrt(np.clip(1 - shrink * known - r * extra, 0, 1))
        return pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, "cell": c["cell"].to_numpy(), "estimate": estimate, "sd": sd})

    share = F.col(rho).cast("double") if isinstance(rho, str) else F.lit(float(rho))
    used = obs.select(*keys, "px", "py", score), cells.select(*keys, "cell", "x", "y", covariate, share.alias("_rho"))
    return with_halo(used[1], used[0], keys, reach, block).applyInPandas(solve, _kinds(obs, keys) + "cell long, estimate double, sd double")


def score_knots(df: DataFrame, keys: list[str], value: str, knots: int = 101) -> DataFrame:
    """keys, scores, levels: the values at evenly spaced shares of each key's distribution, and the normal scores of these shares."""
    shares = [i / (knots - 1) for i in range(knots)]
    scores = F.array(*[F.lit(NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7))) for p in shares])
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p) for p in shares])).alias("levels")).select(*keys, scores.alias("scores"), "levels")


def from_score(score: Column, scores: Column, levels: Column) -> Column:
    """The value at a normal score, linear between knots, the end values beyond."""
    last = F.size(scores) - 1
    i = F.least(F.greatest(F.size(F.filter(scores, lambda s: s <= score)) - 1, F.lit(0)), last - 1)
    a, b, u, v = F.get(scores, i), F.get(scores, i + 1), F.get(levels, i), F.get(levels, i + 1)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - a) / F.when(b > a, b - a).otherwise(1.0)))
    return F.when(score.isNotNull(), u + (v - u) * t)


def back_transformed(kriged: DataFrame, knots: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cell, mean, spread of cokrige()'s rows in the value's own unit; the spread is half of what lies between score - sd and score + sd."""
    at = lambda s: from_score(s, F.col("scores"), F.col("levels"))
    spread = (at(F.col("estimate") + F.col("sd")) - at(F.col("estimate") - F.col("sd"))) / 2
    return kriged.join(knots, keys).select(*keys, "cell", at(F.col("estimate")).alias("mean"), spread.alias("spread"))

"""Kriging and linear-Gaussian updates: small dense solves in numpy inside grouped Arrow tasks.

A group is one month (or one block of cells); its stations are few, its cells come in blocks, so a task's matrices are
stations x stations and stations x block. Groups with too few stations give no rows, and say so by their absence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exponential(d: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """Semivariance of the exponential model."""
    return np.where(d > 0, nugget + (sill - nugget) * (1 - np.exp(-3 * d / reach)), 0.0)


def krige_block(px: np.ndarray, py: np.ndarray, v: np.ndarray, gx: np.ndarray, gy: np.ndarray, model: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging: estimate and standard deviation at each target."""
    n = len(px)
    a = np.ones((n + 1, n + 1))
    a[n, n] = 0
    a[:n, :n] = exponential(np.hypot(px[:, None] - px, py[:, None] - py), *model)
    b = np.ones((n + 1, len(gx)))
    b[:n] = exponential(np.hypot(px[:, None] - gx, py[:, None] - gy), *model)
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    return w[:n].T @ v, np.sqrt(np.maximum((w * b).sum(0), 0))


#: Side of a block of cells, in the cells' own unit.
BLOCK = 64.0


def by_block(cells: DataFrame, obs: DataFrame, keys: list[str], block: float):
    """The cogroup of blocks of cells(keys, x, y) with all of their key's obs: what a task holds is bounded by a block and a network."""
    placed = cells.withColumn("_bx", F.floor(F.col("x") / block)).withColumn("_by", F.floor(F.col("y") / block))
    blocks = placed.select(*keys, "_bx", "_by").distinct()
    known = obs.select(*[F.col(c).alias(c) for c in obs.columns])
    full = [*keys, "_bx", "_by"]
    sent = known.join(blocks, keys).select(*[F.col(c).alias(c) for c in [*obs.columns, "_bx", "_by"]])
    return sent.alias("o").groupBy(*[F.col(f"o.{k}") for k in full]).cogroup(placed.alias("c").groupBy(*[F.col(f"c.{k}") for k in full]))


def krige_groups(obs: DataFrame, cells: DataFrame, keys: list[str], value: str, model: tuple[float, float, float], least: int = 8, block: float = BLOCK) -> DataFrame:
    """keys, cell, estimate, sd: obs(keys, px, py, value) kriged to cells(keys, cell, x, y), group by group, in blocks of cells.

    Observations at one place count as their mean.
    """

    def solve(key: tuple, o: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        o = o.dropna(subset=[value, "px", "py"]).groupby(["px", "py"], as_index=False)[value].mean()
        if len(o) < least or c.empty:
            return pd.DataFrame({**{k: [] for k in keys}, "cell": [], "estimate": [], "sd": []})
        z, s = krige_block(o["px"].to_numpy(), o["py"].to_numpy(), o[value].to_numpy(), c["x"].to_numpy(), c["y"].to_numpy(), model)
        return pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, "cell": c["cell"].to_numpy(), "estimate": z, "sd": s})

    kinds = {f.name: f.dataType.simpleString() for f in obs.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "cell long", "estimate double", "sd double"])
    return by_block(cells, obs, keys, block).applyInPandas(solve, schema)


def matern32(d: np.ndarray, sigma: float, length: float) -> np.ndarray:
    x = np.sqrt(3) * d / length
    return sigma**2 * (1 + x) * np.exp(-x)


def blue(cx: np.ndarray, cy: np.ndarray, px: np.ndarray, py: np.ndarray, v: np.ndarray, noise: np.ndarray, sigma: float, length: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Best linear unbiased update of a zero-mean Matern-3/2 field by point data: mean, variance reduction, degrees of freedom for signal."""
    cross = matern32(np.hypot(cx[:, None] - px, cy[:, None] - py), sigma, length)
    prior = matern32(np.hypot(px[:, None] - px, py[:, None] - py), sigma, length)
    whole = prior + np.diag(noise**2)
    weights = np.linalg.solve(whole, np.column_stack([v, cross.T, prior]))
    per_cell = weights[:, 1 : 1 + len(cx)].T
    return cross @ weights[:, 0], np.clip((per_cell * cross).sum(1), 0, sigma**2), float(np.trace(weights[:, 1 + len(cx) :]))


def blue_groups(obs: DataFrame, cells: DataFrame, keys: list[str], value: str, noise: str, sigma: float, length: float, block: float = BLOCK) -> DataFrame:
    """keys, cell, mean, reduction, dfs, group by group, in blocks of cells.

    Observations at one place are one: their mean weighted by 1 / noise^2, with the noise of that mean, gives the same update.
    Ones without noise go before the others at their place. A task's matrices are of a group's different places.
    """
    sure = F.max(F.col(noise) == 0).over(Window.partitionBy(*keys, "px", "py"))
    weight = F.when(F.col("_sure"), 1.0).otherwise(1 / F.col("_s2"))
    given = obs.filter(F.col(value).isNotNull()).withColumn("_sure", sure).filter(~F.coalesce("_sure", F.lit(False)) | (F.col(noise) == 0))
    given = given.select(*keys, "px", "py", "_sure", F.col(value).cast("double").alias("_v"), (F.col(noise).cast("double") * F.col(noise).cast("double")).alias("_s2"))
    sums = given.groupBy(*keys, "px", "py").agg(F.first("_sure").alias("_sure"), F.sum(weight).alias("_w"), F.sum(weight * F.col("_v")).alias("_wv"), F.count("*").alias("_n"), F.first("_v").alias("_v"), F.first("_s2").alias("_s2"))
    alone = F.col("_n") == 1
    merged_value, merged_noise = F.when(alone, F.col("_v")).otherwise(F.col("_wv") / F.col("_w")), F.when(F.col("_sure"), 0.0).when(alone, F.sqrt("_s2")).otherwise(F.sqrt(1 / F.col("_w")))
    places = sums.select(*keys, "px", "py", merged_value.alias(value), merged_noise.alias(noise))

    def solve(key: tuple, o: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        o = o.dropna(subset=[value])
        if o.empty or c.empty:
            return pd.DataFrame({**{k: [] for k in keys}, "cell": [], "mean": [], "reduction": [], "dfs": []})
        m, r, f = blue(*(c[k].to_numpy() for k in "xy"), *(o[k].to_numpy() for k in ("px", "py", value, noise)), sigma, length)
        return pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, "cell": c["cell"].to_numpy(), "mean": m, "reduction": r, "dfs": f})

    kinds = {f.name: f.dataType.simpleString() for f in obs.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "cell long", "mean double", "reduction double", "dfs double"])
    return by_block(cells, places, keys, block).applyInPandas(solve, schema)

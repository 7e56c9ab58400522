"""Observing a field with a Matern prior: footprints as weights of cells, what observations resolve, and fitted priors.

Footprints are tables (obs, cell, w). The dense solves take one group to a task as Arrow frames: the fits are of the size of its
points, which a network bounds; resolution_groups() is of cells x cells and for small groups, gridprior.grid_resolution()
gives the same on rasters without it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators.spatial import near_pairs
from strataflow.session import spread

#: What a well may observe, and the one kind that observes the water table.
TARGETS, WATER_TABLE = ("water_table", "aquifer_head", "unknown"), "water_table"
JITTER = 1e-8


def point_footprints(cells: DataFrame, points: DataFrame, width: float = 0.5, reach_widths: float = 8.0) -> DataFrame:
    """pid, cell, w: a normal bell about each of points(pid, px, py) over cells(cell, x, y), summing to 1.

    Cells beyond reach_widths widths (weight under 1e-13) have none; a point without any cell within reach gets none.
    """
    pairs = near_pairs(cells, points, width * reach_widths).withColumn("_g", F.exp(-F.col("d") * F.col("d") / (2 * width * width)))
    total = pairs.groupBy("pid").agg(F.sum("_g").alias("_t"))
    return pairs.join(total, "pid").select("pid", "cell", (F.col("_g") / F.col("_t")).alias("w"))


def water_table_footprints(cells: DataFrame, wells: DataFrame, target: str = "measurement_target", width: float = 0.5) -> DataFrame:
    """point_footprints() of wells that observe the water table; any other kind ends the query."""
    ok = F.when(F.col(target) == WATER_TABLE, F.col("pid")).otherwise(
        F.raise_error(F.concat(F.lit("not a water-table observation: "), F.coalesce(F.col(target), F.lit("NULL")))).cast("long")
    )
    return point_footprints(cells, wells.withColumn("pid", ok), width)


def normalised(weights: DataFrame, keys: list[str], w: str = "w") -> DataFrame:
    """weights divided by the sum of their key; 0 where that is not above 0, missing ones too."""
    total = weights.groupBy(*keys).agg(F.sum(w).alias("_t"))
    return weights.join(total, keys).withColumn(w, F.when(F.col("_t") > 0, F.coalesce(F.col(w) / F.col("_t"), F.lit(0.0))).otherwise(0.0)).drop("_t")


def pixel_footprints(cells: DataFrame, pixel: float, land: str | None = None) -> DataFrame:
    """pixel_x, pixel_y, cell, w: the mean of the (land) cells of each square pixel, counted from the least x and y."""
    if not (math.isfinite(pixel) and pixel > 0):
        raise ValueError(f"pixel must be positive and finite, not {pixel!r}")
    corner = cells.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))  # one row
    dealt = cells.join(F.broadcast(corner)).select(
        "*", F.floor((F.col("x") - F.col("_x0")) / pixel).alias("pixel_x"), F.floor((F.col("y") - F.col("_y0")) / pixel).alias("pixel_y")
    )
    kept = dealt if land is None else dealt.filter(F.col(land))
    sizes = kept.groupBy("pixel_x", "pixel_y").agg(F.count("*").alias("_n"))
    return kept.join(sizes, ["pixel_x", "pixel_y"]).select("pixel_x", "pixel_y", "cell", (1 / F.col("_n")).alias("w"))


def channel_footprints(cells: DataFrame, hand: str = "hand", land: str = "land", hand_max: float = 2.0, width: float = 0.5) -> DataFrame:
    """point_footprints() of the land cells at most hand_max above their drainage; pid is the channel cell."""
    channel = cells.filter(F.col(land) & (F.col(hand) <= hand_max)).select(F.col("cell").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    return point_footprints(cells.select("cell", "x", "y"), channel, width)


# -- dense algebra of one group


def matern(d: np.ndarray, length: float, nu: float) -> np.ndarray:
    """Matern correlation for the smoothnesses 1/2, 3/2 and 5/2, and the squared exponential for infinity."""
    if nu == math.inf:
        return np.exp(-0.5 * (d / length) ** 2)
    x = math.sqrt(2 * nu) * d / length
    poly = {0.5: lambda: 1.0, 1.5: lambda: 1 + x, 2.5: lambda: 1 + x + x * x / 3}
    if nu not in poly:
        raise ValueError("smoothness must be 0.5, 1.5, 2.5 or infinite")
    return poly[nu]() * np.exp(-x)


def covariance(xy: np.ndarray, other: np.ndarray, sigma: float, length: float, nu: float = 1.5) -> np.ndarray:
    return sigma**2 * matern(np.hypot(xy[:, None, 0] - other[None, :, 0], xy[:, None, 1] - other[None, :, 1]), length, nu)


def averaging_kernel(prior: np.ndarray, g: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """C G' (G C G' + N)^-1 G: what the estimate at each cell is an average of."""
    cg = prior @ g.T
    return cg @ np.linalg.solve(g @ cg + np.diag(noise), g)


def resolved(prior: np.ndarray, g: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The share of each cell's prior variance that the observations remove."""
    if not len(g):
        return np.zeros(len(prior))
    cg = prior @ g.T
    factor = np.linalg.cholesky(g @ cg + np.diag(noise))
    half = np.linalg.solve(factor, cg.T)
    return np.clip((half * half).sum(0) / np.diag(prior), 0, 1)


def added_resolution(prior: np.ndarray, base: np.ndarray, added: np.ndarray, base_noise: np.ndarray, added_noise: np.ndarray) -> np.ndarray:
    both = np.vstack([base, added]) if len(base) else added
    return np.clip(resolved(prior, both, np.r_[base_noise, added_noise]) - resolved(prior, base, base_noise), 0, 1)


def resolution_width(kernel: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Root mean square distance of each row's absolute weights; NaN where there are none."""
    w = np.abs(kernel)
    d2 = ((xy[None] - xy[:, None]) ** 2).sum(-1)
    total = w.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, np.sqrt((w * d2).sum(1) / total), np.nan)


def resolution_groups(cells: DataFrame, footprints: DataFrame, keys: list[str], sigma: float, length: float, nu: float = 1.5) -> DataFrame:
    """keys, cell, resolved, width: of cells(keys, cell, x, y) under footprints(keys, obs, cell, w, noise), group by group."""

    def solve(key: tuple, c: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("cell").reset_index(drop=True)
        f = f[f["cell"].isin(c["cell"])]
        if c.empty or f.empty:
            return pd.DataFrame({**{k: [key[i]] * len(c) for i, k in enumerate(keys)}, "cell": c["cell"], "resolved": 0.0, "width": np.nan})
        obs = f["obs"].drop_duplicates().sort_values().reset_index(drop=True)
        g = np.zeros((len(obs), len(c)))
        np.add.at(g, (obs.searchsorted(f["obs"]), c["cell"].searchsorted(f["cell"])), f["w"].to_numpy())
        noise = f.groupby("obs")["noise"].first().sort_index().to_numpy(float)
        xy = c[["x", "y"]].to_numpy(float)
        prior = covariance(xy, xy, sigma, length, nu)
        return pd.DataFrame({
            **{k: [key[i]] * len(c) for i, k in enumerate(keys)}, "cell": c["cell"],
            "resolved": resolved(prior, g, noise), "width": resolution_width(averaging_kernel(prior, g, noise), xy),
        })

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "cell long", "resolved double", "width double"])
    # Both may come from one table, so one side gets columns of its own.
    feet = footprints.select(*[F.col(c).alias(c) for c in footprints.columns])
    return cells.alias("c").groupBy(*[F.col(f"c.{k}") for k in keys]).cogroup(feet.alias("f").groupBy(*[F.col(f"f.{k}") for k in keys])).applyInPandas(solve, schema)


# -- fitted priors


def reml(xy: np.ndarray, y: np.ndarray, length: float, nu: float, nugget: float) -> tuple[float, float, float]:
    """-2 log restricted likelihood, variance and mean for a length and a share of nugget; infinite where there is none."""
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    k = (1 - nugget) * matern(d, length, nu) + (nugget + JITTER) * np.eye(len(y))
    try:
        factor = np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        return math.inf, math.nan, math.nan
    u, v = (np.linalg.solve(factor, a) for a in (np.ones(len(y)), y))
    xtx, free = float(u @ u), len(y) - 1
    beta = float(u @ v) / xtx
    s2 = float(((v - beta * u) ** 2).sum()) / free
    if not (math.isfinite(s2) and s2 > 0):
        return math.inf, math.nan, math.nan
    return free * (math.log(s2) + 1 + math.log(2 * math.pi)) + 2 * float(np.log(np.diag(factor)).sum()) + math.log(xtx), s2, beta


def reml_losses(d: np.ndarray, y: np.ndarray, lengths: np.ndarray, nu: float, nuggets: np.ndarray) -> np.ndarray:
    """The first value of reml() for each length and nugget, of the distances d; their matrices are factored together.

    The factor of K with the rows 1 and y below it has the solutions for 1 and y in these rows, whatever their diagonal.
    """
    n, out = len(y), []
    low = np.tril_indices(n, -1)
    step = max(1, (1 << 20) // (n * n))
    for i in range(0, len(lengths), step):
        a, many = nuggets[i : i + step], len(nuggets[i : i + step])
        k = np.zeros((many, n + 2, n + 2))
        k[:, low[0], low[1]] = (1 - a)[:, None] * matern(d[low] / lengths[i : i + step, None], 1.0, nu)
        k[:, range(n), range(n)] = (1 - a + a + JITTER)[:, None]
        k[:, n, :n], k[:, n + 1, :n] = 1.0, y
        k[:, [n, n + 1], [n, n + 1]] = 1e200
        factor = _factors(k)
        u, v = factor[:, n, :n], factor[:, n + 1, :n]
        with np.errstate(all="ignore"):
            xtx = (u * u).sum(1)
            beta = (u * v).sum(1) / xtx
            s2 = ((v - beta[:, None] * u) ** 2).sum(1) / (n - 1)
            logs = np.log(factor[:, range(n), range(n)]).sum(1)
            loss = (n - 1) * (np.log(s2) + 1 + math.log(2 * math.pi)) + 2 * logs + np.log(xtx)
        out.append(np.where(np.isfinite(s2) & (s2 > 0) & np.isfinite(loss), loss, math.inf))
    return np.concatenate(out)


def _factors(k: np.ndarray) -> np.ndarray:
    """Cholesky factors of the matrices; NaN where there is none."""
    try:
        return np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        return np.concatenate([_factors(x[None]) for x in k]) if len(k) > 1 else np.full(k.shape, math.nan)


def _descend(f: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, step: float = 0.4, most: int = 200, tolerance: float = 1e-4) -> list[tuple[np.ndarray, float, bool]]:
    """A compass search from each start: the best of steps along each axis, halved when none is better. f takes the tries of all together."""
    here, best = starts.copy(), f(starts)
    steps, open_ = np.full(len(starts), step), np.ones(len(starts), bool)
    axes = np.array([s * e for e in np.eye(starts.shape[1]) for s in (1, -1)])
    for _ in range(most):
        live = np.flatnonzero(open_)
        if not len(live):
            break
        tries = here[live, None] + steps[live, None, None] * axes
        found = f(tries.reshape(-1, starts.shape[1])).reshape(len(live), -1)
        k = found.argmin(1)
        least = found[np.arange(len(live)), k]
        better = least < best[live] - 1e-9
        here[live[better]], best[live[better]] = tries[better, k[better]], least[better]
        steps[live[~better]] /= 2
        open_[live[~better]] = steps[live[~better]] >= tolerance
    return [(h, float(b), not o) for h, b, o in zip(here, best, open_)]


def fit_matern(xy: np.ndarray, y: np.ndarray, nu: float, lengths: tuple[float, float] = (0.5, 200.0), nuggets: tuple[float, float] = (1e-4, 0.95), starts: int = 5) -> dict[str, float]:
    """The length and share of nugget of the highest restricted likelihood, from several starts."""
    if len(y) < 10:
        raise ValueError(f"a covariance needs 10 values, not {len(y)}")

    def given(t: np.ndarray) -> tuple[float, float]:
        return float(np.clip(np.exp(t[0]), *lengths)), float(np.clip(1 / (1 + np.exp(-np.clip(t[1], -50, 50))), *nuggets))

    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])

    def losses(tries: np.ndarray) -> np.ndarray:
        # Tries at the same length and nugget are one.
        each, at = np.unique([given(t) for t in tries], axis=0, return_inverse=True)
        return reml_losses(d, y, each[:, 0], nu, each[:, 1])[at.ravel()]

    found = _descend(losses, np.array([[math.log(x), math.log(a / (1 - a))] for x in np.geomspace(2 * lengths[0], lengths[1] / 2, starts) for a in (0.1, 0.4)]))
    t, best, done = min(found, key=lambda r: r[1])
    if not math.isfinite(best):
        raise RuntimeError(f"no fit for smoothness {nu}")
    length, a = given(t)
    neg2, s2, mean = reml(xy, y, length, nu, a)
    sigma = math.sqrt((1 - a) * s2)
    kappa = math.sqrt(2 * nu) / length
    return {"nu": nu, "sigma": sigma, "length": length, "nugget": a * s2, "nugget_fraction": a, "mean": mean, "neg2_reml": neg2,
            "microergodic": sigma**2 * kappa ** (2 * nu), "n": float(len(y)), "converged": float(done)}


FIT_COLUMNS = ["nu", "sigma", "length", "nugget", "nugget_fraction", "mean", "neg2_reml", "microergodic", "n", "converged"]


def matern_groups(points: DataFrame, keys: list[str], value: str, nus: tuple[float, ...] = (0.5, 1.5, 2.5), least: int = 10) -> DataFrame:
    """keys and FIT_COLUMNS: fit_matern() for each smoothness and each group of points(keys, px, py, value) with enough of them."""

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["px", "py", value]).sort_values(["px", "py", value])
        rows = [fit_matern(frame[["px", "py"]].to_numpy(float), frame[value].to_numpy(float), nu) for nu in nus] if len(frame) >= least else []
        return pd.DataFrame([{**dict(zip(keys, key)), **r} for r in rows], columns=[*keys, *FIT_COLUMNS])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} double" for c in FIT_COLUMNS)])
    return spread(points, *keys).groupBy(*keys).applyInPandas(fit, schema)


def best_smoothness(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The fit of the highest likelihood of each group, with delta: how far -2 log likelihood of the others lies above it."""
    best = F.min("neg2_reml").over(Window.partitionBy(*keys))
    ranked = fits.withColumn("delta", F.col("neg2_reml") - best)
    return ranked.withColumn("is_best", F.row_number().over(Window.partitionBy(*keys).orderBy("neg2_reml", "nu")) == 1)


def holdout_scores(xy: np.ndarray, y: np.ndarray, sigma: float, length: float, nu: float, nugget: float, blocks: np.ndarray) -> dict[str, float]:
    """Root mean square error, mean CRPS and 90 % coverage of predicting each block of points from all others."""
    k = covariance(xy, xy, sigma, length, nu)
    errors, spreads = [], []
    for b in np.unique(blocks):
        out = blocks == b
        if out.all():
            continue
        inside = ~out
        factor = np.linalg.cholesky(k[np.ix_(inside, inside)] + (nugget + JITTER) * np.eye(int(inside.sum())))
        one, values, cross = (np.linalg.solve(factor, a) for a in (np.ones(int(inside.sum())), y[inside], k[np.ix_(inside, out)]))
        mean = float(one @ values) / float(one @ one)
        errors.append(y[out] - mean - cross.T @ (values - mean * one))
        spreads.append(np.sqrt(np.maximum(sigma**2 + nugget - (cross * cross).sum(0), 1e-12)))
    if not errors:
        return {"rmse": math.nan, "crps": math.nan, "cover90": math.nan}
    e, s = np.concatenate(errors), np.concatenate(spreads)
    z = e / s
    cdf = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    crps = s * (z * (2 * cdf - 1) + 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
    return {"rmse": float(np.sqrt((e * e).mean())), "crps": float(crps.mean()), "cover90": float((np.abs(z) <= 1.6448536269514722).mean())}

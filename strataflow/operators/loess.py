"""Seasonal decomposition by local regression (Cleveland and others 1990) of regular series, key by key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def smoother(places: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `at`: tricube weights of the nearest `window` places, and their distances from it.

    A window longer than the series widens the reach of the weights in proportion.
    """
    d = np.abs(places[None, :] - at[:, None]).astype(float)
    q = min(window, len(places))
    reach = np.sort(d, 1)[:, q - 1] + (max(window - len(places), 0) // 2)
    u = d / np.maximum(reach, 1e-12)[:, None]
    near = np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - np.minimum(u, 1) ** 3) ** 3, 0.0))
    return near, places[None, :] - at[:, None]


def loess(y: np.ndarray, weight: np.ndarray, window: int, at: np.ndarray | None = None) -> np.ndarray:
    """The local straight line through y (at 0, 1, ...) at each place; the local mean where its places do not spread."""
    places = np.arange(len(y), dtype=float)
    near, dx = smoother(places, places if at is None else at, window)
    w = near * weight[None, :]
    total = w.sum(1)
    w = np.where(total[:, None] > 0, w / np.where(total > 0, total, 1)[:, None], near / near.sum(1, keepdims=True))
    centre = (w * dx).sum(1)
    spread = (w * (dx - centre[:, None]) ** 2).sum(1)
    tilt = np.where(spread > (0.001 * (len(y) - 1)) ** 2, -centre / np.where(spread > 0, spread, 1), 0.0)
    return ((w * (1 + tilt[:, None] * (dx - centre[:, None]))) * y[None, :]).sum(1)


def _mean(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(x, np.ones(n) / n, mode="valid")


def odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + 1 - n % 2


def decomposed(y: np.ndarray, period: int = 12, seasonal: int = 7, trend: int | None = None, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal part, trend and robustness weights of a series of two periods or more."""
    n = len(y)
    trend = trend or odd(1.5 * period / (1 - 1.5 / seasonal))
    low = odd(period) if period % 2 else period + 1
    season, level, weight = np.zeros(n), np.zeros(n), np.ones(n)
    inner, outer = (2, 15) if robust else (5, 0)
    for turn in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):  # each month of the year by itself, a year further at both ends
                part, w = (y - level)[phase::period], weight[phase::period]
                cycle[phase::period] = loess(part, w, seasonal, np.arange(-1, len(part) + 1, dtype=float))
            passed = loess(_mean(_mean(_mean(cycle, period), period), 3), np.ones(n), low)
            season = cycle[period : period + n] - passed
            level = loess(y - season, weight, trend)
        if turn < outer:
            rest = np.abs(y - season - level)
            six = 6 * np.median(rest)
            u = rest / six if six > 0 else np.zeros(n)
            weight = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0)) if six > 0 else np.ones(n)
    return season, level, weight


def seasonal_trend(df: DataFrame, keys: list[str], order: str, value: str, period: int = 12, seasonal: int = 7, trend: int | None = None, robust: bool = True) -> DataFrame:
    """df's rows with seasonal, trend, rest and weight: each unbroken run of values of a key that is two periods long or more.

    df must be regular (months.regular_months()); a null value ends a run. Shorter runs and null values get NULLs. A key's
    series is one Arrow group, bounded by its time steps.
    """
    names = [c for c in df.columns if c not in ("seasonal", "trend", "rest", "weight")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        out = {c: np.full(len(frame), np.nan) for c in ("seasonal", "trend", "rest", "weight")}
        y = frame[value].to_numpy(float)
        gaps = np.flatnonzero(np.isnan(y))
        for a, b in zip(np.append(-1, gaps) + 1, np.append(gaps, len(y))):
            if b - a >= 2 * period:
                s, t, w = decomposed(y[a:b], period, seasonal, trend, robust)
                out["seasonal"][a:b], out["trend"][a:b], out["rest"][a:b], out["weight"][a:b] = s, t, y[a:b] - s - t, w
        return frame.assign(**{c: pd.array(np.where(np.isnan(v), None, v), "Float64") for c, v in out.items()})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*names).groupBy(*keys).applyInPandas(run, kinds + ", seasonal double, trend double, rest double, weight double")

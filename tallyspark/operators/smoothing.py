"""Exponential smoothing with grid search: one series per group, Arrow batches in and out.

A smoother's state at time k depends on the values up to k only, so one pass with the whole grid side
by side gives the walk-forward forecast of every k: the running squared error picks the parameters,
the state gives the forecast. Series are spread by key; a group is one resampled series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyspark.session import ship

SMOOTHERS = ("exponential_smoothing", "holt_linear_damped", "holt_winters_additive")

# Parameter grids and the damping of the trend.
LEVEL_GRID = np.round(np.arange(0.05, 1.0, 0.05), 2)
HOLT_ALPHA = np.round(np.arange(0.1, 1.0, 0.1), 2)
HOLT_BETA = np.round(np.arange(0.05, 0.55, 0.05), 2)
SEASON_ALPHA = np.round(np.arange(0.1, 0.9, 0.1), 2)
SEASON_BETA = np.round(np.arange(0.05, 0.45, 0.1), 2)
SEASON_GAMMA = np.round(np.arange(0.05, 0.45, 0.1), 2)
DAMPING = 0.9


def _grid(*axes: np.ndarray) -> list[np.ndarray]:
    return [g.ravel() for g in np.meshgrid(*axes, indexing="ij")]


class _Track:
    """One-step forecasts of all grid points and the running squared error."""

    def __init__(self, n: int, width: int) -> None:
        self.fits = np.empty((n, width))
        self.sse = np.zeros(width)
        self.ahead = np.full(n + 1, np.nan)

    def see(self, i: int, forecast: np.ndarray, value: float) -> None:
        self.fits[i] = forecast
        self.sse += (value - forecast) ** 2

    @property
    def best(self) -> int:
        return int(np.argmin(self.sse))


def level_smoothing(values: np.ndarray, horizon: int, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alpha = LEVEL_GRID
    track = _Track(len(values), len(alpha))
    level = np.full(len(alpha), values[0])
    for i, x in enumerate(values):
        track.see(i, level, x)
        level = alpha * x + (1 - alpha) * level
        track.ahead[i + 1] = level[track.best]
    best = track.best
    return track.ahead, track.fits[:, best], np.full(horizon, level[best])


def damped_trend(values: np.ndarray, horizon: int, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alpha, beta = _grid(HOLT_ALPHA, HOLT_BETA)
    track = _Track(len(values), len(alpha))
    level = np.full(len(alpha), values[0])
    trend = np.full(len(alpha), values[1] - values[0] if len(values) > 1 else 0.0)
    for i, x in enumerate(values):
        if i == 0:
            track.see(0, level, x)
            track.ahead[1] = x  # a history of one value has no trend yet
            continue
        forecast = level + DAMPING * trend
        track.see(i, forecast, x)
        risen = alpha * x + (1 - alpha) * forecast
        trend = beta * (risen - level) + (1 - beta) * DAMPING * trend
        level = risen
        track.ahead[i + 1] = (level + DAMPING * trend)[track.best]
    best = track.best
    weights = np.cumsum(DAMPING ** np.arange(1, horizon + 1))
    return track.ahead, track.fits[:, best], level[best] + trend[best] * weights


def _seasonal_run(values: np.ndarray, season: int, begin: int = 0) -> tuple[_Track, tuple]:
    """Additive seasonal smoothing; forecasts ahead are kept for histories of at least `begin` values."""
    alpha, beta, gamma = _grid(SEASON_ALPHA, SEASON_BETA, SEASON_GAMMA)
    track = _Track(len(values), len(alpha))
    start = values[:season]
    cycle = np.zeros((season, len(alpha)))
    cycle[: len(start)] = (start - start.mean())[:, None]
    level, trend = np.full(len(alpha), start.mean()), np.zeros(len(alpha))
    for i, x in enumerate(values):
        slot = i % season
        forecast = level + trend + cycle[slot]
        track.see(i, forecast, x)
        risen = alpha * (x - cycle[slot]) + (1 - alpha) * (level + trend)
        trend = beta * (risen - level) + (1 - beta) * trend
        cycle[slot] = gamma * (x - risen) + (1 - gamma) * cycle[slot]
        level = risen
        if i + 1 >= begin:
            track.ahead[i + 1] = (level + trend + cycle[(i + 1) % season])[track.best]
    return track, (level, trend, cycle)


def seasonal_smoothing(values: np.ndarray, horizon: int, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    season = max(2, season)
    track, (level, trend, cycle) = _seasonal_run(values, season, begin=season)
    # The first cycle starts from what is known of it, so shorter histories start differently.
    for k in range(1, min(season, len(values))):
        track.ahead[k] = _seasonal_run(values[:k], season)[0].ahead[k]
    best, n = track.best, len(values)
    ahead = np.arange(horizon)
    return track.ahead, track.fits[:, best], level[best] + trend[best] * (ahead + 1) + cycle[(n + ahead) % season, best]


_FITS = dict(zip(SMOOTHERS, (level_smoothing, damped_trend, seasonal_smoothing)))


def smooth_series(pdf: pd.DataFrame, keys: Sequence[str], horizon: int) -> pd.DataFrame:
    """All smoother rows of one series: its points (step null) and its future steps (t null)."""
    pdf = pdf.sort_values("t")
    values, season, n = pdf["value"].to_numpy(float), int(pdf["season"].iloc[0]), len(pdf)
    steps, parts = min(horizon, n), []
    for model, fit in _FITS.items():
        ahead, fitted, future = fit(values, steps, season)
        parts.append(pd.DataFrame({
            "t": pdf["t"].to_numpy(), "n": n, "actual": values, "model": model, "ahead": ahead[:n],
            "fitted": fitted, "step": None, "forecast": np.nan}))
        parts.append(pd.DataFrame({
            "t": None, "n": n, "actual": np.nan, "model": model, "ahead": np.nan, "fitted": np.nan,
            "step": np.arange(1, steps + 1), "forecast": future}))
    out = pd.concat([p.astype({"t": "Int64", "step": "Int64"}) for p in parts], ignore_index=True)
    for key in keys:
        out[key] = pdf[key].iloc[0]
    return out


def smoother_rows(series: DataFrame, keys: Sequence[str], horizon: int = 6) -> DataFrame:
    """Points and futures of the grid-searched smoothers for every series."""
    kinds = dict(series.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{head}, t bigint, n bigint, actual double, model string, ahead double, fitted double, step bigint, forecast double"
    names = [*keys, "t", "n", "actual", "model", "ahead", "fitted", "step", "forecast"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return smooth_series(pdf, keys, horizon)[names]

    ship(series.sparkSession)
    return series.select(*keys, "t", "value", "season").groupBy(*keys).applyInPandas(run, schema)

"""Damped-trend forecasts with bootstrapped bands, and the odds of reaching a target."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StructField, StructType

from tidemark.functions.stats import finite
from tidemark.operators.scan import collected, scanned, states
from tidemark.operators.series import grid, interpolated
from tidemark.operators.trend import day_numbers

# The damping factors tried.
DAMPING = (0.80, 0.90, 0.95, 0.98, 1.0)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def steps(first: float, last: float, by: float) -> np.ndarray:
    """first, first + by ... up to ``last``, added up in floating point (so the last may be missed)."""
    out = [first]
    while out[-1] + by <= last:
        out.append(out[-1] + by)
    return np.array(out)


@dataclass
class Fit:
    alpha: float
    beta: float
    phi: float
    level: float
    trend: float
    residuals: np.ndarray
    sigma: float
    sse: float


def fit(y: np.ndarray) -> Fit | None:
    """The damped Holt model of least squared one-step error over the grid, the first of equals.

    All parameter triples advance together, a day at a time.
    """
    if len(y) < 8:
        return None
    a, b, f = (g.ravel() for g in np.meshgrid(steps(0.05, 0.95, 0.05), steps(0.0, 0.5, 0.05), np.array(DAMPING), indexing="ij"))
    level = np.full(len(a), y[0])
    trend = np.full(len(a), (y[3] - y[0]) / 3)
    errors = np.empty((len(y) - 1, len(a)))
    for t in range(1, len(y)):
        expected = level + f * trend
        errors[t - 1] = y[t] - expected
        after = a * y[t] + (1 - a) * expected
        trend = b * (after - level) + (1 - b) * f * trend
        level = after
    sse = np.cumsum(errors * errors, axis=0)[-1]
    sse[~np.isfinite(sse)] = np.inf
    i = int(np.argmin(sse))
    if np.isinf(sse[i]):
        return None
    return Fit(a[i], b[i], f[i], level[i], trend[i], errors[:, i].copy(), float(errors[:, i].std(ddof=1)), float(sse[i]))


def uniforms(seed: int, n: int) -> np.ndarray:
    """The first ``n`` numbers of the 32-bit counter generator with this seed."""
    u = np.uint32
    state = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5) + np.uint64(seed & 0xFFFFFFFF)).astype(u)
    x = (state ^ (state >> u(15))) * (state | u(1))
    x = (x + (x ^ (x >> u(7))) * (x | u(61))) ^ x
    return (x ^ (x >> u(14))).astype(np.float64) / 4294967296.0


def seed_of(text: str) -> int:
    """32-bit FNV-1a."""
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def fill(days: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of all days from the first to the last, straight lines between."""
    return np.interp(np.arange(days[0], days[-1] + 1), days, values)


def simulate(model: Fit, horizon: int, seed: int, sims: int, bounds: tuple[float, float] | None) -> np.ndarray:
    """(sims, horizon) paths: residuals drawn again, each value kept in bounds before it is used on."""
    draws = np.floor(uniforms(seed, sims * horizon).reshape(sims, horizon) * len(model.residuals)).astype(np.int64)
    noise, paths = model.residuals[draws], np.empty((sims, horizon))
    level, trend = np.full(sims, model.level), np.full(sims, model.trend)
    for h in range(horizon):
        expected = level + model.phi * trend
        seen = expected + noise[:, h]
        if bounds:
            seen = np.clip(seen, *bounds)
        paths[:, h] = seen
        after = model.alpha * seen + (1 - model.alpha) * expected
        trend = model.beta * (after - level) + (1 - model.beta) * model.phi * trend
        level = after
    return paths


def forecast_of(days: np.ndarray, values: np.ndarray, horizon: int, sims: int = 800, bounds: tuple[float, float] | None = None) -> tuple[Fit, np.ndarray] | None:
    """The model and its paths, None below eight points."""
    if len(values) < 8 or horizon <= 0:
        return None
    model = fit(fill(days, values))
    if model is None:
        return None
    first = str(np.datetime64(int(days[0]), "D"))
    return model, simulate(model, horizon, seed_of(f"{first}{len(values)}{horizon}"), sims, bounds)


def _grouped(series: DataFrame, keys: list[str], kinds, rows_of) -> DataFrame:
    schema = StructType([series.schema[k] for k in keys] + [StructField(n, t) for n, t in kinds])

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[np.isfinite(frame["value"].astype(float))].sort_values("date", ignore_index=True)
        rows = rows_of(dict(zip(keys, key, strict=True)), day_numbers(frame), frame["value"].to_numpy(dtype=float)) if len(frame) else []
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | r for r in rows], columns=schema.names)

    return series.select(*keys, "date", "value").groupBy(*keys).applyInPandas(one, schema)


def calendar(day: int):
    return np.datetime64(int(day), "D").astype(object)


def forecasts(series: DataFrame, keys: list[str], horizon: int, sims: int = 800, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Bands of every day of the horizon for each series; the seed is of the series, so partitions don't matter."""
    limits = bounds or {}

    def rows(key: dict, days: np.ndarray, values: np.ndarray) -> list[dict]:
        got = forecast_of(days, values, horizon, sims, limits.get(key.get("metric_key")))
        if got is None:
            return []
        model, paths = got
        bands = np.quantile(paths, QUANTILES, axis=0)
        return [{"date": calendar(days[-1] + h + 1), **{f"p{int(q * 100)}": float(bands[i, h]) for i, q in enumerate(QUANTILES)}, "alpha": model.alpha, "beta": model.beta, "phi": model.phi, "sigma": model.sigma} for h in range(horizon)]

    kinds = [("date", DateType()), *((c, DoubleType()) for c in ("p10", "p25", "p50", "p75", "p90", "alpha", "beta", "phi", "sigma"))]
    return _grouped(series, keys, kinds, rows)


def hits(values: np.ndarray, target: float, direction: str, tolerance: float = 0.0) -> np.ndarray:
    if direction == "increase":
        return values >= target
    if direction == "decrease":
        return values <= target
    return np.abs(values - target) <= (tolerance or abs(target) * 0.02)


def project(days: np.ndarray, values: np.ndarray, target: float, direction: str, target_day: int, today: int, bounds: tuple[float, float] | None = None) -> dict | None:
    """Probability of being at the target on the last simulated day, rates a week and the expected day."""
    horizon = target_day - today
    got = forecast_of(days, values, min(horizon, 730), 800, bounds) if horizon > 0 else None
    if got is None:
        return None
    _, paths = got
    low, middle, high = np.quantile(paths[:, -1], (0.1, 0.5, 0.9))
    reached = np.flatnonzero(hits(np.quantile(paths, 0.5, axis=0), target, direction))
    recent_days, recent = days[-28:], values[-28:]
    rate = (recent[-1] - recent[0]) / max(1, recent_days[-1] - recent_days[0]) * 7 if len(recent) >= 4 else 0.0
    return {
        "probability": float(hits(paths[:, -1], target, direction).mean()), "projected": float(middle), "projected_low": float(low), "projected_high": float(high), "current_value": float(values[-1]),
        "required_per_week": (target - values[-1]) / max(1, horizon) * 7, "current_per_week": float(rate), "eta": calendar(days[-1] + reached[0] + 1) if len(reached) else None, "horizon_days": int(horizon),
    }


def projections(series: DataFrame, keys: list[str], targets: dict[str, tuple[float, str]], target_date: str, today: str, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """For each series with a (target, direction): its odds by ``target_date``."""
    limits = bounds or {}
    end, now = (int(np.datetime64(d, "D").astype(np.int64)) for d in (target_date, today))

    def rows(key: dict, days: np.ndarray, values: np.ndarray) -> list[dict]:
        wanted = targets.get(key["metric_key"])
        got = project(days, values, *wanted, end, now, limits.get(key["metric_key"])) if wanted else None
        return [got] if got and not math.isnan(got["probability"]) else []

    names = ("probability", "projected", "projected_low", "projected_high", "current_value", "required_per_week", "current_per_week")
    return _grouped(series, keys, [*((c, DoubleType()) for c in names), ("eta", DateType()), ("horizon_days", IntegerType())], rows)


def holt_fixed(series: DataFrame, keys: list[str], alpha: float, beta: float, phi: float) -> DataFrame:
    """One-step errors of a given model: (n, sse, level, trend) of each series, days without value interpolated.

    Level and trend after a day are a linear map of those before and of its value, so they are scanned.
    """
    known = series.select(*keys, "date", "value").where(finite("value"))
    filled = interpolated(grid(known, keys), keys).select(*keys, "date", F.col("filled").alias("value"))
    rows = collected(filled, keys).select(*keys, F.transform("days", lambda d: d["value"]).alias("y"))
    y, rest = F.col("y"), F.slice("y", F.lit(2), F.size("y"))
    start = F.when(F.size(y) > 3, (F.get(y, 3) - F.get(y, 0)) / 3).otherwise(0.0)
    levels = F.concat(F.slice(y, 1, 1), F.transform(rest, lambda v: v * alpha))
    trends = F.concat(F.array(start), F.transform(rest, lambda v: v * (alpha * beta)))
    matrix = [[1 - alpha, (1 - alpha) * phi], [-alpha * beta, phi * (1 - alpha * beta)]]
    found = scanned(rows.withColumn("s", states([levels, trends])), "s", matrix)
    errors = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), rest, lambda b, v: F.pow(v - (b["x0"] + phi * b["x1"]), 2))
    last = F.element_at("s", -1)
    return found.select(*keys, F.size("y").cast("long").alias("n"), F.aggregate(errors, F.lit(0.0), lambda a, e: a + e).alias("sse"), last["x0"].alias("level"), last["x1"].alias("trend"))

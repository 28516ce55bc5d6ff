"""Trend tests and change points of whole series, as grouped maps over arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Coefficients of the Abramowitz & Stegun 7.1.26 polynomial.
_ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)


def erf(x: float) -> float:
    t = 1 / (1 + 0.3275911 * abs(x))
    return math.copysign(1 - float(np.polyval(_ERF, t)) * t * math.exp(-x * x), x) if x else 0.0


def upper_tails(z: float) -> float:
    """2 (1 - Phi(z)) by the same polynomial as the SQL expressions."""
    return 2 * (1 - 0.5 * (1 + erf(z / math.sqrt(2))))


def t_p(t: float, df: float) -> float:
    if df <= 0:
        return 1.0
    if df > 30:
        return upper_tails(t)
    if math.isinf(t):
        return 0.0
    return min(1.0, max(0.0, upper_tails(t * (1 - 1 / (4 * df)) / math.sqrt(1 + t * t / (2 * df)))))


def inversions(z: np.ndarray) -> int:
    """How many pairs i < j have z[i] > z[j], by merging sorted halves; equal values are no inversion."""
    n = len(z)
    if n < 2:
        return 0
    width = 1 << (n - 1).bit_length()
    rows, found, w = np.r_[z, np.full(width - n, np.inf)][:, None], 0, 1
    while w < width:
        halves = rows.reshape(-1, 2 * w)
        order = np.argsort(halves, axis=1, kind="stable")  # of equals the left comes first
        left = order < w
        ahead = np.cumsum(left, axis=1)
        found += int((w - ahead[~left]).sum())
        rows, w = np.take_along_axis(halves, order, axis=1), 2 * w
    return found


def inverted_pairs(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j), i < j, with rank[i] > rank[j], of distinct ranks; as much work and memory as there are pairs."""
    n = len(rank)
    width = 1 << max(0, n - 1).bit_length()
    place, w, left_of, right_of = np.arange(width), 1, [], []
    key = np.r_[rank, np.arange(n, width)]
    while w < width:
        halves, held = key.reshape(-1, 2 * w), place.reshape(-1, 2 * w)
        order = np.argsort(halves, axis=1, kind="stable")
        left = order < w
        ahead = np.cumsum(left, axis=1)
        row, col = np.nonzero(~left & (ahead < w))
        count = w - ahead[row, col]
        # The left half is sorted, so those above a right element are its last ``count``.
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        left_of.append(held[np.repeat(row, count), np.repeat(w - count, count) + at])
        right_of.append(np.repeat(held[row, order[row, col]], count))
        key, place, w = np.take_along_axis(halves, order, axis=1).ravel(), np.take_along_axis(held, order, axis=1).ravel(), 2 * w
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left_of]), np.concatenate([none, *right_of])


def kendall_s(y: np.ndarray) -> int:
    """Sum of the signs of y[j] - y[i] over i < j: pairs less ties less twice the inversions."""
    n = len(y)
    _, ties = np.unique(y, return_counts=True)
    return n * (n - 1) // 2 - int((ties * (ties - 1) // 2).sum()) - 2 * inversions(y)


#: Pairs up to which slopes are formed all at once, and slopes drawn for a point to narrow the search.
FORMED, DRAWN = 1_000_000, 64


def levels_at(x: np.ndarray, y: np.ndarray, slope: float) -> np.ndarray:
    """y - slope x as whole numbers in its order; what differs by no more than rounding is equal."""
    z = y - slope * x
    order = np.argsort(z, kind="stable")
    grain = 1e-14 * float(np.abs(y).max() + abs(slope) * np.abs(x).max())
    out = np.empty(len(z), dtype=np.int64)
    out[order] = np.r_[0, np.cumsum(np.diff(z[order]) > grain)]
    return out


def slope_of_rank(x: np.ndarray, y: np.ndarray, k: int, drawn: np.ndarray) -> float:
    """The k-th smallest of (y[j] - y[i]) / (x[j] - x[i]) over i < j, for x that rises strictly.

    A pair's slope is below v if, and only if, the pair is inverted in y - v x, so slopes
    below and equal to v are counted by merging. Values of a sorted sample narrow the rank
    down; the pairs between the last two are the inversions between the orders at both,
    and only they are formed. The sample changes the work, not the result.
    """
    n = len(y)
    every = n * (n - 1) // 2
    a, b, below, upto = -np.inf, np.inf, 0, every
    at_a, at_b = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    near, spare = len(drawn) * k / every, 1.5 * math.sqrt(len(drawn))
    tried = [drawn[int(np.clip(near + d, 0, len(drawn) - 1))] for d in (-spare, spare)]
    while upto - below > FORMED:
        inside = drawn[np.searchsorted(drawn, a, "right") : np.searchsorted(drawn, b, "left")]
        v = tried.pop() if tried else inside[len(inside) // 2] if len(inside) else None
        if v is None:
            break
        if not a < v < b:
            continue
        at = levels_at(x, y, v)
        ties = np.unique(at, return_counts=True)[1]
        less = inversions(at)
        most = less + int((ties * (ties - 1) // 2).sum())
        if less <= k < most:
            return float(v)
        if k >= most:
            a, below, at_a = v, most, at
        else:
            b, upto, at_b = v, less, at
    place = np.arange(n)
    # At a, equal slopes count as passed: the later point goes first. At b they don't.
    first = np.lexsort((-place, at_a)) if a > -np.inf else place
    then = np.lexsort((place, at_b)) if b < np.inf else place[::-1]
    rank = np.empty(n, dtype=np.int64)
    rank[then] = place
    p, q = inverted_pairs(rank[first])
    p, q = first[p], first[q]
    slopes = np.sort((y[q] - y[p]) / (x[q] - x[p]))
    return float(slopes[min(len(slopes) - 1, k - below)])


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The Theil-Sen slope, the median over all pairs of points; 0 without pairs."""
    n = len(y)
    every = n * (n - 1) // 2
    if every <= FORMED:
        i, j = np.triu_indices(n, 1)
        return float(np.median((y[j] - y[i]) / (x[j] - x[i]))) if every else 0.0
    i, j = np.random.default_rng(0).integers(0, n, (2, min(every, DRAWN * n)))
    i, j = i[i != j], j[i != j]
    drawn = np.sort((y[j] - y[i]) / (x[j] - x[i]))
    low, high = (every - 1) // 2, every // 2
    at_low = slope_of_rank(x, y, low, drawn)
    return at_low if low == high else (at_low + slope_of_rank(x, y, high, drawn)) / 2


def pairwise(x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """Kendall's S and the Theil-Sen slope of a series in the order of time, without forming all pairs."""
    return kendall_s(y), median_slope(x, y)


def lag_one(residuals: np.ndarray) -> float | None:
    """Lag-1 autocorrelation about the mean; None without variance."""
    c = residuals - residuals.mean()
    whole = float((c * c).sum())
    return float((c[:-1] * c[1:]).sum()) / whole if whole else None


def autocovariances(c: np.ndarray) -> np.ndarray:
    """Sums of c[i] c[i + k] for every lag k, by one transform of the padded series."""
    size = 1 << (2 * len(c) - 1).bit_length()
    f = np.fft.rfft(c, size)
    return np.fft.irfft(f * np.conj(f), size)[: len(c)]


def rank_inflation(residuals: np.ndarray) -> float:
    """Variance inflation from the significant autocorrelations of the residuals' ranks."""
    n = len(residuals)
    ranks = np.empty(n)
    ranks[np.argsort(residuals, kind="stable")] = np.arange(1, n + 1)
    c = ranks - (n + 1) / 2
    whole = float((c * c).sum())
    if not whole:
        return 1.0
    lags = np.arange(1, n - 2)
    rho = autocovariances(c)[1 : n - 2] / whole
    kept = np.abs(rho) > 1.96 / math.sqrt(n)
    k = n - lags[kept].astype(float)
    return float(np.clip(1 + 2 / (n * (n - 1) * (n - 2)) * (k * (k - 1) * (k - 2) * rho[kept]).sum(), 1, 50))


def sample_inflation(residuals: np.ndarray) -> float:
    """Variance inflation from the effective sample size at the lag-1 autocorrelation."""
    r = lag_one(residuals)
    if r is None:
        return 1.0
    r = min(0.995, max(0.0, r))
    return min(200.0, max(1.0, (1 + r) / (1 - r)))


def mann_kendall(y: np.ndarray, s: int, index_slope: float, correct: bool = True) -> tuple[float, float, float]:
    """(z, p, variance inflation) of S, corrected for ties and autocorrelation."""
    n = len(y)
    _, ties = np.unique(y, return_counts=True)
    ties = ties[ties > 1].astype(float)
    variance = (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18
    if variance <= 0:
        return 0.0, 1.0, 1.0
    inflation = 1.0
    if correct and n >= 10:
        residuals = y - index_slope * np.arange(n)
        inflation = max(rank_inflation(residuals), sample_inflation(residuals))
    z = (s - np.sign(s)) / math.sqrt(variance * inflation)
    return float(z), upper_tails(abs(float(z))), inflation


def drift(y: np.ndarray) -> float:
    """p of a t-test on the first differences; 1 below eight of them."""
    d = np.diff(y)
    if len(d) < 8:
        return 1.0
    sd, m = float(d.std(ddof=1)), float(d.mean())
    if not sd:
        return 1.0 if m == 0 else 0.0
    return t_p(abs(m / (sd / math.sqrt(len(d)))), len(d) - 1)


def trend_of(days: np.ndarray, y: np.ndarray) -> dict | None:
    """The trend of one series, or None below five points or without spread in time."""
    keep = np.isfinite(y)
    x, y = (days - days[0])[keep].astype(float) if len(days) else days, y[keep]
    n = len(y)
    if n < 5:
        return None
    x = x - x[0]
    sxx = float(((x - x.mean()) ** 2).sum())
    if not sxx:
        return None
    slope = float(((x - x.mean()) * (y - y.mean())).sum()) / sxx
    left = float((y - y.mean() - slope * (x - x.mean())) @ (y - y.mean() - slope * (x - x.mean())))
    whole = float(((y - y.mean()) ** 2).sum())
    se = math.sqrt(left / (n - 2) / sxx)
    s, sen = pairwise(x, y)
    _, per_step = pairwise(np.arange(n, dtype=float), y) if not np.array_equal(x, np.arange(n)) else (s, sen)
    z, mk_p, inflation = mann_kendall(y, s, per_step)
    drift_p = drift(y)
    significant = mk_p < 0.02 and drift_p < 0.02
    direction = "flat" if not significant or not sen else "rising" if sen > 0 else "falling"
    return {
        "n": n, "slope_per_day": slope, "slope_per_week": 7 * slope, "sen_slope_per_day": sen, "r2": 1 - left / whole if whole else 0.0, "p_value": t_p(abs(slope / se) if se else 0.0, n - 2),
        "s": s, "mk_z": z, "mk_p": mk_p, "drift_p": drift_p, "variance_inflation": inflation, "direction": direction, "significant": significant,
        "first": float(y[0]), "last": float(y[-1]), "change_pct": (y[-1] - y[0]) / abs(y[0]) * 100 if y[0] else None,
    }


_TREND = [
    ("n", LongType()), ("slope_per_day", DoubleType()), ("slope_per_week", DoubleType()), ("sen_slope_per_day", DoubleType()), ("r2", DoubleType()), ("p_value", DoubleType()), ("s", LongType()), ("mk_z", DoubleType()),
    ("mk_p", DoubleType()), ("drift_p", DoubleType()), ("variance_inflation", DoubleType()), ("direction", StringType()), ("significant", BooleanType()), ("first", DoubleType()), ("last", DoubleType()), ("change_pct", DoubleType()),
]


def day_numbers(frame: pd.DataFrame) -> np.ndarray:
    return pd.to_datetime(frame["date"]).to_numpy().astype("datetime64[D]").astype(np.int64)


def trends(series: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each series that has a trend to speak of."""
    schema = StructType([series.schema[k] for k in keys] + [StructField(n, t) for n, t in _TREND])

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        found = trend_of(day_numbers(frame), frame["value"].to_numpy(dtype=float))
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | found] if found else [], columns=schema.names)

    return series.select(*keys, "date", "value").groupBy(*keys).applyInPandas(one, schema)


class Sums:
    """Prefix sums of a centred series: mean and variance of any stretch in constant time."""

    def __init__(self, y: np.ndarray):
        self.shift = float(y.mean())
        c = y - self.shift
        self.s, self.q = np.r_[0.0, np.cumsum(c)], np.r_[0.0, np.cumsum(c * c)]

    def of(self, lo, hi):
        n = hi - lo
        s, q = self.s[hi] - self.s[lo], self.q[hi] - self.q[lo]
        return n, s / n + self.shift, np.maximum(0.0, (q - s * s / n) / (n - 1))


def change_points_of(y: np.ndarray, segment: int = 14, most: int = 4, alpha: float = 0.005, effect: float = 1.0) -> list[dict]:
    """Shifts of level by binary segmentation, left halves first, ``most`` in all."""
    found: list[dict] = []
    if len(y) < 2 * segment:
        return found
    sums, waiting = Sums(y), [(0, len(y))]
    while waiting and len(found) < most:
        lo, hi = waiting.pop()
        if hi - lo < 2 * segment:
            continue
        cut = np.arange(lo + segment, hi - segment + 1)
        (na, ma, va), (nb, mb, vb) = sums.of(lo, cut), sums.of(cut, hi)
        error = va / na + vb / nb
        t = np.where(error > 1e-18, np.abs(mb - ma) / np.sqrt(np.where(error > 1e-18, error, 1.0)), 0.0)
        at = int(np.argmax(t))
        if not t[at] > 0:
            continue
        before, after = y[lo : cut[at]], y[cut[at] : hi]
        pooled = math.sqrt((before.var(ddof=1) * (len(before) - 1) + after.var(ddof=1) * (len(after) - 1)) / (hi - lo - 2))
        if not pooled or abs(d := float(after.mean() - before.mean()) / pooled) < effect:
            continue
        residuals = np.r_[before - before.mean(), after - after.mean()]
        whole = float((residuals**2).sum())
        r = min(0.99, max(0.0, float((residuals[:-1] * residuals[1:]).sum()) / whole)) if whole and hi - lo >= 6 else 0.0
        share = max(0.02, (1 - r) / (1 + r)) if whole and hi - lo >= 6 else 1.0
        p = t_p(float(t[at]) * math.sqrt(share), max(1.0, (hi - lo) * share - 2))
        if p > 1 - (1 - alpha) ** (1 / len(cut)):
            continue
        found.append({"index": int(cut[at]), "before": float(before.mean()), "after": float(after.mean()), "delta": float(after.mean() - before.mean()), "effect_size": d, "p_value": p})
        waiting += [(int(cut[at]), hi), (lo, int(cut[at]))]  # the left half is taken next
    return sorted(found, key=lambda f: f["index"])


def change_points(series: DataFrame, keys: list[str], segment: int = 14, most: int = 4, alpha: float = 0.005, effect: float = 1.0) -> DataFrame:
    """The change points of every series, by date."""
    kinds = [("date", DateType()), ("index", IntegerType()), *((c, DoubleType()) for c in ("before", "after", "delta", "effect_size", "p_value"))]
    schema = StructType([series.schema[k] for k in keys] + [StructField(n, t) for n, t in kinds])

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[np.isfinite(frame["value"].astype(float))].sort_values("date", ignore_index=True)
        rows = change_points_of(frame["value"].to_numpy(dtype=float), segment, most, alpha, effect)
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | {"date": frame["date"][r["index"]]} | r for r in rows], columns=schema.names)

    return series.select(*keys, "date", "value").groupBy(*keys).applyInPandas(one, schema)

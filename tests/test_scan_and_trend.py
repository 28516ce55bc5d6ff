"""The associative scan against plain recurrences; trend statistics against all pairs."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import forecast, scan, series, training, trend

START = dt.date(2020, 1, 1)


def points(spark, values, key="m"):
    rows = [(key, START + dt.timedelta(d), v) for d, v in values]
    return spark.createDataFrame(rows, "metric_key string, date date, value double")


@pytest.mark.parametrize("n", [1, 2, 3, 31, 64, 1000])
def test_scan_of_two_states(spark, n):
    random.seed(n)
    matrix, inputs = [[0.7, 0.2], [-0.1, 0.95]], [(random.random(), random.random()) for _ in range(n)]
    frame = spark.createDataFrame([([{"x0": a, "x1": b} for a, b in inputs],)], "s array<struct<x0: double, x1: double>>")
    got = [(r["x0"], r["x1"]) for r in scan.scanned(frame, "s", matrix).first()["s"]]
    state, want = np.zeros(2), []
    for b in inputs:
        state = np.array(matrix) @ state + b
        want.append(tuple(state))
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


def loads(spark, days, user=1):
    return spark.createDataFrame([(user, START + dt.timedelta(d), float(v)) for d, v in days], "user_id long, date date, load double")


def model_by_hand(days):
    dense = dict(days)
    out, c, a, cw, aw, before = {}, 0.0, 0.0, 0.0, 0.0, None
    for i, d in enumerate(range(days[0][0], days[-1][0] + 1)):
        x, rs, rf = dense.get(d, 0.0), np.exp(-1 / 42), np.exp(-1 / 7)
        c, a, cw, aw = c * rs + x, a * rf + x, cw * rs + 1, aw * rf + 1
        out[START + dt.timedelta(d)] = (x, c / cw, a / aw, before, (a / aw) / (c / cw) if c / cw > 1 else None, i >= 42)
        before = c / cw - a / aw
    return out


def same(got, want):
    return got == want or (got is not None and want is not None and abs(got - want) < 1e-9)


def test_training_load_and_its_continuation(spark):
    random.seed(2)
    days = [(d, random.choice([0.0, 30.0, 90.0, 300.0])) for d in range(200) if random.random() < 0.6]
    whole = {r.date: (r.load, r.ctl, r.atl, r.tsb, r.acwr, r.established) for r in training.training_load(loads(spark, days), ["user_id"]).collect()}
    want = model_by_hand(days)
    assert whole.keys() == want.keys() and all(same(a, b) for k in want for a, b in zip(whole[k], want[k], strict=True))
    for cut in (days[0][0], 20, 41, 150):
        day = START + dt.timedelta(cut)
        state = spark.createDataFrame([(1, day, cut - days[0][0], whole[day][1], whole[day][2])], "user_id long, day date, i int, ctl double, atl double")
        later = {r.date: (r.load, r.ctl, r.atl, r.tsb, r.acwr, r.established) for r in training.training_load(loads(spark, [x for x in days if x[0] > cut]), ["user_id"], since=state).collect()}
        assert later.keys() == {k for k in want if k > day}
        assert all(same(a, b) for k in later for a, b in zip(later[k], want[k], strict=True))


def test_ewma_carries_over_gaps(spark):
    values = [(0, None), (1, float("nan")), (2, 4.0), (3, None), (4, 8.0), (5, None), (6, None)]
    got = [r.ewma for r in series.ewma(points(spark, values), ["metric_key"], 1.0).orderBy("date").collect()]
    assert got == [None, None, 4.0, 4.0, 6.0, 6.0, 6.0]
    assert [r.ewma for r in series.ewma(points(spark, [(0, None), (1, None)]), ["metric_key"], 1.0).collect()] == [None, None]
    assert series.ewma(points(spark, []), ["metric_key"], 1.0).count() == 0


def test_holt_over_gaps(spark):
    random.seed(3)
    values = [(d, random.random() * 10) for d in range(60) if d % 7 or not d]
    (row,) = forecast.holt_fixed(points(spark, values), ["metric_key"], 0.3, 0.1, 0.9).collect()
    y = np.interp(np.arange(values[-1][0] + 1), *zip(*values, strict=True))
    level, slope, sse = y[0], (y[3] - y[0]) / 3, 0.0
    for v in y[1:]:
        expected = level + 0.9 * slope
        sse += (v - expected) ** 2
        after = 0.3 * v + 0.7 * expected
        level, slope = after, 0.1 * (after - level) + 0.9 * 0.9 * slope
    assert row.n == len(y) and np.allclose((row.sse, row.level, row.trend), (sse, level, slope), rtol=1e-9)


def every_pair(x, y):
    i, j = np.triu_indices(len(y), 1)
    d = y[j] - y[i]
    return int(np.sign(d).sum()), float(np.median(d / (x[j] - x[i])))


def test_trend_by_merging_is_that_of_all_pairs(monkeypatch):
    monkeypatch.setattr(trend, "FORMED", 50)  # so that short series are searched, not formed
    rng = np.random.default_rng(5)
    for t in range(250):
        n, kind = int(rng.integers(2, 120)), t % 5
        x = np.cumsum(rng.integers(1, 4, n)).astype(float) if t % 2 else np.arange(n, dtype=float)
        y = (rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.cumsum(rng.normal(size=n)) * 1e6, 0.5 * x + rng.integers(0, 2, n), 3.7 + 0.1 * x)[kind]
        s, sen = every_pair(x, y)
        got = trend.pairwise(x, y)
        assert got[0] == s and abs(got[1] - sen) <= 1e-9 * max(1, abs(sen))


def test_trend_of_twenty_thousand_days_is_bounded():
    import tracemalloc

    rng, n = np.random.default_rng(6), 20_000
    x = np.arange(n, dtype=float)
    for y in (np.cumsum(rng.normal(size=n)), rng.integers(0, 5, n).astype(float), 3 + 0.25 * x):
        tracemalloc.start()
        s, sen = trend.pairwise(x, y)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200e6
        below = trend.inversions(trend.levels_at(x, y, sen - 1e-7)), trend.inversions(trend.levels_at(x, y, sen + 1e-7))
        assert below[0] <= n * (n - 1) // 4 <= below[1]


def test_autocovariances_of_all_lags():
    c = np.random.default_rng(7).normal(size=700)
    c -= c.mean()
    assert np.allclose(trend.autocovariances(c), [c[: 700 - k] @ c[k:] for k in range(700)], rtol=0, atol=1e-9)
    assert trend.inversions(np.array([3.0, 1.0, 2.0, 2.0])) == 3 and trend.inversions(np.zeros(0)) == 0

"""The sections of the report on small series with planted shifts, outliers and drivers."""

import datetime

import numpy as np
import pytest

from tidemark.operators import relations as R
from tidemark.plans import report

TODAY = datetime.date(2024, 6, 30)
POINTS = "user_id long, metric_key string, date date, value double"


def days(n):
    return [TODAY - datetime.timedelta(days=n - 1 - i) for i in range(n)]


def series(user, key, values):
    return [(user, key, d, float(v)) for d, v in zip(days(len(values)), values, strict=True)]


@pytest.fixture(scope="module")
def points(spark):
    noise = np.random.default_rng(5)
    rows = []
    for user in (1, 2):
        walked = noise.normal(7, 1, 120)
        # User 2 is ready as the steps say, user 1 by chance; sleep would be part of readiness by construction.
        rows += series(user, "steps", walked)
        rows += series(user, "readiness", 50 + 8 * (walked - 7) + noise.normal(0, 0.5, 120) if user == 2 else noise.normal(50, 5, 120))
    weight = noise.normal(80, 0.5, 120)
    weight[60:] += 4  # a shift
    weight[[80, 115]] += 20  # two outliers, one of them within 21 days
    rows += series(1, "weight_kg", weight) + series(1, "body_fat_pct", np.linspace(25, 20, 120))
    rows += series(1, "resting_hr", [*noise.normal(55, 1, 23), 200.0])  # 24 points: too few to watch
    for key, value in (("ctl", 50.0), ("atl", 40.0), ("tsb", 10.0), ("acwr", 0.8)):
        rows += series(1, key, [value] * 30)
    rows += series(1, "training_load", [10, 20, 30, 40, 50, 60, 70])
    return spark.createDataFrame(rows, POINTS)


@pytest.fixture(scope="module")
def no_targets(spark):
    return spark.createDataFrame([], "user_id long, goal_id long, metric_key string, direction string, baseline double, target_value double, weight double, start_date date, target_date date")


def test_events_of_watched_series(points, no_targets):
    seen = report.watched(points, no_targets, str(TODAY))
    assert "resting_hr" not in {r.metric_key for r in seen.select("metric_key").distinct().collect()}
    found = report.events(seen, str(TODAY)).where("metric_key = 'weight_kg'").collect()
    shifts = [r for r in found if r.kind == "change"]
    assert any(abs((r.date - days(120)[60]).days) <= 3 and 3 < r["size"] < 6 for r in shifts)
    odd = {r.date for r in found if r.kind == "anomaly"}
    assert days(120)[115] in odd and days(120)[80] not in odd


def test_condition_and_warmup(points):
    state = {r.name: r.value for r in report.condition(points, str(TODAY)).where("user_id = 1").collect()}
    assert (state["ctl"], state["atl"], state["tsb"], state["acwr"]) == (50.0, 40.0, 10.0, 0.8)
    assert state["warmup_days"] == 42 - 30
    loads = np.array([10, 20, 30, 40, 50, 60, 70.0])
    assert state["monotony"] == pytest.approx(loads.mean() / loads.std(ddof=1))
    assert state["strain"] == pytest.approx(loads.sum() * loads.mean() / loads.std(ddof=1))
    assert "ctl" not in {r.name for r in report.condition(points, str(TODAY)).where("user_id = 2").collect()}


def test_drivers_stay_with_their_user(points):
    wanted = points.where("metric_key = 'readiness'")
    found = {(r.user_id, r.driver): r for r in R.drivers(points.where("metric_key = 'steps'"), wanted, by=("user_id",)).collect()}
    assert found[(2, "steps")].r2 > 0.9 and found[(2, "steps")].lag == 0
    assert found[(2, "steps")].n == 120  # days of one user, not of both
    assert (1, "steps") not in found or found[(1, "steps")].r2 < 0.2
    alone = R.drivers(points.where("metric_key = 'steps' AND user_id = 2"), wanted.where("user_id = 2")).first()
    assert alone.r2 == pytest.approx(found[(2, "steps")].r2)


def test_all_sections(spark, points, no_targets):
    goals = spark.createDataFrame([(1, 7, datetime.date(2024, 5, 1), datetime.date(2024, 8, 1))], "user_id long, goal_id long, start_date date, target_date date")
    targets = spark.createDataFrame([(1, 7, "weight_kg", "decrease", 84.0, 80.0, 1.0, datetime.date(2024, 5, 1), datetime.date(2024, 8, 1))], no_targets.schema)
    store = points.selectExpr("*", "'csv' AS source", "1L AS seq")
    rows = report.full_report(points, store, goals, targets, str(TODAY)).collect()
    assert {r.section for r in rows if r.user_id == 1} >= {"goal", "target", "snapshot", "readiness", "recomposition", "load", "driver", "event", "data_health"}
    health = {r.name: r.value for r in rows if r.user_id == 1 and r.section == "data_health"}
    assert health["weight_kg"] == 1.0 and health["resting_hr"] == pytest.approx(24 / 90, abs=1e-6)
    assert all(r.label.endswith("weight_kg") for r in rows if r.user_id == 1 and r.section == "driver")
    assert all(r.label.endswith("readiness") for r in rows if r.user_id == 2 and r.section == "driver")


def test_report_of_nothing(spark, points, no_targets):
    none = points.limit(0)
    goals = spark.createDataFrame([], "user_id long, goal_id long, start_date date, target_date date")
    assert report.full_report(none, none.selectExpr("*", "'csv' AS source", "1L AS seq"), goals, no_targets, str(TODAY)).collect() == []

"""Recomputation of what changes affect equals the full one, and reads only the users concerned."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import derive

START = dt.date(2023, 1, 1)
METRICS = ("weight_kg", "body_fat_pct", "resting_hr", "hrv_ms", "sleep_hours", "max_hr_daily", "steps")
USERS = range(1, 5)


def day(n):
    return START + dt.timedelta(n)


def world(seed):
    rng = random.Random(seed)
    points = {(u, day(d), m): rng.uniform(40, 90) for u in USERS for d in range(70) for m in METRICS if rng.random() < 0.6}
    workouts = {(u, day(d), k): (rng.uniform(10, 90), rng.choice([None, rng.uniform(90, 170)]), rng.choice([None, 6.0])) for u in USERS for d in range(5, 70) for k in range(2) if rng.random() < 0.3}
    sets = {(u, day(d), k): (rng.choice("abcdefgh"), rng.randrange(1, 14), rng.uniform(10, 100), rng.choice([5.0, 8.0])) for u in USERS for d in range(70) for k in range(4) if rng.random() < 0.2}
    return points, workouts, sets


def frames(spark, held):
    points, workouts, sets = held
    return (
        spark.createDataFrame([(u, m, d, v) for (u, d, m), v in points.items()], "user_id long, metric_key string, date date, value double"),
        spark.createDataFrame([(u, d, "Run", "csv", *v) for (u, d, _), v in workouts.items()], "user_id long, date date, type string, source string, duration_min double, avg_hr double, rpe double"),
        spark.createDataFrame([(u, d, *v) for (u, d, _), v in sets.items()], "user_id long, date date, exercise string, reps int, weight_kg double, rpe double"),
    )


def found(frame):
    return {(r.user_id, r.metric_key, r.date): r.value for r in frame.collect()}


def change(held, seed):
    """Values written, changed and deleted of some users, and what changed: {(user, input): first day}."""
    rng, first = random.Random(seed), {}
    points, workouts, sets = (dict(x) for x in held)

    def note(user, name, at):
        first[(user, name)] = min(at, first.get((user, name), at))

    for user, metric, at in ((1, "weight_kg", 30), (1, "hrv_ms", 66), (2, "resting_hr", 50), (2, "steps", 3)):
        points[(user, day(at), metric)] = rng.uniform(40, 90)
        note(user, metric, day(at))
    for k in [k for k in points if k[0] == 1 and k[2] == "body_fat_pct" and k[1] > day(60)]:
        del points[k]
        note(1, "body_fat_pct", k[1])
    for user, at, kind in ((3, 40, "gone"), (3, 69, "gone"), (1, 68, "new"), (4, 1, "new")):
        for k in [k for k in workouts if k[0] == user and (k[1] >= day(at) if kind == "gone" else k[1] == day(at))]:
            del workouts[k]
            note(user, "workouts", k[1])
        if kind == "new":
            workouts[(user, day(at), 0)] = (60.0, None, 7.0)
            note(user, "workouts", day(at))
    sets[(3, day(50), 9)] = ("a", 5, 200.0, 9.0)
    note(3, "sets", day(50))
    return (points, workouts, sets), first


@pytest.mark.parametrize("seed", [1, 2])
def test_affected_equals_full(spark, tmp_path, seed):
    before = world(seed)
    derived = derive.recompute(*frames(spark, before))
    derived.write.parquet(str(tmp_path / "d"))
    derived = spark.read.parquet(str(tmp_path / "d"))
    after, first = change(before, seed)
    changes = spark.createDataFrame([(u, m, d) for (u, m), d in first.items()], "user_id long, metric_key string, first_day date")
    rows, slices = derive.recompute_affected(*frames(spark, after), derived, changes)
    got, want = found(derive.replaced(derived, rows, slices)), found(derive.recompute(*frames(spark, after)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)
    assert got != found(derived)
    new = found(rows)
    assert {k[0] for k in new if k[1] in derive.PARTS["masses"]} == {1} and {k[0] for k in new if k[1] in derive.STRENGTH} == {3}
    # The model of user 1 is taken up on the last training day before the change, not computed from the start.
    last = max(d for u, d, _ in before[1] if u == 1 and d < day(68))
    assert min(d for u, m, d in new if u == 1 and m == "ctl") == last + dt.timedelta(1)
    assert min(d for u, m, d in new if u == 1 and m == "lean_mass_kg") >= day(30)


def test_what_depends_on_what():
    assert derive.dependents("weight_kg") == {"lean_mass_kg", "fat_mass_kg"}
    assert derive.dependents("workouts") == {"training_load", "workout_min", "ctl", "atl", "tsb", "acwr", "readiness"}
    assert derive.dependents("hrv_ms") == {"readiness"} and derive.dependents("steps") == set()


def test_no_change_is_no_work(spark):
    held = frames(spark, world(3))
    derived = derive.recompute(*held)
    none = spark.createDataFrame([], "user_id long, metric_key string, first_day date")
    rows, slices = derive.recompute_affected(*held, derived, none)
    assert rows.count() == 0 and slices.count() == 0
    assert derive.affected(spark.createDataFrame([(1, "steps", START)], none.schema)).where(F.lit(True)).count() == 0

"""Recomputation of derived metrics: of all users in one job, or of what a change affects.

A change is (user, input, first day). What depends on the input follows from
``DERIVED_FROM``, and from the session tables, whose inputs are named ``workouts`` and
``sets``. Parts are recomputed for the users concerned only, from the first day that can
differ: the training model takes up its state of the last training day before the change,
which its stored values and the number of days so far hold in full. Where any day may
differ (the resting heart rate's median and the observed maximum weigh every session, new
sets may change the main lifts) a part is recomputed whole for the user.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vocab import DERIVED_FROM
from tidemark.operators import training as K
from tidemark.operators.relational import together

USER = ["user_id"]
MODEL = ("ctl", "atl", "tsb", "acwr")
STRENGTH = ("training_volume_kg", "sets_count", "reps_total", "hard_sets", "top_set_kg", "strength_index")
#: The parts that are recomputed together, and what they give.
PARTS: dict[str, tuple[str, ...]] = {
    "masses": ("lean_mass_kg", "fat_mass_kg"),
    "load": ("training_load", "workout_min", *MODEL),
    "readiness": ("readiness",),
    "strength": STRENGTH,
}
#: What the parts read besides the metrics of ``DERIVED_FROM``.
SESSIONS = {"workouts": ("training_load", "workout_min"), "resting_hr": ("training_load",), "max_hr_daily": ("training_load",), "sets": STRENGTH}
#: Inputs that weigh on every day of a part.
WHOLE = {("resting_hr", "load"), ("max_hr_daily", "load"), ("sets", "strength")}
#: The first day that the store takes.
EVER = dt.date(1900, 1, 1)


def named(rows: DataFrame, **metrics: str) -> DataFrame:
    """Metric rows of columns: metric = column, nulls left out."""
    columns = [F.col(c).cast("double").alias(k) for k, c in metrics.items()]
    return rows.select("user_id", "date", *columns).unpivot(["user_id", "date"], list(metrics), "metric_key", "value").where("value IS NOT NULL")


def heart_rates(resolved: DataFrame) -> DataFrame:
    """Each user's usual resting heart rate and observed maximum."""
    of = lambda key: F.when(F.col("metric_key") == key, F.col("value"))
    return resolved.where(F.col("metric_key").isin("resting_hr", "max_hr_daily")).groupBy("user_id").agg(F.coalesce(F.median(of("resting_hr")), F.lit(55.0)).alias("resting"), F.max(of("max_hr_daily")).alias("observed"))


def daily_loads(resolved: DataFrame, workouts: DataFrame, ages: DataFrame | None) -> DataFrame:
    """Load and minutes of each user and training day, by each user's own heart rates."""
    sessions = K.best_source(workouts).join(heart_rates(resolved), "user_id", "left")
    age = F.lit(None).cast("int")
    if ages is not None:
        sessions, age = sessions.join(ages, "user_id", "left"), F.col("age")
    load = K.session_load(F.coalesce("resting", F.lit(55.0)), K.max_heart_rate(age, F.col("observed")))
    return K.daily_load(sessions.withColumn("load", load))


def form_of(model: DataFrame) -> DataFrame:
    return model.where("tsb IS NOT NULL").select("user_id", "date", F.col("tsb").alias("value"))


def load_rows(daily: DataFrame, model: DataFrame) -> list[DataFrame]:
    trained = daily.withColumn("minutes", F.when(F.col("minutes") > 0, F.col("minutes")))
    return [named(trained, training_load="load", workout_min="minutes"), named(model, **{k: k for k in MODEL})]


def recompute(resolved: DataFrame, workouts: DataFrame, sets: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """(user_id, date, metric_key, value, source) of every derived metric.

    Replaces the whole derived slice of each user, so values whose inputs are gone go too.
    """
    of = lambda key: resolved.where(F.col("metric_key") == key).select("user_id", "date", "value")
    masses = K.body_composition(of("weight_kg"), of("body_fat_pct"), USER)
    daily = daily_loads(resolved, workouts, ages)
    model = K.training_load(daily, USER)
    ready = K.readiness(of("hrv_ms"), of("resting_hr"), of("sleep_hours"), form_of(model), USER)
    parts = [
        named(masses, lean_mass_kg="lean", fat_mass_kg="fat"), *load_rows(daily, model), named(ready, readiness="value"),
        K.daily_strength(sets, USER).select("user_id", "date", "metric_key", "value"), named(K.strength_index(sets, USER), strength_index="value"),
    ]
    return together(parts).withColumn("source", F.lit("derived"))


def dependents(key: str) -> set[str]:
    """The derived metrics that an input reaches, over any number of steps."""
    found, waiting = set(), [key]
    while waiting:
        k = waiting.pop()
        nearer = {d for d, inputs in DERIVED_FROM.items() if k in inputs} | set(SESSIONS.get(k, ()))
        waiting += nearer - found
        found |= nearer
    return found


def affected(changes: DataFrame) -> DataFrame:
    """(user_id, part, first_day) from changes (user_id, metric_key, first_day)."""
    inputs = {k for of in DERIVED_FROM.values() for k in of} | set(SESSIONS)
    # Fixed values in the expression: no join, so nothing that a driver has to send.
    reach = [(k, [F.struct(F.lit(part).alias("part"), F.lit((k, part) in WHOLE).alias("whole")) for part, gives in PARTS.items() if dependents(k) & set(gives)]) for k in sorted(inputs)]
    parts = F.create_map(*[c for k, found in reach if found for c in (F.lit(k), F.array(*found))])
    hit = changes.select("user_id", "first_day", F.explode(F.try_element_at(parts, F.col("metric_key"))).alias("r"))
    day = F.when(F.col("r.whole"), F.lit(EVER)).otherwise(F.col("first_day"))
    return hit.groupBy("user_id", F.col("r.part").alias("part")).agg(F.min(day).alias("first_day"))


def recompute_affected(resolved: DataFrame, workouts: DataFrame, sets: DataFrame, derived: DataFrame, changes: DataFrame, ages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a change of the inputs makes of the derived metrics: (rows, slices).

    ``derived`` are the rows of before, ``changes`` (user_id, metric_key, first_day) what
    is new in the others, deletions included. The rows replace the stored ones of the
    slices (user_id, metric_key, first_day) from that day on; see ``replaced``.
    """
    hit = affected(changes)
    users = {part: hit.where(F.col("part") == part).select("user_id", "first_day") for part in PARTS}
    of = lambda key, part: resolved.where(F.col("metric_key") == key).select("user_id", "date", "value").join(users[part], "user_id", "left_semi")
    from_day = lambda rows, part: rows.join(users[part], "user_id").where("date >= first_day").drop("first_day")

    masses = from_day(K.body_composition(of("weight_kg", "masses"), of("body_fat_pct", "masses"), USER), "masses")

    daily = daily_loads(resolved.join(users["load"], "user_id", "left_semi"), from_day(workouts, "load"), ages)
    old = derived.join(users["load"], "user_id").where("date < first_day")
    trained = old.where("metric_key = 'training_load'").groupBy("user_id").agg(F.max("date").alias("day"), F.min("date").alias("start"))
    value = lambda key: F.max(F.when(F.col("metric_key") == key, F.col("value"))).alias(key)
    held = old.where("metric_key IN ('ctl', 'atl')").join(trained, "user_id").where("date = day").groupBy("user_id", "day", "start").agg(value("ctl"), value("atl"))
    state = held.select("user_id", "day", F.date_diff("day", "start").alias("i"), "ctl", "atl")
    model = K.training_load(daily.join(state, "user_id", "left_anti"), USER).unionByName(K.training_load(daily, USER, since=state))
    model_from = users["load"].join(state, "user_id", "left").select("user_id", F.coalesce(F.date_add("day", 1), F.lit(EVER)).alias("model_day"))

    ready_from = users["readiness"].join(model_from, "user_id", "left").select("user_id", F.least("first_day", "model_day").alias("first_day"), "model_day")
    kept = derived.where("metric_key = 'tsb'").join(ready_from, "user_id").where("model_day IS NULL OR date < model_day").select("user_id", "date", "value")
    ready = K.readiness(of("hrv_ms", "readiness"), of("resting_hr", "readiness"), of("sleep_hours", "readiness"), kept.unionByName(form_of(model)), USER)
    ready = ready.join(ready_from, "user_id").where("date >= first_day").select("user_id", "date", "value")

    lifted = sets.join(users["strength"], "user_id", "left_semi")
    rows = [
        named(masses, lean_mass_kg="lean", fat_mass_kg="fat"), *load_rows(daily, model), named(ready, readiness="value"),
        K.daily_strength(lifted, USER).select("user_id", "date", "metric_key", "value"), named(K.strength_index(lifted, USER), strength_index="value"),
    ]
    gone = lambda frame, keys, day="first_day": frame.select("user_id", F.explode(F.array(*map(F.lit, keys))).alias("metric_key"), F.col(day).alias("first_day"))
    slices = [gone(users["masses"], PARTS["masses"]), gone(users["load"], ("training_load", "workout_min")), gone(model_from, MODEL, "model_day"), gone(ready_from, PARTS["readiness"]), gone(users["strength"], STRENGTH)]
    return together(rows).withColumn("source", F.lit("derived")), together(slices)


def replaced(derived: DataFrame, rows: DataFrame, slices: DataFrame) -> DataFrame:
    """``derived`` with the slices from their first days on replaced by ``rows``."""
    kept = derived.join(slices, ["user_id", "metric_key"], "left").where("first_day IS NULL OR date < first_day").select(*derived.columns)
    return kept.unionByName(rows.select(*derived.columns))

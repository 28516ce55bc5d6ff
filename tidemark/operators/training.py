"""Training: session loads, the fitness model, readiness, strength, body composition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import clamp
from tidemark.functions.vocab import WORKOUT_RANK
from tidemark.operators.scan import collected, dense_values, scanned, states
from tidemark.operators.series import baseline_z, ordered
from tidemark.operators.store import precedence

#: Load a minute by kind of training, where there is neither heart rate nor effort.
MODALITIES = (("STRENGTH|WEIGHT|LIFT|RESISTANCE", 1.4), ("WALK|YOGA|STRETCH|PILATES|MOBILITY", 1.0), ("RUN|BIKE|CYCL|SWIM|ROW|HIIT|INTERVAL", 3.5))
OTHER_MODALITY, LOAD_CAP = 2.5, 600.0


def family(kind: str = "type") -> Column:
    """The activity a session counts as when sources overlap."""
    name = F.upper(F.coalesce(kind, F.lit("other")))
    return F.when(name.contains("STRENGTH"), "STRENGTH").otherwise(name)


def best_source(workouts: DataFrame) -> DataFrame:
    """For each user, day and activity only the sessions of the source that ranks highest (all of them)."""
    rank = precedence("source", WORKOUT_RANK)
    w = Window.partitionBy("user_id", "date", family())
    return workouts.withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(w)).where("_rank = _best").drop("_rank", "_best")


def max_heart_rate(age: Column, observed: Column) -> Column:
    """The observed maximum, at least what age predicts (190 without age)."""
    return F.greatest(F.coalesce(observed, F.lit(0.0)), F.when(age > 0, 208 - 0.7 * age).otherwise(190.0))


def session_load(resting: Column, maximum: Column) -> Column:
    """Load of a session: by heart rate, else by perceived effort, else by kind; at most ``LOAD_CAP``."""
    minutes, hr, rpe = F.coalesce("duration_min", F.lit(0.0)), F.coalesce("avg_hr", F.lit(0.0)), F.coalesce("rpe", F.lit(0.0))
    reserve = clamp(F.try_divide(hr - resting, maximum - resting), 0, 1)
    kind = F.upper(F.coalesce("type", F.lit("")))
    rate = F.when(kind.rlike(MODALITIES[0][0]), MODALITIES[0][1])
    for pattern, value in MODALITIES[1:]:
        rate = rate.when(kind.rlike(pattern), value)
    load = F.when((hr != 0) & (maximum > resting), minutes * reserve * 0.64 * F.exp(1.92 * reserve)).when(rpe != 0, minutes * rpe).otherwise(minutes * rate.otherwise(OTHER_MODALITY))
    return F.when(minutes <= 0, 0.0).otherwise(F.least(load, F.lit(LOAD_CAP)))


def daily_load(sessions: DataFrame) -> DataFrame:
    """Load and minutes of each user and day."""
    return sessions.groupBy("user_id", "date").agg(F.sum("load").alias("load"), F.sum(F.coalesce("duration_min", F.lit(0.0))).alias("minutes"))


def decay(tau: int) -> float:
    """What is left of a day's load a day later."""
    return math.exp(-1 / tau)


def weight_so_far(i: Column, tau: int) -> Column:
    """Sum of the weights of the days 0 to i."""
    return (1 - F.pow(F.lit(decay(tau)), i + 1)) / (1 - decay(tau))


def training_load(daily: DataFrame, keys: list[str], slow: int = 42, fast: int = 7, since: DataFrame | None = None) -> DataFrame:
    """Fitness, fatigue, form and ratio on every day from the first to the last; days off have load 0.

    Both averages are bias-corrected, that is, weighted means of the days so far. Form is
    of the day before; the ratio is null until fitness exceeds 1. ``since`` (keys, day, i,
    ctl, atl) carries the state of a day on: ``daily`` then holds later days only, and so
    does the result.
    """
    if since is None:
        rows = collected(daily, keys, "load").withColumns({"i": F.lit(-1), "ctl": F.lit(None).cast("double"), "atl": F.lit(None).cast("double")})
    else:
        # A load of 0 on the day after the state's, so that days off right after it are there.
        start = since.select(*keys, F.date_add("day", 1).alias("date"), F.lit(0.0).alias("load"))
        days = daily.select(*keys, "date", "load").unionByName(start.join(daily.select(*keys).distinct(), keys, "left_semi")).groupBy(*keys, "date").agg(F.sum("load").alias("load"))
        rows = collected(days, keys, "load").join(since.select(*keys, "i", "ctl", "atl"), keys)
    rates = (slow, fast)
    carried = [F.coalesce(F.col(c) * weight_so_far(F.col("i"), tau) * decay(tau), F.lit(0.0)) for c, tau in zip(("ctl", "atl"), rates, strict=True)]
    loads = rows.withColumn("loads", dense_values(F.col("days"))).drop("days")
    inputs = [F.concat(F.array(F.element_at("loads", 1) + c), F.slice("loads", F.lit(2), F.size("loads"))) for c in carried]
    found = scanned(loads.withColumn("s", states(inputs)), "s", [[decay(slow), 0.0], [0.0, decay(fast)]])
    means = [F.transform("s", lambda v, k: v["x0"] / weight_so_far(k + F.col("i") + 1, slow)), F.transform("s", lambda v, k: v["x1"] / weight_so_far(k + F.col("i") + 1, fast))]
    known = found.select(*keys, "first", "i", "ctl", "atl", "loads", means[0].alias("c"), means[1].alias("a"))
    form = F.concat(F.array(F.col("ctl") - F.col("atl")), F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("a", F.lit(1), F.size("c") - 1), lambda c, a: c - a))
    days = known.select(*keys, "first", "i", F.posexplode(F.arrays_zip(F.col("loads").alias("load"), F.col("c").alias("ctl"), F.col("a").alias("atl"), form.alias("tsb"))).alias("k", "d"))
    ratio = F.when(F.col("d.ctl") > 1, F.col("d.atl") / F.col("d.ctl"))
    return days.select(*keys, F.date_add("first", F.col("k")).alias("date"), "d.load", "d.ctl", "d.atl", "d.tsb", ratio.alias("acwr"), (F.col("k") + F.col("i") + 1 >= slow).alias("established"))


def monotony(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Monotony, strain and weekly load of the last seven training days; none with fewer, or without spread."""
    last = daily.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))).where("_k <= 7")
    week = last.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("load").alias("m"), F.stddev_samp("load").alias("sd")).where("n = 7 AND sd > 0")
    return week.select(*keys, (F.col("m") / F.col("sd")).alias("monotony"), (7 * F.col("m") * F.col("m") / F.col("sd")).alias("strain"), (7 * F.col("m")).alias("weekly_load"))


def readiness(hrv: DataFrame, resting_hr: DataFrame, sleep: DataFrame, form: DataFrame | None, keys: list[str]) -> DataFrame:
    """Daily readiness, 0 to 100, from each input's distance to its own baseline; days with half the weight at least."""
    parts = []
    for points, weight, sign in ((hrv, 0.35, 1.0), (resting_hr, 0.30, -1.0), (sleep, 0.25, 1.0)):
        z = baseline_z(points.select(*keys, "date", "value"), keys).where("z IS NOT NULL")
        parts.append(z.select(*keys, "date", (50 + 20 * clamp(sign * F.col("z"), -2.5, 2.5)).alias("score"), F.lit(weight).alias("weight")))
    if form is not None:
        parts.append(form.select(*keys, "date", (50 + 0.8 * clamp(F.col("value"), -40, 25)).alias("score"), F.lit(0.1).alias("weight")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    summed = rows.groupBy(*keys, "date").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return summed.where(F.round("w", 9) >= 0.5).select(*keys, "date", clamp(F.col("s") / F.col("w"), 0, 100).alias("value"))


def body_composition(weight: DataFrame, fat_pct: DataFrame, keys: list[str]) -> DataFrame:
    """Fat and lean mass on days that have weight and body fat."""
    both = weight.select(*keys, "date", F.col("value").alias("w")).join(fat_pct.select(*keys, "date", F.col("value").alias("b")), [*keys, "date"])
    return both.select(*keys, "date", (F.col("w") * (F.col("b") / 100)).alias("fat"), (F.col("w") * (1 - F.col("b") / 100)).alias("lean"))


def recomposition(masses: DataFrame, keys: list[str], days: int = 56) -> DataFrame:
    """Change of lean and fat mass over the last ``days``, how much of it is wanted, and a verdict."""
    last = F.max("date").over(Window.partitionBy(*keys))
    every = F.count("*").over(Window.partitionBy(*keys))
    recent = masses.withColumn("_last", last).withColumn("_n", every).where((F.col("_n") >= 4) & (F.col("date") >= F.date_sub("_last", days)))
    up, down = ordered(keys), Window.partitionBy(*keys).orderBy(F.desc("date"))
    placed = recent.withColumn("a", F.row_number().over(up)).withColumn("z", F.row_number().over(down))
    first, end = F.col("a") <= 3, F.col("z") <= 3
    means = placed.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.avg(F.when(end, F.col("lean"))) - F.avg(F.when(first, F.col("lean")))).alias("delta_lean"),
        (F.avg(F.when(end, F.col("fat"))) - F.avg(F.when(first, F.col("fat")))).alias("delta_fat"),
    ).where("n >= 3")
    lean, fat = F.col("delta_lean"), F.col("delta_fat")
    total = F.abs(lean) + F.abs(fat)
    quality = F.when(total < 0.05, 50.0).otherwise(clamp(50 + F.try_divide(lean - fat, total) * 50, 0, 100))
    verdict = (
        F.when((fat < -0.2) & (lean >= -0.1), "recomposing").when((fat < -0.2) & (lean < -0.1), "losing both")
        .when((fat >= 0.2) & (lean > 0.2), "gaining both").when(fat >= 0.2, "gaining fat").otherwise("holding")
    )
    return means.select(*keys, "delta_lean", "delta_fat", quality.alias("quality"), verdict.alias("verdict"))


def e1rm() -> Column:
    """Estimated one-rep maximum of a set."""
    return F.col("weight_kg") * (1 + F.col("reps") / 30.0)


def heavy_sets(sets: DataFrame) -> DataFrame:
    return sets.where((F.col("weight_kg") > 0) & F.col("reps").between(1, 12))


def daily_strength(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Volume, sets, reps, hard sets and heaviest set of each day, as metric rows; zeros are left out."""
    days = sets.groupBy(*keys, "date").agg(
        F.sum(F.col("weight_kg") * F.col("reps")).alias("training_volume_kg"), F.count("*").cast("double").alias("sets_count"), F.sum("reps").cast("double").alias("reps_total"),
        F.count_if(F.col("rpe") >= 7).cast("double").alias("hard_sets"), F.max("weight_kg").alias("top_set_kg"),
    )
    names = ["training_volume_kg", "sets_count", "reps_total", "hard_sets", "top_set_kg"]
    return days.unpivot([*keys, "date"], names, "metric_key", "value").where("value <> 0")


def main_lifts(sets: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """The exercises with most heavy sets of each key (ties by name)."""
    counted = heavy_sets(sets).groupBy(*keys, "exercise").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "exercise")
    return counted.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select(*keys, "exercise")


def strength_index(sets: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """Sum over the main lifts of the best estimate so far, on every day that has one of them."""
    best = heavy_sets(sets).join(main_lifts(sets, keys, most), [*keys, "exercise"], "left_semi").groupBy(*keys, "exercise", "date").agg(F.max(e1rm()).alias("best"))
    so_far = ordered([*keys, "exercise"]).rowsBetween(Window.unboundedPreceding, 0)
    running = best.withColumn("top", F.max("best").over(so_far))
    # The index moves by what each lift gains over its own best before.
    gain = running.withColumn("gain", F.col("top") - F.coalesce(F.lag("top").over(ordered([*keys, "exercise"])), F.lit(0.0)))
    days = gain.groupBy(*keys, "date").agg(F.sum("gain").alias("gain"))
    return days.select(*keys, "date", F.sum("gain").over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def exercise_progress(sets: DataFrame, keys: list[str], today: str, days: int = 180, most: int = 12) -> DataFrame:
    """Sessions, best estimate, heaviest set and volume of the exercises with most volume."""
    recent = sets.where((F.col("date") > F.date_sub(F.lit(today).cast("date"), days)) & (F.col("weight_kg") > 0))
    found = recent.groupBy(*keys, "exercise").agg(
        F.countDistinct("date").alias("sessions"), F.max(F.when(F.col("reps").between(1, 12), e1rm())).alias("best_e1rm"), F.max("weight_kg").alias("heaviest"),
        F.sum(F.col("weight_kg") * F.col("reps")).alias("volume"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("volume", 3)), "exercise")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def strength_sessions(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions from set rows: the logged minutes if they are possible, else three minutes a set within 20 to 180."""
    found = sets.groupBy(*keys, "date", "session_name").agg(F.max("session_min").alias("mins"), F.count("*").alias("n_sets"), F.min("started_at").alias("started_at"))
    duration = F.when((F.col("mins") > 0) & (F.col("mins") <= 240), F.col("mins")).otherwise(clamp((3 * F.col("n_sets")).cast("double"), 20, 180))
    return found.select(*keys, "date", "session_name", duration.alias("duration_min"), "n_sets", "started_at", F.lit("STRENGTH_TRAINING").alias("type"))

"""The ten analysis tools: one function each, from resolved series to small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vocab import PLAUSIBLE_RANGES, is_derived_pair
from tidemark.operators import forecast as C
from tidemark.operators import inference as I
from tidemark.operators import relations as R
from tidemark.operators import series as S
from tidemark.operators import store as T
from tidemark.operators import training as K
from tidemark.operators import trend as N
from tidemark.operators.relational import newest


def clamped(days: int | None, default: int, low: int, high: int) -> int:
    return min(max(days or default, low), high)


def window(series: DataFrame, today: str, days: int) -> DataFrame:
    day = F.lit(today).cast("date")
    return series.where((F.col("date") >= F.date_sub(day, days)) & (F.col("date") <= day))


def list_metrics(store: DataFrame, defs: DataFrame, today: str) -> DataFrame:
    """Inventory of every metric with its label, unit and category, the most recorded first."""
    found = T.inventory(store, T.resolve(store), today).join(F.broadcast(defs.select(F.col("key").alias("metric_key"), "label", "unit", "category")), "metric_key", "left")
    return found.withColumn("label", F.coalesce("label", "metric_key")).orderBy(F.desc("n"), "user_id", "metric_key")


def describe_metric(series: DataFrame, keys: list[str], today: str) -> DataFrame:
    """Distribution, recent means before today and staleness."""
    day = F.lit(today).cast("date")
    avg = lambda n: F.avg(F.when((F.col("date") > F.date_sub(day, n)) & (F.col("date") < day), F.col("value")))
    recent = series.groupBy(*keys).agg(avg(7).alias("avg7"), avg(28).alias("avg28"), avg(90).alias("avg90"), F.min("date").alias("first"), (F.max("date") < F.date_sub(day, 10)).alias("stale"))
    return I.describe(series, keys).drop("mad").join(recent, keys)


def analyse_metric(series: DataFrame, keys: list[str], today: str, days: int | None = None) -> dict[str, DataFrame]:
    """Trend, coverage, change points, last outliers and weekdays of the window; series below five points are left out."""
    days = clamped(days, 180, 14, 1095)
    seen = window(series, today, days)
    enough = seen.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 5").select(*keys)
    seen = seen.join(enough, keys, "left_semi")
    outliers = newest(S.anomalies(seen, keys), keys, 6, [F.desc("date")])
    day = F.lit(today).cast("date")
    covered = seen.groupBy(*keys).agg(F.count("*").alias("observed")).withColumn("days", F.lit(days + 1)).withColumn("ratio", F.least(F.lit(1.0), F.col("observed") / (days + 1)))
    trend = N.trends(seen, keys).withColumn("per_week", F.col("sen_slope_per_day") * 7).withColumn("as_of", day)
    return {"trend": trend, "coverage": covered, "change_points": N.change_points(seen, keys), "outliers": outliers, "weekday": S.weekday_profile(seen, keys).where("delta IS NOT NULL")}


def compare_metrics(series: DataFrame, outcome: str, influence: str, today: str, days: int | None = None) -> dict[str, DataFrame]:
    """Correlations of the outcome with the influence 0 to 7 days before, the strongest, and the split at it."""
    if is_derived_pair(outcome, influence):
        raise ValueError(f"{outcome} and {influence} are related by construction")
    seen = window(series, today, clamped(days, 180, 21, 1095))
    pairs = R.all_lags(seen.where(F.col("metric_key") == influence), seen.where(F.col("metric_key") == outcome), "driver", "target", 7)
    lags = R.lagged_correlation(pairs, ["target", "driver", "lag"]).withColumn("significant", F.col("p") < 0.05)
    best = R.best_lag(lags, ["target", "driver"])
    split = R.behaviour_split(pairs.join(F.broadcast(best.select("target", "driver", "lag")), ["target", "driver", "lag"], "left_semi"), ["target", "driver", "lag"])
    return {"lags": lags, "strongest": best, "split": split}


def find_drivers(series: DataFrame, metric: str, today: str, days: int | None = None, higher_is_better: bool | None = None) -> DataFrame:
    seen = window(series, today, clamped(days, 365, 30, 1095))
    enough = seen.groupBy("metric_key").agg(F.count("*").alias("n")).where("n >= 20").select("metric_key")
    return R.drivers(seen.join(enough, "metric_key", "left_semi"), [metric], higher_better={metric: higher_is_better})


def forecast_metric(series: DataFrame, metric: str, horizon: int | None = None, target: float | None = None, direction: str = "increase", today: str | None = None) -> dict[str, DataFrame]:
    horizon = clamped(horizon, 60, 7, 365)
    one = series.where(F.col("metric_key") == metric)
    out = {"bands": C.forecasts(one, ["metric_key"], horizon, bounds=PLAUSIBLE_RANGES)}
    if target is not None and today is not None:
        import datetime

        end = datetime.date.fromisoformat(today) + datetime.timedelta(days=horizon)
        out["target"] = C.projections(one, ["metric_key"], {metric: (target, direction)}, end.isoformat(), today, PLAUSIBLE_RANGES)
    return out


def get_series(series: DataFrame, metric: str, today: str, days: int | None = None) -> DataFrame:
    """Means over buckets, about forty points."""
    days = clamped(days, 180, 14, 1095)
    return S.buckets(window(series.where(F.col("metric_key") == metric), today, days), ["metric_key"], days).select("date", "value")


def get_workouts(workouts: DataFrame, daily: DataFrame, today: str, days: int | None = None, most: int = 60) -> DataFrame:
    """The last sessions of each user with their day's load."""
    day = F.lit(today).cast("date")
    recent = newest(workouts.where(F.col("date") > F.date_sub(day, clamped(days, 60, 7, 730))), ["user_id"], most, [F.desc("date"), F.desc("external_id")])
    return recent.join(daily.select("user_id", "date", "load"), ["user_id", "date"], "left")


def get_strength(sets: DataFrame, keys: list[str], today: str, days: int | None = None) -> DataFrame:
    return K.exercise_progress(sets, keys, today, clamped(days, 180, 14, 1095))


def get_notes(entries: DataFrame, today: str | None, most: int = 25, days: int | None = None) -> DataFrame:
    """The last dated notes of each user, cut to 400 characters (ties by id)."""
    seen = entries.where("body IS NOT NULL")
    if today is not None:
        seen = seen.where(F.col("date") > F.date_sub(F.lit(today).cast("date"), clamped(days, 60, 7, 365)))
    w = Window.partitionBy("user_id").orderBy(F.desc("date"), "id")
    return seen.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select("user_id", "date", "id", F.substring("body", 1, 400).alias("note"))

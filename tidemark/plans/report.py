"""The full report: goals, snapshots, readiness, recomposition, load, drivers, events and data health of every user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vocab import DRIVER_CANDIDATES, WATCHED
from tidemark.operators import goals as G
from tidemark.operators import relations as R
from tidemark.operators import series as S
from tidemark.operators import store as T
from tidemark.operators import training as K
from tidemark.operators import trend as N
from tidemark.operators.relational import newest, together

USER, KEYS = ["user_id"], ["user_id", "metric_key"]
MODEL = ("ctl", "atl", "tsb", "acwr")


def snapshots(series: DataFrame, keys: list[str], today: str) -> DataFrame:
    """Latest value, means of the last 7 and 28 days, change against the 7 before, trend of the last 60 points."""
    day = F.lit(today).cast("date")
    after = lambda n: F.col("date") > F.date_sub(day, n)
    avg = lambda c: F.avg(F.when(c, F.col("value")))
    recent = series.where(F.col("date") >= F.date_sub(day, 180))
    rows = recent.groupBy(*keys).agg(F.max_by("value", "date").alias("latest"), F.max("date").alias("latest_date"), avg(after(7)).alias("avg7"), avg(after(14) & ~after(7)).alias("prior7"), avg(after(28)).alias("avg28"))
    last60 = recent.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))).where("_k <= 60")
    trend = N.trends(last60, keys).select(*keys, F.col("direction").alias("trend"))
    delta = F.try_divide(F.col("avg7") - F.col("prior7"), F.nullif(F.abs("prior7"), F.lit(0.0))) * 100
    rows = rows.withColumn("delta_pct", delta).drop("prior7").join(trend, keys, "left")
    return rows.withColumns({c: F.round(c, 6) for c in ("latest", "avg7", "avg28", "delta_pct")})


def since(points: DataFrame, today: str, days: int = 365) -> DataFrame:
    day = F.lit(today).cast("date")
    return points.where(F.col("date").between(F.date_sub(day, days), day))


def at_least(points: DataFrame, n: int) -> DataFrame:
    """The points of series that have ``n`` of them."""
    return points.join(points.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*KEYS), KEYS, "left_semi")


def watched(points: DataFrame, targets: DataFrame, today: str) -> DataFrame:
    """The last year of the metrics that a user's goals name and of the usual ones, where there are 25 points."""
    recent, usual = since(points, today), F.col("metric_key").isin(*WATCHED)
    of_goals = recent.where(~usual).join(targets.select(*KEYS).distinct(), KEYS, "left_semi")
    return at_least(recent.where(usual).unionByName(of_goals), 25)


def events(series: DataFrame, today: str, most: int = 6) -> DataFrame:
    """The newest change points of every user, and the newest anomalies of the last 21 days."""
    points = N.change_points(series, KEYS, most=2).select(*KEYS, "date", F.lit("change").alias("kind"), F.col("delta").alias("size"))
    odd = S.anomalies(series, KEYS).where(F.col("date") > F.date_sub(F.lit(today).cast("date"), 21)).select(*KEYS, "date", F.lit("anomaly").alias("kind"), F.col("z").alias("size"))
    order = [F.desc("date"), F.col("metric_key")]
    return together([newest(points, USER, most, order), newest(odd, USER, most, order)])


def condition(points: DataFrame, today: str) -> DataFrame:
    """(user_id, name, value): the latest readiness and load model, how long it still warms up, monotony and strain."""
    recent = since(points, today)
    of = lambda key, c: F.when(F.col("metric_key") == key, F.col(c))
    latest = recent.where(F.col("metric_key").isin("readiness", *MODEL)).groupBy(*USER).agg(
        *(F.max_by(of(k, "value"), of(k, "date")).alias(k) for k in ("readiness", *MODEL)), (F.date_diff(F.lit(today).cast("date"), F.min(of("ctl", "date"))) + 1).alias("_days")
    )
    latest = latest.withColumn("warmup_days", F.greatest(F.lit(0), 42 - F.coalesce("_days", F.lit(0))).cast("double"))
    week = K.monotony(recent.where("metric_key = 'training_load'").select(*USER, "date", F.col("value").alias("load")), USER)
    named = lambda df, names: df.select(*USER, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names))).alias("r")).select(*USER, "r.*")
    return together([named(latest, ("readiness", *MODEL, "warmup_days")), named(week, ("monotony", "strain"))]).where("value IS NOT NULL")


def body(points: DataFrame, today: str) -> DataFrame:
    """Recomposition of every user from the last year's weight and body fat."""
    of = lambda key: since(points, today).where(F.col("metric_key") == key).select(*USER, "date", "value")
    return K.recomposition(K.body_composition(of("weight_kg"), of("body_fat_pct"), USER), USER)


def explained(points: DataFrame, scored: DataFrame, today: str, most: int = 6) -> DataFrame:
    """The strongest drivers of each user's first target of 20 observations, or of readiness where there is none."""
    recent = since(points, today)
    first = scored.where("observations >= 20").groupBy(*USER).agg(F.min(F.struct("goal_id", "metric_key")).alias("t")).select(*USER, F.col("t.metric_key").alias("metric_key"))
    ready = recent.where("metric_key = 'readiness'").groupBy(*KEYS).agg(F.count("*").alias("n")).where("n >= 25").select(*KEYS)
    chosen = first.unionByName(ready.join(first, USER, "left_anti"))
    target = at_least(recent.join(chosen, KEYS, "left_semi"), 20)
    candidates = at_least(recent.where(F.col("metric_key").isin(*DRIVER_CANDIDATES)), 20)
    found = R.drivers(candidates, target, by=tuple(USER))
    return newest(found, USER, most, [F.desc(F.round("contribution", 12)), F.col("driver")])


def full_report(points: DataFrame, store: DataFrame, goals: DataFrame, targets: DataFrame, today: str) -> DataFrame:
    """(user_id, section, name, label, value): all sections of all users, from one resolved store.

    ``points`` has derived metrics too; ``store`` is the raw store, for data health. Every goal
    of a user has its row, with the others' status as label.
    """
    inside = targets.join(points, KEYS).where(F.col("date").between(F.col("start_date"), F.lit(today).cast("date")))
    smooth = S.ewma(S.grid(inside, G.TARGET), G.TARGET, 7.0).groupBy(*G.TARGET).agg(F.max_by("ewma", "date").alias("smoothed"))
    scored = G.score_targets(targets, points, smooth, today)
    index = G.goal_index(scored, goals, today)
    state = condition(points, today)
    ready = F.col("name") == "readiness"
    row = lambda df, section, name, label, value: df.select(*USER, F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), label.cast("string").alias("label"), F.round(F.col(value).cast("double"), 6).alias("value"))
    nothing = F.lit(None)
    return together(
        [
            row(index, "goal", "goal_id", F.col("status"), "index"),
            row(scored, "target", "metric_key", F.col("status"), "progress"),
            row(snapshots(points, KEYS, today), "snapshot", "metric_key", F.col("trend"), "latest"),
            row(state.where(ready), "readiness", "name", nothing, "value"),
            row(body(points, today), "recomposition", "verdict", nothing, "quality"),
            row(state.where(~ready), "load", "name", nothing, "value"),
            row(explained(points, scored, today), "driver", "driver", F.concat_ws(" ", "direction", "target"), "contribution"),
            row(events(watched(points, targets, today), today), "event", "metric_key", F.concat_ws(" ", "kind", F.col("date").cast("string")), "size"),
            row(T.data_health(store, today), "data_health", "metric_key", F.col("source"), "coverage"),
        ]
    )

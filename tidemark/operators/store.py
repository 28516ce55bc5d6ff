"""The long metric store: precedence of sources, upserts, inventory and data health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import finite
from tidemark.functions.vocab import CORE_METRICS, SOURCE_PRIORITY

KEY = ("user_id", "metric_key")


def precedence(source: str = "source", ranks: dict[str, int] | None = None) -> Column:
    """The rank of a source; 0 for one that is not known."""
    ranks = SOURCE_PRIORITY if ranks is None else ranks
    return reduce(lambda c, kv: c.when(F.col(source) == kv[0], kv[1]), list(ranks.items())[1:], F.when(F.col(source) == next(iter(ranks)), next(iter(ranks.values())))).otherwise(0)


def resolve(store: DataFrame, order: str = "seq") -> DataFrame:
    """One value for each user, metric and day: of the source that ranks highest, the first by ``order``.

    A pre-aggregated minimum, so a day with many rows is reduced before it is moved.
    """
    best = F.min(F.struct((-precedence()).alias("p"), F.col(order).alias("o"), "value", "source")).alias("b")
    return store.groupBy(*KEY, "date").agg(best).select(*KEY, "date", "b.value", "b.source")


def upsert(store: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """``store`` with a batch written over it: the last valid row of a key in the batch wins over the store's."""
    valid = batch.where(finite("value") & F.col("date").isNotNull())
    keys = ["user_id", "date", "metric_key", "source"]
    newest = valid.groupBy(*keys).agg(F.max_by("value", order).alias("value"))
    both = store.select(*keys, "value", F.lit(0).alias("_new")).unionByName(newest.select(*keys, "value", F.lit(1).alias("_new")))
    return both.groupBy(*keys).agg(F.max_by("value", "_new").alias("value"))


def last_of_batch(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key, by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def in_range(points: DataFrame, start: str | None = None, end: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Points from ``start`` to ``end``, both included, of the named metrics."""
    if start:
        points = points.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        points = points.where(F.col("date") <= F.lit(end).cast("date"))
    return points.where(F.col("metric_key").isin(keys)) if keys else points


def without_manual(store: DataFrame, gone: DataFrame) -> DataFrame:
    """``store`` without the manual values named by (user_id, date, metric_key)."""
    manual = gone.select("user_id", "date", "metric_key", F.lit("manual").alias("source"))
    return store.join(manual, ["user_id", "date", "metric_key", "source"], "left_anti")


def inventory(store: DataFrame, resolved: DataFrame, today: str) -> DataFrame:
    """What each user has of each metric: raw rows, span, coverage, mean of the last days before today, staleness."""
    day = F.lit(today).cast("date")
    recent = resolved.where((F.col("date") >= F.date_sub(day, 8)) & (F.col("date") < day)).groupBy(*KEY).agg(F.avg("value").alias("avg7"))
    rows = store.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    span = F.greatest(F.lit(1), F.date_diff("last", "first") + 1)
    return rows.join(recent, list(KEY), "left").select(*KEY, "n", "first", "last", F.round(F.col("n") / span, 6).alias("coverage"), F.round("avg7", 6).alias("avg7"), (F.col("last") < F.date_sub(day, 10)).alias("stale"))


def data_health(store: DataFrame, today: str, days: int = 90, most: int = 40) -> DataFrame:
    """The metrics with most rows lately: last day, the source of the last row, coverage. ``most`` a user."""
    day = F.lit(today).cast("date")
    rows = store.where(F.col("date") > F.date_sub(day, days)).groupBy(*KEY).agg(
        F.max("date").alias("last"), F.max_by("source", F.struct("date", precedence(), "seq")).alias("source"), F.count("*").alias("n")
    )
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "metric_key")))
    return ranked.where(F.col("_rank") <= most).select(*KEY, "last", "source", "n", F.round(F.least(F.lit(1.0), F.col("n") / float(days)), 6).alias("coverage"))


def definitions(spark) -> DataFrame:
    """The metric dictionary."""
    return spark.createDataFrame(CORE_METRICS, "key string, label string, unit string, category string, higher_is_better boolean, agg string, precision int").withColumn("is_custom", F.lit(False))


def ensure_definitions(defs: DataFrame, keys: DataFrame) -> DataFrame:
    """``defs`` with a default entry for every ``metric_key`` it does not have."""
    new = keys.select(F.col("metric_key").alias("key")).distinct().join(defs, "key", "left_anti")
    return defs.unionByName(
        new.select(
            "key",
            F.initcap(F.replace("key", F.lit("_"), F.lit(" "))).alias("label"),
            F.lit(None).cast("string").alias("unit"),
            F.lit("custom").alias("category"),
            F.lit(None).cast("boolean").alias("higher_is_better"),
            F.lit("mean").alias("agg"),
            F.lit(2).alias("precision"),
            F.lit(True).alias("is_custom"),
        )
    )


def resample(series: DataFrame, unit: str, defs: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Points per day, week or month by each metric's own aggregate (mean where it has none)."""
    held = series.join(F.broadcast(defs.select(F.col("key").alias("metric_key"), "agg")), "metric_key", "left")
    by = F.to_date(F.date_trunc(unit, "date")).alias("period")
    found = held.groupBy(*keys, by).agg(F.first("agg", True).alias("agg"), F.avg("value").alias("m"), F.sum("value").alias("s"), F.max_by("value", "date").alias("l"), F.max("value").alias("x"), F.min("value").alias("n"))
    kind = F.coalesce("agg", F.lit("mean"))
    return found.select(*keys, F.col("period").alias("date"), F.when(kind == "sum", F.col("s")).when(kind == "last", F.col("l")).when(kind == "max", F.col("x")).when(kind == "min", F.col("n")).otherwise(F.col("m")).alias("value"))

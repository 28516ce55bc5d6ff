"""Where a value stands among published population anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import half_up
from tidemark.functions.vocab import ANCHORS, DECADES, HIGHER_IS_BETTER, LIFTS, PERCENTILES


def anchors(spark: SparkSession) -> DataFrame:
    """(metric, sex, decade, pct, value, higher_is_better) of all anchors."""
    rows = [(m, sex, d, float(p), float(v), HIGHER_IS_BETTER[m]) for m, by_sex in ANCHORS.items() for sex, tables in by_sex.items() for d, values in zip(DECADES, tables, strict=True) for p, v in zip(PERCENTILES, values, strict=True)]
    return spark.createDataFrame(rows, "metric string, sex string, decade string, pct double, value double, higher_is_better boolean")


def lift_anchors(spark: SparkSession) -> DataFrame:
    rows = [(lift, pattern, sex, float(p), float(v)) for lift, (pattern, by_sex) in LIFTS.items() for sex, values in by_sex.items() for p, v in zip(PERCENTILES, values, strict=True)]
    return spark.createDataFrame(rows, "lift string, pattern string, sex string, pct double, value double")


def decade(age: Column) -> Column:
    return F.when(age < 30, "20s").when(age < 40, "30s").when(age < 50, "40s").when(age < 60, "50s").when(age < 70, "60s").otherwise("70s")


def band(p: Column) -> Column:
    return (
        F.when(p >= 90, "top 10%").when(p >= 75, "top quarter").when(p >= 60, "above average")
        .when(p >= 40, "around average").when(p >= 25, "below average").otherwise("bottom quarter")
    )


def percentiles(values: DataFrame, points: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """``keep``, ``measured`` with percentile, capped end and band: linear between anchors, flat outside.

    ``points``: anchors with ``pct``, ``value``, ``higher_is_better``, found by the columns ``by``.
    """
    w = Window.partitionBy(*by).orderBy("value")
    bands = points.withColumn("v2", F.lead("value").over(w)).withColumn("p2", F.lead("pct").over(w)).withColumn("place", F.row_number().over(w))
    joined = values.join(F.broadcast(bands), by)
    v, m = F.col("value"), F.col("measured")
    low, high = (F.col("place") == 1) & (m <= v), F.col("v2").isNull() & (m >= v)
    between = (m > v) & (m < F.col("v2")) | ((m == v) & F.col("v2").isNotNull() & (F.col("place") > 1))
    hit = joined.where(low | high | between)
    raw = F.when(low | high, F.col("pct")).otherwise(F.col("pct") + F.try_divide(m - v, F.col("v2") - v) * (F.col("p2") - F.col("pct")))
    better = F.col("higher_is_better")
    capped = F.when(low, F.when(better, "low").otherwise("high")).when(high, F.when(better, "high").otherwise("low"))
    found = hit.select(*keep, "measured", half_up(F.when(better, raw).otherwise(100 - raw)).cast("int").alias("percentile"), capped.alias("capped"))
    return found.withColumn("band", band(F.col("percentile")))


def recent_mean(points: DataFrame, keys: list[str], today: str, days: int = 180, last: int = 28, least: int = 3) -> DataFrame:
    """Mean of the last ``last`` points of the window before today, with the last day and whether it is stale."""
    day = F.lit(today).cast("date")
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    seen = points.where((F.col("date") >= F.date_sub(day, days)) & (F.col("date") < day)).withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    found = seen.where((F.col("_n") >= least) & (F.col("_k") <= last)).groupBy(*keys).agg(F.avg("value").alias("measured"), F.max("date").alias("last_date"))
    stale = F.date_diff(day, "last_date")
    return found.withColumn("stale_days", stale).withColumn("stale", stale > 45)


def best_lifts(best: DataFrame, lifts: DataFrame, keys: list[str]) -> DataFrame:
    """The exercise that stands for each lift: by pattern, a barbell variant before others, then the largest estimate."""
    names = lifts.select("lift", "pattern").distinct()
    matched = best.join(F.broadcast(names), F.expr("exercise RLIKE pattern"))
    w = Window.partitionBy(*keys, "lift").orderBy(F.desc(F.col("exercise").rlike("(?i)barbell")), F.desc("e1rm"), "exercise")
    return matched.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "pattern")

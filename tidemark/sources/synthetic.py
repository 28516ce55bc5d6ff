"""Correlated demonstration data: six months of one person's metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def noise(seed: int, *, of: str = "i") -> Column:
    """A repeatable bell-shaped number for each row: four uniforms from hashes."""
    draw = lambda k: F.pmod(F.xxhash64(of, F.lit(seed * 10 + k)), F.lit(1_000_000)) / 1e6
    return (draw(0) + draw(1) + draw(2) + draw(3) - 2) * 1.2


def demo(spark: SparkSession, days: int = 187, end: str = "2024-06-30", user: int = 1) -> DataFrame:
    """Long rows (user_id, date, metric_key, value, source); sleep drives the next day's deep work."""
    base = spark.range(days).select(F.col("id").alias("i"), F.date_add(F.date_sub(F.lit(end).cast("date"), days - 1), F.col("id").cast("int")).alias("date"), (F.col("id") - 1).alias("before"))
    sleep = lambda of: 7.2 + 0.6 * noise(1, of=of)
    metrics = {
        "weight_kg": 84 - 0.02 * F.col("i") + 0.4 * noise(2), "body_fat_pct": 21 - 0.015 * F.col("i") + 0.3 * noise(3), "sleep_hours": sleep("i"), "hrv_ms": 55 + 6 * noise(4) + 3 * noise(1), "resting_hr": 58 - 0.01 * F.col("i") - 2 * noise(4) + noise(5),
        "steps": F.round(9000 + 2500 * noise(6)), "deep_work_hours": 3 + 0.9 * (sleep("before") - 7.2) + 0.35 * noise(7), "mood": F.greatest(F.lit(1.0), F.least(F.lit(10.0), 6.5 + noise(8))),
    }
    wide = base.select("date", *[v.cast("double").alias(k) for k, v in metrics.items()])
    return wide.unpivot(["date"], list(metrics), "metric_key", "value").select(F.lit(user).cast("long").alias("user_id"), "date", "metric_key", F.round("value", 3).alias("value"), F.lit("google_health").alias("source"))

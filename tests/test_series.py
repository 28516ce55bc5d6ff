"""Calibration of the trend tests and change points, the load model, forecasts, drivers and null contracts."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, goals, inference, relations, series, store, training, trend
from tidemark.sources import synthetic

START = datetime.date(2025, 1, 1)


class Generator:
    """The linear congruential generator of the calibration series, in doubles masked to 31 bits."""

    def __init__(self, seed):
        self.state = seed

    def uniform(self):
        self.state = int(self.state * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        return self.state / 0x7FFFFFFF

    def bell(self):
        return (self.uniform() + self.uniform() + self.uniform() + self.uniform() - 2) * 1.2


def walk(seed, n=180, slope=0.0):
    g, out, v = Generator(seed), [], 50.0
    for i in range(n):
        v += g.bell()
        out.append(v + slope * i)
    return np.array(out)


def noise(seed, n=180):
    g = Generator(seed)
    return np.array([50 + g.bell() * 3 for _ in range(n)])


def significant(y):
    return trend.trend_of(np.arange(len(y)), y)["significant"]


def test_trend_on_nothing():
    assert sum(significant(walk((s + 1) * 7919)) for s in range(200)) <= 10
    assert sum(significant(noise((s + 1) * 104729)) for s in range(200)) <= 15


def test_trend_has_power():
    assert sum(significant(walk((s + 1) * 31337, slope=0.35)) for s in range(40)) >= 34
    assert sum(significant(walk((s + 1) * 31337, slope=0.12)) for s in range(40)) <= 30


def test_change_points():
    assert sum(bool(trend.change_points_of(walk((s + 1) * 7919))) for s in range(200)) <= 12
    assert sum(bool(trend.change_points_of(noise((s + 1) * 104729))) for s in range(200)) <= 10
    found = 0
    for s in range(40):
        y = noise((s + 1) * 6151)
        y[90:] += 18
        found += any(abs(c["index"] - 90) <= 10 for c in trend.change_points_of(y))
    assert found >= 34
    # A split without any spread has no t; the one beside it is taken.
    assert [c["index"] for c in trend.change_points_of(np.r_[np.zeros(20), np.ones(20)])] == [19]


def frame(spark, values, start=START, key="m", user=1):
    rows = [(user, key, start + datetime.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "user_id long, metric_key string, date date, value double")


def load_of(spark, values):
    rows = frame(spark, values, datetime.date(2026, 1, 1)).withColumnRenamed("value", "load")
    return training.training_load(rows, ["user_id"]).orderBy("date").toPandas()


def test_training_load(spark):
    steady = load_of(spark, [100] * 60)
    assert steady[["ctl", "atl"]].to_numpy() == pytest.approx(100)
    assert steady["acwr"].astype(float).max() < 1.5 and steady["tsb"].dropna().astype(float).min() > -25 and pd.isna(steady["tsb"][0])
    assert not steady["established"][41] and steady["established"][42]
    assert float(load_of(spark, [0] * 42 + [150] * 18)["acwr"].iloc[-1]) > 1.5
    rest = load_of(spark, [100] * 60 + [0] * 60)
    assert rest["ctl"].iloc[-1] < rest["ctl"].iloc[59] and rest["atl"].iloc[-1] < 1
    spike = load_of(spark, [100] * 55 + [400] * 5)
    assert float(spike["acwr"].iloc[-1]) > 1.3


def test_short_and_empty_series(spark):
    nothing, three = frame(spark, []), frame(spark, [1, 2, 3])
    keys = ["user_id", "metric_key"]
    for rows in (nothing, three):
        assert trend.trends(rows, keys).count() == 0
        assert trend.change_points(rows, keys).count() == 0
        assert forecast.forecasts(rows, keys, 5).count() == 0
        assert series.anomalies(rows, keys).count() == 0
    assert inference.describe(frame(spark, [4.0]), keys).first()["sd"] is None
    flat = trend.trends(frame(spark, [5] * 20), keys).first()
    assert flat["direction"] == "flat" and flat["mk_p"] == 1.0 and flat["r2"] == 0.0
    gaps = series.interpolated(frame(spark, [None, 1, None, None, 4, None]), keys).orderBy("date").collect()
    assert [r["filled"] for r in gaps] == [1, 2, 3, 4, 4]
    smooth = series.ewma(frame(spark, [10, None, 20]), keys, 1.0).orderBy("date").collect()
    assert [r["ewma"] for r in smooth] == [10, 10, 15]


def test_partitions_do_not_matter(spark):
    rows = frame(spark, walk(7).tolist()).unionByName(frame(spark, noise(9).tolist(), key="n"))
    keys = ["user_id", "metric_key"]
    one, many = (sorted(map(tuple, forecast.forecasts(rows.repartition(n), keys, 10).collect())) for n in (1, 17))
    assert one == many


def test_forecast_respects_bounds_and_direction():
    y = np.linspace(90, 99.5, 60)
    days = np.arange(60)
    _, paths = forecast.forecast_of(days, y, 60, bounds=(0.0, 100.0))
    assert paths.max() <= 100
    up = forecast.project(days, y, 95.0, "increase", 90, 60)
    assert up["probability"] > 0.9 and forecast.project(days, y, 95.0, "increase", 50, 60) is None
    assert len(forecast.steps(0.05, 0.95, 0.05)) == 18 and len(forecast.steps(0.0, 0.5, 0.05)) == 11
    assert np.all((forecast.uniforms(123, 1000) >= 0) & (forecast.uniforms(123, 1000) < 1))


def test_planted_driver_is_found(spark):
    rows = synthetic.demo(spark)
    found = relations.drivers(rows, ["deep_work_hours"]).orderBy(F.desc(F.abs("coefficient"))).first()
    assert (found["driver"], found["lag"], found["direction"]) == ("sleep_hours", 1, "raises")


def test_store_rules(spark):
    day = START
    rows = spark.createDataFrame([(1, day, "m", 5.0, "csv", 1), (1, day, "m", 7.0, "manual", 2), (1, day, "m", 9.0, "mystery", 3), (1, day, "n", float("nan"), "csv", 4)], "user_id long, date date, metric_key string, value double, source string, seq long")
    assert store.resolve(rows).where("metric_key = 'm'").first()["value"] == 7.0
    kept = store.upsert(rows.where("seq = 1"), rows.where("seq >= 2").withColumn("source", F.lit("csv")))
    assert [tuple(r) for r in kept.select("metric_key", "value").collect()] == [("m", 9.0)]


def test_goal_rules(spark):
    f = lambda b, c, t, d: spark.range(1).select(goals.progress_fraction(*(F.lit(x).cast("double") for x in (b, c, t)), F.lit(d)).alias("p")).first()["p"]
    assert f(10, 15, 20, "increase") == 0.5 and f(20, 15, 10, "decrease") == 0.5 and f(10, 10, 10, "increase") == 1 and f(10, 11, 10, "increase") is None
    assert f(0, 100, 100, "maintain") == 1 and f(None, 1, 2, "increase") is None and f(1, 0.5, 0, "maintain") == 0.5


def test_streaming_upsert(spark, tmp_path):
    from tidemark.sources.versioned import VersionedStore
    from tidemark.streaming import ingest

    schema = "user_id long, date date, metric_key string, value double, source string, seq long"
    source, target = str(tmp_path / "in"), str(tmp_path / "store")
    for seq, value in ((1, 5.0), (2, 6.0)):
        spark.createDataFrame([(1, START, "m", value, "csv", seq)], schema).write.mode("append").parquet(source)
        ingest.start(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "check")).awaitTermination()
    assert [r["value"] for r in VersionedStore(spark, target).read().collect()] == [6.0]

"""A sync of all kinds of API documents: metric rows, sessions, and a log of what each kind gave."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ingest as N
from tidemark.sources.pages import LISTED

SOURCE = "google_health"
USER = ["user_id"]
STAGE = "array<struct<type: string, minutes: string, startTime: string, endTime: string>>"
SLEEP = f"interval struct<startTime: string, endTime: string, startUtcOffset: string>, metadata struct<mainSleep: boolean>, stages {STAGE}, summary struct<minutesAsleep: string, minutesInSleepPeriod: string, stagesSummary: {STAGE}>"
SESSION = "interval struct<startTime: string, endTime: string>, activeDuration string, exerciseType string, displayName string, metricsSummary struct<distanceMillimeters: string, caloriesKcal: string, averageHeartRateBeatsPerMinute: string, elevationGainMeters: string>"


class Synced(NamedTuple):
    """``points`` (user_id, date, metric_key, value, source), ``workouts`` and the ``log`` (user_id, kind, ok, rows, message)."""

    points: DataFrame
    workouts: DataFrame
    log: DataFrame


def failed_kinds(pages: DataFrame) -> DataFrame:
    """(user_id, kind, message) of what broke, the first message of each."""
    return pages.where("message IS NOT NULL").groupBy("user_id", "kind").agg(F.min_by("message", F.struct("window", "page", "message")).alias("message"))


def document_points(documents: DataFrame, start: str, end: str) -> DataFrame:
    """Metric rows of all kinds but sessions, in one pass; the last document of a day wins.

    A listed kind keeps the days from start to end; a rolled-up one has only these.
    """
    kinds = [*N.FIELDS, "active-zone-minutes", "active-minutes"]
    pairs = F.when(F.lit(False), N.extracted(kinds[0], F.col("body")))
    for kind in kinds:
        pairs = pairs.when(F.col("kind") == kind, N.extracted(kind, F.col("body")))
    rows = documents.where(F.col("kind").isin(kinds)).select("user_id", "kind", F.struct("window", "page", "place").alias("order"), N.dated(F.col("day"), pairs).alias("f"))
    inside = F.col("f.date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) | ~F.col("kind").isin(*LISTED)
    return rows.where(F.col("f.date").isNotNull() & F.col("f.value").isNotNull() & inside).groupBy("user_id", "kind", F.col("f.date").alias("date"), F.col("f.metric_key").alias("metric_key")).agg(F.max_by("f.value", "order").alias("value"))


def stage_minutes(night, kind: str):
    """Minutes of a stage: the summary's, else the sum of the intervals."""
    said = F.filter(night["summary"]["stagesSummary"], lambda s: F.upper(s["type"]) == kind)
    spans = F.filter(night["stages"], lambda s: (F.upper(s["type"]) == kind) & s["startTime"].isNotNull() & s["endTime"].isNotNull())
    seconds = lambda t: F.unix_timestamp(F.try_to_timestamp(t))
    measured = F.aggregate(spans, F.lit(0.0), lambda a, s: a + F.coalesce((seconds(s["endTime"]) - seconds(s["startTime"])) / 60.0, F.lit(0.0)))
    return F.when(F.size(said) > 0, F.coalesce(N.api_number(F.get(said, 0)["minutes"]), F.lit(0.0))).otherwise(F.coalesce(measured, F.lit(0.0)))


def sleep_points(documents: DataFrame, start: str, end: str) -> DataFrame:
    """Nightly metrics of the sleep documents that end from start to end."""
    read = documents.where("kind = 'sleep'").select("user_id", "window", "page", "place", F.from_json("body", SLEEP).alias("s"))
    s = F.col("s")
    sessions = read.select(
        "user_id",
        F.struct("window", "page", "place").alias("session_id"),
        F.try_to_timestamp(s["interval"]["startTime"]).alias("start_ts"),
        F.try_to_timestamp(s["interval"]["endTime"]).alias("end_ts"),
        F.coalesce(N.api_number(s["interval"]["startUtcOffset"]), F.lit(0.0)).cast("long").alias("offset_s"),
        F.coalesce(s["metadata"]["mainSleep"], F.lit(False)).alias("is_main"),
        N.api_number(s["summary"]["minutesAsleep"]).alias("minutes_asleep"),
        N.api_number(s["summary"]["minutesInSleepPeriod"]).alias("minutes_in_period"),
        *[stage_minutes(s, k).alias(k.lower()) for k in ("DEEP", "REM", "AWAKE")],
    )
    whole = sessions.where(F.col("start_ts").isNotNull() & F.to_date("end_ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return N.sleep_nights(whole, USER).select("user_id", F.lit("sleep").alias("kind"), "date", "metric_key", "value")


def exercises(documents: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions of the exercise documents; the last document of an id counts."""
    e = F.col("e")
    read = documents.where("kind = 'exercise'").select("user_id", F.struct("window", "page", "place").alias("order"), F.element_at(F.split("name", "/"), -1).alias("external_id"), F.from_json("body", SESSION).alias("e"))
    summary = e["metricsSummary"]
    sessions = read.select(
        "user_id", "order", "external_id",
        F.try_to_timestamp(e["interval"]["startTime"]).alias("start_ts"), F.try_to_timestamp(e["interval"]["endTime"]).alias("end_ts"), N.api_number(e["activeDuration"]).alias("active_s"),
        e["exerciseType"].alias("type"), F.coalesce(e["displayName"], e["exerciseType"], F.lit("Workout")).alias("name"), (N.api_number(summary["distanceMillimeters"]) / 1e6).alias("distance_km"),
        N.api_number(summary["caloriesKcal"]).alias("calories"), N.api_number(summary["averageHeartRateBeatsPerMinute"]).alias("avg_hr"), N.api_number(summary["elevationGainMeters"]).alias("elevation_m"),
    )
    kept = N.exercise_sessions(sessions, start, end)
    columns = ("start_ts", "date", "type", "name", "duration_min", "distance_km", "calories", "avg_hr", "elevation_m")
    last = kept.groupBy("user_id", "external_id").agg(F.max_by(F.struct(*columns), "order").alias("w"))
    return last.select("user_id", "external_id", "w.*", F.lit(SOURCE).alias("source"))


def sync(pages: DataFrame, start: str, end: str) -> Synced:
    """Everything that the pages of a ``tidemark_pages`` read hold.

    A kind that broke for a user gives that user no rows of the kind, and its message in
    the log; all other kinds and users are complete. ``pages`` is read several times, so
    it should be written first where it stands for requests.
    """
    failed = failed_kinds(pages)
    documents = pages.where("body IS NOT NULL").join(failed, ["user_id", "kind"], "left_anti")
    points = document_points(documents, start, end).unionByName(sleep_points(documents, start, end))
    workouts = exercises(documents, start, end)
    counted = points.groupBy("user_id", "kind").agg(F.count("*").alias("rows")).unionByName(workouts.groupBy("user_id").agg(F.count("*").alias("rows")).withColumn("kind", F.lit("exercise")))
    log = pages.select("user_id", "kind").distinct().join(failed, ["user_id", "kind"], "left").join(counted, ["user_id", "kind"], "left")
    log = log.select("user_id", "kind", F.col("message").isNull().alias("ok"), F.coalesce("rows", F.lit(0)).alias("rows"), "message")
    return Synced(points.select("user_id", "date", "metric_key", "value", F.lit(SOURCE).alias("source")), workouts, log)

"""Queries of the paged sync and of the incremental store, with their SQL.

The pages of the sync are made of the events: each event is one document of one of the
kinds, its user one of five, in three pages a request. User 3 may not read weights.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ingest as N
from tidemark.plans import sync
from tidemark.plans import views as V
from tidemark.plans.queries_series import rounded
from tidemark.plans.views import STORE_SQL, scratch, with_sql
from tidemark.registry import register
from tidemark.sources.log import LogSource
from tidemark.sources.pages import KINDS, ROLLED_UP, WINDOW_DAYS, PagedSource, value_key
from tidemark.sources.versioned import VersionedStore

START, END, PAGES_A_REQUEST = "2024-01-01", "2024-01-31", 3
BROKEN = (3, "weight", '{"error": {"code": 403, "message": "insufficient scope"}}')


def fields_of(kind: str) -> str:
    """SQL for the JSON fields of a document's value, which counts ``v``."""
    if kind == "active-zone-minutes":
        return """'"sumInFatBurnHeartZone":"' || v || '","sumInPeakHeartZone":' || v"""
    if kind == "active-minutes":
        return """'"activeMinutesRollupByActivityLevel":[{"activityLevel":"LIGHT","activeMinutesSum":"' || v || '"},{"activityLevel":"VIGOROUS","activeMinutesSum":' || (v + 1) || '}]'"""
    if kind == "sleep":
        night = """'"interval":{"startTime":"' || date_sub(date, 1) || 'T22:00:00Z","endTime":"' || date || 'T06:00:00Z","startUtcOffset":"3600s"},"metadata":{"mainSleep":true},'"""
        return night + """ || '"summary":{"minutesAsleep":"' || (300 + v) || '","minutesInSleepPeriod":"480","stagesSummary":[{"type":"DEEP","minutes":"' || v || '"}]}'"""
    if kind == "exercise":
        return """'"interval":{"startTime":"' || date || 'T10:00:00Z","endTime":"' || date || 'T12:00:00Z"},"activeDuration":"' || (v * 60) || 's","exerciseType":"RUNNING"'"""
    return " || ',' || ".join(f"""'"{names[0]}":"' || (v + {j}) || '"'""" for j, (names, _, _) in enumerate(N.FIELDS[kind]))


def point_of(kind: str) -> str:
    """SQL for a document as the API gives it."""
    civil = """'{"year":' || year(date) || ',"month":' || month(date) || ',"day":' || day(date) || '}'"""
    key, fields = value_key(kind), fields_of(kind)
    if kind in ROLLED_UP:
        return f"""'{{"civilStartTime":{{"date":' || {civil} || '}},"{key}":{{' || {fields} || '}}}}'"""
    if kind.startswith("daily-"):
        return f"""'{{"{key}":{{"date":' || {civil} || ',' || {fields} || '}}}}'"""
    if kind in ("weight", "body-fat", "height"):
        return f"""'{{"{key}":{{"sampleTime":{{"physicalTime":"' || date || 'T07:00:00Z"}},' || {fields} || '}}}}'"""
    return f"""'{{"name":"users/1/{key}/' || event_id || '","{key}":{{' || {fields} || '}}}}'"""


def land(spark, sf: str) -> str:
    """Write the pages; the folder they are in."""
    path = scratch(spark, "pages")
    kinds = F.array(*map(F.lit, KINDS))
    events = V.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 5).alias("user"), F.to_date("ts").alias("date"), F.element_at(kinds, (F.col("event_id") % len(KINDS) + 1).cast("int")).alias("kind"), (F.col("event_id") % 97 + 1).alias("v")
    )
    days = F.lit(0)
    for kind, width in WINDOW_DAYS.items():
        days = F.when(F.col("kind") == kind, F.floor(F.date_diff("date", F.lit(START).cast("date")) / width) * width).otherwise(days)
    point = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {point_of(k)}" for k in KINDS) + " END")
    request = ["kind", "window", "user"]
    placed = events.withColumn("window", F.date_format(F.date_add(F.lit(START).cast("date"), days.cast("int")), "yyyy-MM-dd")).withColumn("point", point)
    placed = placed.withColumn("page", F.ntile(PAGES_A_REQUEST).over(Window.partitionBy(*request).orderBy("event_id")))
    pages = placed.groupBy(*request, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "point"))), lambda p: p["point"]), ",").alias("points"))
    last = F.max("page").over(Window.partitionBy(*request))
    field = F.when(F.col("kind").isin(*ROLLED_UP), "rollupDataPoints").otherwise("dataPoints")
    after = F.when(F.col("page") < last, F.concat(F.lit(',"nextPageToken":"p'), F.col("page") + 1, F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"'), field, F.lit('":['), "points", F.lit("]"), after, F.lit("}"))
    user, kind, error = BROKEN
    said = F.when((F.col("user") == user) & (F.col("kind") == kind) & (F.col("page") == 2), error).otherwise(text)
    token = F.when(F.col("page") == 1, "first").otherwise(F.concat(F.lit("p"), F.col("page")))
    pages.select(*request, token.alias("token"), said.alias("value")).repartition(*request, "token").write.partitionBy(*request, "token").text(path)
    return path


def synced(spark, sf: str) -> sync.Synced:
    """A sync of the landed pages; they are read once and written, as requests would be."""
    PagedSource.register(spark)
    path = scratch(spark, "read")
    spark.read.format("tidemark_pages").options(root=land(spark, sf), start=START, end=END, splits="2", concurrency="16").load().write.parquet(path)
    return sync.sync(spark.read.parquet(path), START, END)


def metrics_sql() -> str:
    """Each metric of each kind: (kind, metric_key, SQL of its value)."""
    rows = [(k, key, f"(v + {j}) * CAST({factor!r} AS DOUBLE)") for k, fields in N.FIELDS.items() for j, (_, key, factor) in enumerate(fields)]
    rows += [("active-zone-minutes", "active_zone_min", "CAST(2 * v AS DOUBLE)"), ("active-minutes", "active_minutes", "CAST(2 * v + 1 AS DOUBLE)"), ("active-minutes", "moderate_vigorous_min", "CAST(v + 1 AS DOUBLE)")]
    parts = [f"SELECT kind, user_id, date, '{key}' AS metric_key, arg_max({value}, event_id) AS value FROM docs WHERE kind = '{k}' GROUP BY 1, 2, 3" for k, key, value in rows]
    nights = (("sleep_hours", "(300 + v) / 60.0"), ("sleep_efficiency", "(300 + v) / 480.0 * 100"), ("deep_sleep_min", "v"), ("sleep_start_hour", "-1"))
    parts += [f"SELECT kind, user_id, date, '{key}', arg_min(CAST({value} AS DOUBLE), event_id) FROM docs WHERE kind = 'sleep' GROUP BY 1, 2, 3" for key, value in nights]
    return "points AS (" + " UNION ALL ".join(parts) + ")"


DOCS_SQL = (
    "every AS (SELECT event_id, user_id % 5 AS user_id, CAST(ts AS DATE) AS date, CASE event_id % "
    + f"{len(KINDS)} "
    + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    + f" END AS kind, event_id % 97 + 1 AS v FROM events), docs AS (SELECT * FROM every WHERE NOT (user_id = {BROKEN[0]} AND kind = '{BROKEN[1]}'))"
)


@register("a25_sync_points", with_sql(DOCS_SQL, metrics_sql()) + "SELECT CAST(user_id AS BIGINT) AS user_id, date, metric_key, round(value, 6) AS value, 'google_health' AS source FROM points")
def a25_points(spark, sf):
    """Metric rows of all kinds but the one that one user may not read."""
    return rounded(synced(spark, sf).points, "value")


@register(
    "a25_sync_workouts",
    with_sql(DOCS_SQL) + "SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS VARCHAR) AS external_id, date, 'RUNNING' AS type, CAST(v AS DOUBLE) AS duration_min, 'google_health' AS source FROM docs WHERE kind = 'exercise'",
)
def a25_workouts(spark, sf):
    return synced(spark, sf).workouts.select("user_id", "external_id", "date", "type", "duration_min", "source")


@register(
    "a25_sync_log",
    with_sql(DOCS_SQL, metrics_sql())
    + f"""SELECT CAST(a.user_id AS BIGINT) AS user_id, a.kind, NOT (a.user_id = {BROKEN[0]} AND a.kind = '{BROKEN[1]}') AS ok, CAST(coalesce(CASE a.kind WHEN 'exercise' THEN a.n ELSE p.n END, 0) AS BIGINT) AS rows,
      CASE WHEN a.user_id = {BROKEN[0]} AND a.kind = '{BROKEN[1]}' THEN '403 weight: insufficient scope' END AS message
    FROM (SELECT user_id, kind, count(*) AS n FROM every GROUP BY 1, 2) a LEFT JOIN (SELECT user_id, kind, count(*) AS n FROM points GROUP BY 1, 2) p ON p.user_id = a.user_id AND p.kind = a.kind""",
)
def a25_log(spark, sf):
    """What each kind gave each user, the broken one with its message."""
    return synced(spark, sf).log


@register("a25_sync_diagnosis", with_sql(DOCS_SQL) + f"SELECT CAST(user_id AS BIGINT) AS run, count(DISTINCT kind) - CASE WHEN user_id = {BROKEN[0]} THEN 1 ELSE 0 END AS n_ok, CASE WHEN user_id = {BROKEN[0]} THEN CAST(1 AS BIGINT) ELSE 0 END AS n_failed, CASE WHEN user_id = {BROKEN[0]} THEN 'some_types_empty' END AS diagnosis FROM every GROUP BY user_id")
def a25_diagnosis(spark, sf):
    """One diagnosis for each user's sync."""
    return N.diagnose(synced(spark, sf).log.withColumnRenamed("user_id", "run"), "run")


def incremental(spark, sf: str) -> VersionedStore:
    """The events in three batches out of order, and the first of them again."""
    store, rows = VersionedStore(spark, scratch(spark, "store"), buckets=4), V.store(spark, sf)
    for part in (2, 0, 1, 2):
        store.upsert(rows.where(F.col("seq") % 3 == part))
    return store


@register("l1_incremental_store", with_sql(STORE_SQL) + "SELECT user_id, date, metric_key, source, arg_max(value, seq) AS value, max(seq) AS seq FROM store GROUP BY 1, 2, 3, 4")
def l1(spark, sf):
    """The store after batches out of order: each key's row of the largest number."""
    return incremental(spark, sf).read()


@register(
    "l1_touched_folders",
    with_sql(STORE_SQL) + "SELECT metric_key, count(DISTINCT (user_id, date, source)) AS n, CASE WHEN metric_key = 'click' THEN 4 ELSE 3 END AS writes FROM store GROUP BY 1",
)
def l1_folders(spark, sf):
    """Rows of each metric and the largest number of writes that one of its folders has seen; a later batch is of one metric."""
    store = incremental(spark, sf)
    store.upsert(V.store(spark, sf).where("metric_key = 'click'").withColumn("seq", F.col("seq") + 10**9))
    writes = {}
    for number in store.manifests():
        for (key, _), version in store.manifest(number)[1].items():
            writes.setdefault(key, set()).add(version.split("-")[0])
    seen = spark.createDataFrame([(k, len(v)) for k, v in writes.items()], "metric_key string, writes int")
    return store.read().groupBy("metric_key").agg(F.count("*").alias("n")).join(seen, "metric_key")


@register(
    "a31_log_of_batches",
    "SELECT user_id, event_id % 4 AS batch, count(*) AS n, max(event_type) AS last FROM events GROUP BY 1, 2",
)
def a31(spark, sf):
    """Log rows in four batches, two of which are delivered again."""
    LogSource.register(spark)
    path, rows = scratch(spark, "log"), V.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    for batch in (0, 1, 1, 2, 3, 0):
        rows.where(F.col("event_id") % 4 == batch).write.format("tidemark_log").options(path=path, batch=f"run {batch}").mode("append").save()
    log = spark.read.format("tidemark_log").schema(rows.schema).options(path=path).load()
    return log.groupBy("user_id", (F.col("event_id") % 4).alias("batch")).agg(F.count("*").alias("n"), F.max("event_type").alias("last"))

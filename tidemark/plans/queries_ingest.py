"""Queries of parsing, import and API documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse as P
from tidemark.functions import vocab
from tidemark.operators import ingest as N
from tidemark.plans import views as V
from tidemark.plans.queries_series import rounded
from tidemark.plans.queries_relational import RANGE_SQL
from tidemark.plans.views import scratch, with_sql
from tidemark.registry import register
from tidemark.sources import files, synthetic


@register("a1_csv_read", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"the ' || c_mktsegment || '\"' || chr(10) || 'second line' AS note FROM customer")
def a1(spark, sf):
    """A round trip through an export with quotes, separators and line breaks in cells."""
    path = scratch(spark, "csv")
    note = F.concat("c_name", F.lit(', "the '), "c_mktsegment", F.lit('"\nsecond line'))
    V.table(spark, sf, "customer").select("c_custkey", note.alias("note")).write.option("header", True).option("quote", '"').option("escape", '"').option("sep", ";").csv(path)
    return files.read_csv(spark, path).select("c_custkey", "note")


CELLS = "CASE c_custkey % 12 WHEN 0 THEN '$' || c_custkey || '.50' WHEN 1 THEN '(' || c_custkey || ')' WHEN 2 THEN c_custkey || ' kg' WHEN 3 THEN '1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') WHEN 4 THEN '1.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ',25' WHEN 5 THEN 'n/a' WHEN 6 THEN '12/05/2024' WHEN 7 THEN c_custkey || 'h' WHEN 8 THEN c_custkey || 'e1' WHEN 9 THEN '-' || c_custkey || '%' WHEN 10 THEN c_custkey || ',5' ELSE 'abc' END"


@register(
    "h2_parse_numbers",
    "SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN c_custkey + 0.5 WHEN 1 THEN -c_custkey WHEN 2 THEN c_custkey WHEN 3 THEN 1000 + c_custkey % 1000 WHEN 4 THEN 1000 + c_custkey % 1000 + 0.25 WHEN 8 THEN c_custkey * 10 WHEN 9 THEN -c_custkey WHEN 10 THEN c_custkey + 0.5 END::DOUBLE AS value FROM customer",
)
def h2(spark, sf):
    cells = V.table(spark, sf, "customer").select("c_custkey", F.expr(CELLS.replace("VARCHAR", "STRING")).alias("cell"))
    return cells.select("c_custkey", P.parse_number(F.col("cell")).alias("value"))


@register(
    "h4_parse_durations",
    "SELECT c_custkey, round(CASE c_custkey % 6 WHEN 0 THEN c_custkey * 60 + 30 WHEN 1 THEN (c_custkey % 24) * 60 + 15 WHEN 2 THEN c_custkey / 60.0 WHEN 3 THEN 60 + c_custkey % 60 + 0.5 WHEN 4 THEN NULL ELSE c_custkey * 1.5 END::DOUBLE, 6) AS minutes FROM customer",
)
def h4(spark, sf):
    k = F.col("c_custkey").cast("string")
    cell = F.expr("CASE c_custkey % 6 WHEN 0 THEN c_custkey || 'h 30m' WHEN 1 THEN (c_custkey % 24) || ':15' WHEN 2 THEN c_custkey || ' sec' WHEN 3 THEN 'PT1H' || (c_custkey % 60) || 'M30S' WHEN 4 THEN CAST(c_custkey AS STRING) ELSE CAST(c_custkey * 1.5 AS STRING) || 'min' END")
    return V.table(spark, sf, "customer").select(k.cast("long").alias("c_custkey"), F.round(P.parse_duration(cell), 6).alias("minutes"))


@register(
    "h5_parse_dates",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""",
)
def h5(spark, sf):
    cell = F.expr("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'T08:00:00Z' WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'd.M.yyyy') WHEN 3 THEN date_format(o_orderdate, 'MMM d, yyyy') ELSE '31/02/' || year(o_orderdate) END")
    return V.table(spark, sf, "orders").select("o_orderkey", P.parse_date(cell).alias("date"))


@register("h8_transforms", "SELECT p_partkey, round(p_retailprice * 0.45359237, 6) AS kg, round(p_retailprice / 3600, 9) AS hours, round(p_retailprice * 2.54 * 0.5, 6) AS cm FROM part")
def h8(spark, sf):
    price = F.col("p_retailprice").cast("string")
    value = lambda t, scale=None: N.cell_value(N.ColumnPlan("c", "m", t, scale), price)
    return V.table(spark, sf, "part").select("p_partkey", F.round(value("lb_to_kg"), 6).alias("kg"), F.round(value("s_to_h"), 9).alias("hours"), F.round(value("in_to_cm", 0.5), 6).alias("cm"))


PROFILE_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "day", "o_orderpriority"]


@register(
    "a3_profile",
    """WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200)
    SELECT 'o_orderkey' AS header, count(*) AS filled, CAST(1 AS DOUBLE) AS numeric_ratio, CAST(0 AS DOUBLE) AS date_ratio FROM f UNION ALL SELECT 'o_orderstatus', count(*), 0, 0 FROM f UNION ALL SELECT 'o_totalprice', count(*), 1, 0 FROM f
    UNION ALL SELECT 'day', count(*), 0, 1 FROM f UNION ALL SELECT 'o_orderpriority', count(*), 0, 0 FROM f""",
)
def a3(spark, sf):
    rows = V.table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return N.profile(rows, PROFILE_COLUMNS, "o_orderkey").drop("samples")


@register(
    "a3_samples",
    """WITH f AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), t AS (SELECT k, CASE WHEN k % 3 = 0 THEN ' ' ELSE c_name END AS a, CASE WHEN k % 2 = 0 THEN NULL ELSE c_mktsegment END AS b FROM f WHERE k <= 200)
    SELECT 'a' AS header, (SELECT string_agg(a, '|' ORDER BY k) FROM (SELECT * FROM t WHERE trim(a) <> '' ORDER BY k LIMIT 3) x) AS samples UNION ALL SELECT 'b', (SELECT string_agg(b, '|' ORDER BY k) FROM (SELECT * FROM t WHERE b IS NOT NULL ORDER BY k LIMIT 3) x)""",
)
def a3_samples(spark, sf):
    """The first three cells of each column that are not blank."""
    from pyspark.sql import Window

    numbered = V.table(spark, sf, "customer").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("c_custkey")))
    rows = numbered.select("k", F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("c_name")).alias("a"), F.when(F.col("k") % 2 == 1, F.col("c_mktsegment")).alias("b"))
    return N.profile(rows, ["a", "b"], "k").select("header", F.array_join("samples", "|").alias("samples"))


PLAN = N.ImportPlan("metrics", (N.ColumnPlan("Day", "date"), N.ColumnPlan("Weight (lb)", "weight_kg", "lb_to_kg"), N.ColumnPlan("Slept", "sleep_hours", "min_to_h"), N.ColumnPlan("Steps", "steps"), N.ColumnPlan("Name", None)))


def export(spark, sf):
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(
        k, F.expr("CASE WHEN c_custkey % 10 = 0 THEN 'soon' ELSE date_format(date_add(DATE '2024-01-01', CAST(c_custkey % 300 AS INT)), 'dd/MM/yyyy') END").alias("Day"), F.concat((150 + k % 60).cast("string"), F.lit(" lb")).alias("Weight (lb)"),
        F.concat((6 + k % 3).cast("string"), F.lit(":30")).alias("Slept"), F.when(k % 4 != 0, F.format_number((5000 + k % 7000).cast("double"), 0)).alias("Steps"), F.col("c_name").alias("Name"),
    )


@register(
    "a9_wide_to_long",
    """WITH d AS (SELECT c_custkey, DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS date FROM customer WHERE c_custkey % 10 <> 0)
    SELECT c_custkey, date, 'weight_kg' AS metric_key, round((150 + c_custkey % 60) * 0.45359237, 6) AS value, 'csv' AS source FROM d UNION ALL SELECT c_custkey, date, 'sleep_hours', round((6 + c_custkey % 3) + 0.5, 6), 'csv' FROM d
    UNION ALL SELECT c_custkey, date, 'steps', CAST(5000 + c_custkey % 7000 AS DOUBLE), 'csv' FROM d WHERE c_custkey % 4 <> 0""",
)
def a9(spark, sf):
    return rounded(N.to_long(export(spark, sf), PLAN, ("c_custkey",)), "value")


@register(
    "a9_bad_dates",
    "SELECT c_custkey AS place, CASE WHEN c_custkey % 20 = 0 THEN '(empty)' ELSE 'day ' || c_custkey END AS cell FROM customer WHERE c_custkey % 10 = 0 ORDER BY c_custkey LIMIT 5",
)
def a9_bad(spark, sf):
    """The first cells of the date column that are no date."""
    k = F.col("c_custkey")
    rows = V.table(spark, sf, "customer").select(k, F.when(k % 20 == 0, None).when(k % 10 == 0, F.concat(F.lit("day "), k)).otherwise("2024-02-01").alias("Day"))
    return N.bad_dates(rows, N.ImportPlan("metrics", (N.ColumnPlan("Day", "date"),)), "c_custkey")


def exported(spark, sf, sep):
    """An export in a file with a separator, and what is read of it, in file order."""
    path, k = scratch(spark, "export"), F.col("c_custkey")
    V.table(spark, sf, "customer").select(
        F.expr("CASE WHEN c_custkey % 10 = 0 THEN 'soon' ELSE date_format(date_add(DATE '2024-01-01', CAST(c_custkey % 300 AS INT)), 'dd.MM.yyyy') END").alias("Recorded"), (60 + k % 40).cast("string").alias("Body Weight"),
        F.concat((6 + k % 3).cast("string"), F.lit(":30")).alias("Sleep Duration"), (5000 + k % 7000).cast("string").alias("My Total Steps"), F.col("c_name").alias("Remarks"), k.cast("string").alias("Row"), (k % 9).cast("string").alias("Espressos"),
    ).write.option("header", True).option("sep", sep).csv(path)
    return files.read_csv(spark, path)


@register(
    "a5_import_by_rules",
    """WITH d AS (SELECT c_custkey, DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS date FROM customer WHERE c_custkey % 10 <> 0)
    SELECT CAST(c_custkey AS VARCHAR) AS Row, date, 'weight_kg' AS metric_key, CAST(60 + c_custkey % 40 AS DOUBLE) AS value, 'csv' AS source FROM d UNION ALL SELECT CAST(c_custkey AS VARCHAR), date, 'sleep_hours', CAST(390 + c_custkey % 3 * 60 AS DOUBLE), 'csv' FROM d
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), date, 'steps', CAST(5000 + c_custkey % 7000 AS DOUBLE), 'csv' FROM d""",
)
def a5(spark, sf):
    """A file to long rows with nothing given: separator, columns and date column are found.

    Durations stay minutes: that hours were expected is a warning of the plan, whose conversion the user chooses.
    """
    rows = exported(spark, sf, "|")
    numbered = rows.withColumn("_order", F.col("Row").cast("long"))
    ratios = {r["header"]: r["date_ratio"] for r in N.profile(numbered, rows.columns, "_order").collect()}
    plan = N.checked_plan(numbered, N.rules_plan(rows.columns, ratios), "_order")
    return rounded(N.to_long(rows, plan, ("Row",)), "value")


@register(
    "a7_import_of_a_proposal",
    """WITH d AS (SELECT c_custkey, DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS date FROM customer WHERE c_custkey % 10 <> 0)
    SELECT CAST(c_custkey AS VARCHAR) AS Row, date, 'weight_kg' AS metric_key, CAST(60 + c_custkey % 40 AS DOUBLE) AS value, 'csv' AS source FROM d UNION ALL SELECT CAST(c_custkey AS VARCHAR), date, 'espressos', CAST(c_custkey % 9 AS DOUBLE), 'csv' FROM d""",
)
def a7(spark, sf):
    """Long rows of a proposed plan with unknown keys, conversions and columns, a new metric, and no date column."""
    rows = exported(spark, sf, ";")
    numbered = rows.withColumn("_order", F.col("Row").cast("long"))
    ratios = {r["header"]: r["date_ratio"] for r in N.profile(numbered, rows.columns, "_order").collect()}
    new = N.NewMetric("Espressos", "cups", "no such", "yes", "median", 9)
    wild = (
        N.ColumnPlan("Body Weight", "weight_kg", "magic", float("nan")), N.ColumnPlan("My Total Steps", "paces"), N.ColumnPlan("Sleep Duration", "BAD KEY", new_metric=new),
        N.ColumnPlan("Espressos", "espressos", new_metric=new), N.ColumnPlan("Not there", "mood"), N.ColumnPlan("Remarks", "-"),
    )
    plan = N.sanitise(N.ImportPlan("metrics", wild), rows.columns, {k for k, *_ in vocab.CORE_METRICS}, ratios)
    return N.to_long(rows, plan, ("Row",))


@register(
    "a8_plausibility",
    with_sql(RANGE_SQL)
    + """, f AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS k FROM customer ORDER BY c_custkey LIMIT 200),
    m AS (SELECT 'w' AS header, 'weight_kg' AS metric_key, list_sort(list(CAST(150 + c_custkey % 160 AS DOUBLE) * 2))[CAST(count(*) // 2 AS INTEGER) + 1] AS median FROM f UNION ALL SELECT 's', 'sleep_hours', list_sort(list(CAST(380 + c_custkey % 90 AS DOUBLE)))[CAST(count(*) // 2 AS INTEGER) + 1] FROM f)
    SELECT header, m.metric_key, median, CASE header WHEN 'w' THEN CASE WHEN median * 0.45359237 BETWEEN 30 AND 250 THEN 'lb_to_kg' END ELSE CASE WHEN median / 3600 BETWEEN 0 AND 14 THEN 's_to_h' END END AS suggested
    FROM m JOIN ranges r ON r.metric_key = m.metric_key WHERE median < low OR median > high""",
)
def a8(spark, sf):
    k = F.col("c_custkey")
    rows = V.table(spark, sf, "customer").select(k, ((150 + k % 160) * 2).alias("w"), (380 + k % 90).alias("s"), (7 + k % 2).alias("ok"))
    return N.implausible(rows, N.ImportPlan("metrics", (N.ColumnPlan("w", "weight_kg"), N.ColumnPlan("s", "sleep_hours"), N.ColumnPlan("ok", "deep_work_hours"))), "c_custkey")


@register("a14_fingerprints", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS BIGINT) AS occurrence FROM customer")
def a14(spark, sf):
    rows = N.occurrence_ids(V.table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey")
    n = F.regexp_extract("content_id", r"\.(\d+)$", 1)
    return rows.select("c_custkey", F.when(n == "", 1).otherwise(n.try_cast("int")).cast("long").alias("occurrence"))


@register("h20_fnv", "SELECT n_nationkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM nation")
def h20(spark, sf):
    return V.table(spark, sf, "nation").select("n_nationkey", N.fingerprint([F.col("n_name")]).alias("h"))


def documents(spark, sf, body):
    return V.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.expr("CASE WHEN event_id % 3 = 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN event_id % 3 = 1 THEN concat('{\"date\":{\"year\":', year(ts), ',\"month\":', month(ts), ',\"day\":', day(ts), '}}') ELSE concat('{\"year\":', year(ts), ',\"month\":', month(ts), ',\"day\":', day(ts), '}') END").alias("day"), F.expr(body).alias("body"))


@register("a19_rollup_documents", "SELECT date, metric_key, round(value, 6) AS value FROM (SELECT CAST(ts AS DATE) AS date, 'distance_km' AS metric_key, arg_max(CAST(event_id * 1000 AS DOUBLE) / 1e6, event_id) AS value FROM events GROUP BY 1) t")
def a19(spark, sf):
    return rounded(N.api_points(documents(spark, sf, "concat('{\"millimetersSum\":\"', event_id * 1000, '\"}')"), "distance"), "value")


@register(
    "a20_daily_documents",
    "SELECT CAST(ts AS DATE) AS date, 'hrv_ms' AS metric_key, arg_max(CAST(event_id % 90 AS DOUBLE), event_id) AS value FROM events GROUP BY 1 UNION ALL SELECT CAST(ts AS DATE), 'hrv_deep_ms', arg_max(CAST(event_id % 70 AS DOUBLE), event_id) FROM events WHERE event_id % 2 = 0 GROUP BY 1",
)
def a20(spark, sf):
    body = "concat('{\"averageHeartRateVariabilityMilliseconds\":', event_id % 90, CASE WHEN event_id % 2 = 0 THEN concat(',\"deepSleepRootMeanSquareOfSuccessiveDifferencesMilliseconds\":', event_id % 70) ELSE '' END, '}')"
    return N.api_points(documents(spark, sf, body), "daily-heart-rate-variability")


@register("a19_zone_minutes", "SELECT CAST(ts AS DATE) AS date, 'active_zone_min' AS metric_key, arg_max(CAST(event_id % 7 + event_id % 11 AS DOUBLE), event_id) AS value FROM events GROUP BY 1")
def a19_zones(spark, sf):
    return N.api_points(documents(spark, sf, "concat('{\"sumInFatBurnHeartZone\":\"', event_id % 7, '\",\"sumInPeakHeartZone\":', event_id % 11, '}')"), "active-zone-minutes")


@register(
    "a19_active_minutes",
    "SELECT CAST(ts AS DATE) AS date, 'active_minutes' AS metric_key, arg_max(CAST(event_id % 50 + event_id % 20 + 1 AS DOUBLE), event_id) AS value FROM events GROUP BY 1 UNION ALL SELECT CAST(ts AS DATE), 'moderate_vigorous_min', arg_max(CAST(event_id % 20 + 1 AS DOUBLE), event_id) FROM events GROUP BY 1",
)
def a19_active(spark, sf):
    body = "concat('{\"activeMinutesRollupByActivityLevel\":[{\"activityLevel\":\"LIGHT\",\"activeMinutesSum\":\"', event_id % 50, '\"},{\"activityLevel\":\"VIGOROUS\",\"activeMinutesSum\":', event_id % 20 + 1, '}]}')"
    return N.api_points(documents(spark, sf, body), "active-minutes")


SLEEP_SQL = """ses AS (SELECT user_id % 40 AS user_id, event_id AS session_id, epoch(date_trunc('second', ts)) AS a, event_id % 5 = 0 AS is_main, CAST(60 + event_id % 400 AS DOUBLE) AS asleep, CAST(80 + event_id % 420 AS DOUBLE) AS period, CAST(event_id % 90 AS DOUBLE) AS deep, 
  CAST(to_timestamp(epoch(date_trunc('second', ts)) + 60 * (80 + event_id % 420)) AT TIME ZONE 'UTC' AS DATE) AS date FROM events),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY is_main DESC, CASE WHEN is_main THEN 0 ELSE -asleep END, session_id) AS k FROM ses),
mn AS (SELECT * FROM rk WHERE k = 1),
np AS (SELECT r.user_id, r.date, sum(r.asleep) AS nap FROM rk r JOIN mn m ON m.user_id = r.user_id AND m.date = r.date WHERE r.k > 1 AND (least(r.a + r.period * 60, m.a + m.period * 60) - greatest(r.a, m.a) <= 0 OR least(r.a + r.period * 60, m.a + m.period * 60) - greatest(r.a, m.a) < 0.5 * r.period * 60) GROUP BY 1, 2)"""


@register(
    "k12_sleep_nights",
    f"""WITH {SLEEP_SQL}, v AS (SELECT m.*, nap, floor((CAST(m.a AS BIGINT) + 7200) % 86400 / 60.0) / 60.0 AS h FROM mn m LEFT JOIN np ON np.user_id = m.user_id AND np.date = m.date)
    SELECT user_id, date, 'sleep_hours' AS metric_key, round(asleep / 60, 6) AS value FROM v UNION ALL SELECT user_id, date, 'sleep_efficiency', round(least(100, asleep / period * 100), 6) FROM v UNION ALL SELECT user_id, date, 'deep_sleep_min', deep FROM v WHERE deep > 0
    UNION ALL SELECT user_id, date, 'nap_min', nap FROM v WHERE nap > 0 UNION ALL SELECT user_id, date, 'sleep_start_hour', round(CASE WHEN h > 12 THEN h - 24 ELSE h END, 6) FROM v""",
)
def k12(spark, sf):
    k = F.col("event_id")
    start = F.date_trunc("second", "ts")
    ses = V.table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("user_id"), k.alias("session_id"), start.alias("start_ts"), F.timestamp_seconds(F.unix_timestamp(start) + 60 * (80 + k % 420)).alias("end_ts"), F.lit(7200).alias("offset_s"), (k % 5 == 0).alias("is_main"),
        (60 + k % 400).cast("double").alias("minutes_asleep"), (80 + k % 420).cast("double").alias("minutes_in_period"), (k % 90).cast("double").alias("deep"), F.lit(None).cast("double").alias("rem"), F.lit(0.0).alias("awake"),
    )
    return rounded(N.sleep_nights(ses, ["user_id"]), "value")


@register(
    "a22_exercise_sessions",
    "SELECT event_id, date, minutes AS duration_min FROM (SELECT event_id, CAST(ts AS DATE) AS date, CAST(CASE WHEN event_id % 2 = 0 THEN (event_id % 500) * 60 ELSE 45 * 60 END AS DOUBLE) / 60 AS minutes FROM events) t WHERE minutes > 0 AND minutes <= 360 AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'",
)
def a22(spark, sf):
    k = F.col("event_id")
    ses = V.table(spark, sf, "events").select(k, F.date_trunc("second", "ts").alias("start_ts"), F.timestamp_seconds(F.unix_timestamp("ts") + 2700).alias("end_ts"), F.when(k % 2 == 0, k % 500 * 60).alias("active_s"))
    return N.exercise_sessions(ses, "2024-01-05", "2024-01-25").select("event_id", "date", "duration_min")


@register(
    "a26_diagnosis",
    """WITH l AS (SELECT user_id AS run, event_id % 4 <> 0 AS ok, CASE user_id % 5 WHEN 0 THEN '403 insufficient' WHEN 1 THEN 'error 401 UNAUTHENTICATED' WHEN 2 THEN 'has not been used in project 12' ELSE 'nothing' END AS message FROM events)
    SELECT run, count(CASE WHEN ok THEN 1 END) AS n_ok, count(CASE WHEN NOT ok THEN 1 END) AS n_failed, CASE WHEN count(CASE WHEN NOT ok THEN 1 END) = 0 THEN NULL WHEN run % 5 = 2 THEN 'api_disabled' WHEN run % 5 = 1 THEN 'connection_expired'
      WHEN run % 5 = 0 AND count(CASE WHEN ok THEN 1 END) = 0 THEN 'scopes_missing' WHEN count(CASE WHEN ok THEN 1 END) > 0 THEN 'some_types_empty' ELSE 'all_failed' END AS diagnosis FROM l GROUP BY 1""",
)
def a26(spark, sf):
    message = F.expr("CASE user_id % 5 WHEN 0 THEN '403 insufficient' WHEN 1 THEN 'error 401 UNAUTHENTICATED' WHEN 2 THEN 'has not been used in project 12' ELSE 'nothing' END")
    log = V.table(spark, sf, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 4 != 0).alias("ok"), message.alias("message"))
    return N.diagnose(log, "run")


@register("a32_demo_data")
def a32(spark, sf):
    return synthetic.demo(spark)


@register("a18_core_definitions", "SELECT key, label, category, precision FROM (VALUES " + ", ".join(f"('{k}', '{name}', '{c}', {p})" for k, name, _, c, _, _, p in vocab.CORE_METRICS) + ") v(key, label, category, precision)")
def a18(spark, sf):
    from tidemark.operators.store import definitions

    return definitions(spark).select("key", "label", "category", "precision")


SESSION_PLAN = N.ImportPlan("workouts", (N.ColumnPlan("When", "date"), N.ColumnPlan("Sport", "type"), N.ColumnPlan("Time", "duration_min"), N.ColumnPlan("Miles", "distance_km", "mi_to_km"), N.ColumnPlan("Pulse", "avg_hr")))


@register(
    "a10_import_workouts",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS type, CAST(60 + o_orderkey % 60 AS DOUBLE) AS duration_min, round((o_orderkey % 20) * CAST(1.609344 AS DOUBLE), 6) AS distance_km, CASE WHEN o_orderkey % 2 = 0 THEN CAST(100 + o_orderkey % 80 AS DOUBLE) END AS avg_hr,
      CAST(NULL AS DOUBLE) AS rpe, 'csv' AS source FROM orders WHERE o_orderkey % 9 <> 0""",
)
def a10(spark, sf):
    k = F.col("o_orderkey")
    rows = V.table(spark, sf, "orders").select(
        k, F.expr("CASE WHEN o_orderkey % 9 = 0 THEN '?' ELSE date_format(o_orderdate, 'dd.MM.yyyy') END").alias("When"), F.col("o_orderpriority").alias("Sport"), F.concat(F.lit("1h "), k % 60, F.lit("m")).alias("Time"),
        (k % 20).alias("Miles"), F.when(k % 2 == 0, F.concat((100 + k % 80).cast("string"), F.lit(" bpm"))).alias("Pulse"),
    )
    found = N.to_workouts(rows, SESSION_PLAN, "o_orderkey")
    return rounded(found, "distance_km").select("o_orderkey", "date", "type", "duration_min", "distance_km", "avg_hr", "rpe", "source")


SET_PLAN = N.ImportPlan("sets", (N.ColumnPlan("Date", "date"), N.ColumnPlan("Exercise", "exercise"), N.ColumnPlan("Lb", "weight_kg", "lb_to_kg"), N.ColumnPlan("Reps", "reps")))


@register(
    "a11_import_sets",
    "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS date, 'lift ' || l_suppkey % 7 AS exercise, round(l_quantity * 10 * 0.45359237, 6) AS weight_kg, CAST(l_linenumber AS DOUBLE) AS reps FROM lineitem WHERE l_suppkey % 11 <> 0",
)
def a11(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"), F.when(F.col("l_suppkey") % 11 != 0, F.concat(F.lit(" lift "), F.col("l_suppkey") % 7)).otherwise(" ").alias("Exercise"),
        F.concat((F.col("l_quantity") * 10).cast("string"), F.lit(" lb")).alias("Lb"), F.concat("l_linenumber", F.lit(" reps")).alias("Reps"),
    )
    return rounded(N.to_sets(rows, SET_PLAN, "id"), "weight_kg").select("id", "date", "exercise", "weight_kg", "reps")


@register("a27_manual_entries", "SELECT c_custkey AS user_id, DATE '2024-01-01' AS date, k AS metric_key, v AS value, 'manual' AS source FROM (SELECT c_custkey, 'weight_kg' AS k, c_custkey + 0.5::DOUBLE AS v FROM customer UNION ALL SELECT c_custkey, 'mood', CAST(c_custkey % 10 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 0) t")
def a27(spark, sf):
    k = F.col("c_custkey")
    values = F.create_map(F.lit("weight_kg"), F.concat(k.cast("string"), F.lit(".5 kg")), F.lit("mood"), F.when(k % 2 == 0, (k % 10).cast("string")).otherwise("fine"))
    entries = V.table(spark, sf, "customer").select(k.alias("user_id"), F.lit("2024-01-01").cast("date").alias("date"), values.alias("values"))
    return N.logged_values(entries, "manual")

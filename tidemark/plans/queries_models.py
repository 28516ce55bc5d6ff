"""Queries of the domain models: training, strength, goals, standings, derivation, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import fisher_p_sql
from tidemark.functions.vocab import ANCHORS, DECADES, HIGHER_IS_BETTER, LIFTS, PERCENTILES, PLAUSIBLE_RANGES
from tidemark.operators import goals as G
from tidemark.operators import series as S
from tidemark.operators import standing as P
from tidemark.operators import store as T
from tidemark.operators import training as K
from tidemark.plans import derive, report, tools
from tidemark.plans import views as V
from tidemark.plans.queries_series import ONE, rounded
from tidemark.plans.queries_statistics import VERDICT_SQL
from tidemark.plans.views import DENSE_SQL, EVENTS_TODAY, ORDERS_TODAY, RESOLVED_SQL, SERIES_SQL, SETS_SQL, SETS_TODAY, WORKOUTS_SQL, with_sql
from tidemark.registry import ORACLE, register

USER = ["user_id"]

BEST_SQL = """best AS (SELECT * FROM (SELECT *, CASE source WHEN 'manual' THEN 3 WHEN 'csv' THEN 2 WHEN 'google_health' THEN 1 ELSE 0 END AS rk,
  max(CASE source WHEN 'manual' THEN 3 WHEN 'csv' THEN 2 WHEN 'google_health' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date, type) AS top FROM workouts) t WHERE rk = top)"""
LOADED_SQL = """loaded AS (SELECT *, CASE WHEN duration_min <= 0 THEN 0 ELSE least(600, CASE WHEN coalesce(avg_hr, 0) <> 0 THEN duration_min * hrr * 0.64 * exp(1.92 * hrr) WHEN coalesce(rpe, 0) <> 0 THEN duration_min * rpe ELSE duration_min * 2.5 END) END AS load
  FROM (SELECT *, greatest(0, least(1, (avg_hr - 55.0) / (190.0 - 55.0))) AS hrr FROM best) t)"""
DAILY_SQL = "daily AS (SELECT user_id, date, sum(load) AS load, sum(coalesce(duration_min, 0)) AS minutes FROM loaded GROUP BY 1, 2)"
CHAIN_SQL = [WORKOUTS_SQL, BEST_SQL, LOADED_SQL, DAILY_SQL]


def loaded(spark, sf):
    return K.best_source(V.workouts(spark, sf)).withColumn("load", K.session_load(F.lit(55.0), F.lit(190.0)))


@register("k3_workout_dedupe", with_sql(*CHAIN_SQL[:2]) + "SELECT user_id, date, type, source, external_id FROM best")
def k3(spark, sf):
    return K.best_source(V.workouts(spark, sf)).select("user_id", "date", "type", "source", "external_id")


@register("k1_session_load", with_sql(*CHAIN_SQL[:3]) + "SELECT external_id, round(load, 6) AS load FROM loaded")
def k1(spark, sf):
    return loaded(spark, sf).select("external_id", F.round("load", 6).alias("load"))


@register("k2_max_heart_rate", "SELECT c_custkey, greatest(coalesce(CASE WHEN c_custkey % 3 = 0 THEN CAST(150 + c_custkey % 60 AS DOUBLE) END, 0), CASE WHEN c_custkey % 5 <> 0 THEN 208 - 0.7 * (20 + c_custkey % 50) ELSE 190 END) AS max_hr FROM customer")
def k2(spark, sf):
    k = F.col("c_custkey")
    age, seen = F.when(k % 5 != 0, 20 + k % 50), F.when(k % 3 == 0, (150 + k % 60).cast("double"))
    return V.table(spark, sf, "customer").select(k, K.max_heart_rate(age, seen).alias("max_hr"))


@register("d11_daily_load", with_sql(*CHAIN_SQL) + "SELECT user_id, date, round(load, 6) AS load, minutes FROM daily")
def d11(spark, sf):
    return rounded(K.daily_load(loaded(spark, sf)), "load")


MODEL_SQL = """days AS (SELECT user_id, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM recent GROUP BY 1),
g AS (SELECT days.user_id, days.date, coalesce(r.load, 0) AS load, row_number() OVER (PARTITION BY days.user_id ORDER BY days.date) - 1 AS i FROM days LEFT JOIN recent r ON r.user_id = days.user_id AND r.date = days.date),
m AS (SELECT a.user_id, a.date, a.i, a.load, sum(b.load * exp((b.i - a.i) / 42.0)) / sum(exp((b.i - a.i) / 42.0)) AS ctl, sum(b.load * exp((b.i - a.i) / 7.0)) / sum(exp((b.i - a.i) / 7.0)) AS atl
      FROM g a JOIN g b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY 1, 2, 3, 4)"""


@register(
    "k4_training_load",
    with_sql(*CHAIN_SQL, "recent AS (SELECT * FROM daily WHERE date >= DATE '2000-08-01')", MODEL_SQL)
    + """SELECT user_id, date, round(load, 6) AS load, round(ctl, 6) AS ctl, round(atl, 6) AS atl, round(lag(ctl - atl) OVER (PARTITION BY user_id ORDER BY date), 6) AS tsb, round(CASE WHEN ctl > 1 THEN atl / ctl END, 6) AS acwr, i >= 42 AS established FROM m""",
)
def k4(spark, sf):
    daily = K.daily_load(loaded(spark, sf)).where("date >= DATE '2000-08-01'")
    return rounded(K.training_load(daily, USER), "load", "ctl", "atl", "tsb", "acwr")


GRID_OF_LOADS_SQL = """days AS (SELECT user_id, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY 1),
g AS (SELECT days.user_id, days.date, coalesce(r.load, 0) AS load, row_number() OVER (PARTITION BY days.user_id ORDER BY days.date) - 1 AS i FROM days LEFT JOIN daily r ON r.user_id = days.user_id AND r.date = days.date)"""
SCAN_SQL = """st AS (SELECT user_id, date, load, i, CAST(load AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS cw, CAST(load AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS aw FROM g WHERE i = 0
  UNION ALL SELECT g.user_id, g.date, g.load, g.i, st.c * exp(-1 / 42.0) + g.load, st.cw * exp(-1 / 42.0) + 1, st.a * exp(-1 / 7.0) + g.load, st.aw * exp(-1 / 7.0) + 1 FROM st JOIN g ON g.user_id = st.user_id AND g.i = st.i + 1),
m AS (SELECT user_id, date, load, i, c / cw AS ctl, a / aw AS atl FROM st)"""


def recursive_sql(*ctes: str) -> str:
    """WITH clause of which an entry may read itself."""
    return with_sql(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@register(
    "k4_training_load_of_years",
    recursive_sql(*CHAIN_SQL, GRID_OF_LOADS_SQL, SCAN_SQL)
    + """SELECT user_id, date, round(load, 6) AS load, round(ctl, 6) AS ctl, round(atl, 6) AS atl, round(lag(ctl - atl) OVER (PARTITION BY user_id ORDER BY date), 6) AS tsb, round(CASE WHEN ctl > 1 THEN atl / ctl END, 6) AS acwr, i >= 42 AS established FROM m""",
)
def k4_years(spark, sf):
    return rounded(K.training_load(K.daily_load(loaded(spark, sf)), USER), "load", "ctl", "atl", "tsb", "acwr")


@register(
    "b10_risk_tone",
    with_sql(*CHAIN_SQL, "recent AS (SELECT * FROM daily WHERE date >= DATE '2000-08-01')", MODEL_SQL)
    + """SELECT user_id, date, CASE WHEN i < 42 OR NOT ctl > 1 THEN NULL WHEN round(atl / ctl, 9) > 1.5 THEN 'critical' WHEN round(atl / ctl, 9) > 1.3 OR round(atl / ctl, 9) < 0.8 THEN 'warning' ELSE 'good' END AS tone FROM m""",
)
def b10(spark, sf):
    from tidemark.operators.relational import ratio_tone

    daily = K.daily_load(loaded(spark, sf)).where("date >= DATE '2000-08-01'")
    return K.training_load(daily, USER).select("user_id", "date", ratio_tone(F.round("acwr", 9), F.col("established")).alias("tone"))


@register(
    "k5_monotony",
    with_sql(*CHAIN_SQL)
    + """SELECT user_id, round(m / sd, 6) AS monotony, round(7 * m * m / sd, 6) AS strain, round(7 * m, 6) AS weekly_load FROM (
      SELECT user_id, count(*) AS n, avg(load) AS m, stddev_samp(load) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS k FROM daily) t WHERE k <= 7 GROUP BY 1) u WHERE n = 7 AND sd > 0""",
)
def k5(spark, sf):
    return rounded(K.monotony(K.daily_load(loaded(spark, sf)), USER), "monotony", "strain", "weekly_load")


READY_SQL = """z AS (SELECT metric_key, date, CASE WHEN n >= 10 AND sd > 0 THEN (value - m) / sd END AS z FROM (
  SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM series WINDOW w AS (PARTITION BY metric_key ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) t),
part AS (SELECT date, 50 + 20 * greatest(-2.5, least(2.5, CASE WHEN metric_key = '2-HIGH' THEN -z ELSE z END)) AS score, CASE metric_key WHEN '1-URGENT' THEN 0.35 WHEN '2-HIGH' THEN 0.30 ELSE 0.25 END AS w
  FROM z WHERE z IS NOT NULL AND metric_key IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  UNION ALL SELECT date, 50 + 0.8 * greatest(-40, least(25, value * 50 - 40)), 0.1 FROM series WHERE metric_key = '5-LOW')"""


@register("k6_readiness", with_sql(SERIES_SQL, READY_SQL) + "SELECT date, round(greatest(0, least(100, sum(score * w) / sum(w))), 6) AS value FROM part GROUP BY date HAVING round(CAST(sum(w) AS DOUBLE), 9) >= 0.5")
def k6(spark, sf):
    s = V.series(spark, sf).withColumn("user_id", F.lit(0))
    of = lambda k: s.where(F.col("metric_key") == k)
    form = of("5-LOW").withColumn("value", F.col("value") * 50 - 40)
    return rounded(K.readiness(of("1-URGENT"), of("2-HIGH"), of("3-MEDIUM"), form, USER), "value").select("date", "value")


BODY_SQL = "body AS (SELECT a.date, a.value * 100 * (b.value * 20 / 100) AS fat, a.value * 100 * (1 - b.value * 20 / 100) AS lean FROM dense a JOIN dense b ON a.date = b.date AND a.metric_key = 'click' AND b.metric_key = 'view')"


def body(spark, sf):
    d = V.dense(spark, sf).withColumn("user_id", F.lit(0))
    weight, pct = d.where("metric_key = 'click'").withColumn("value", F.col("value") * 100), d.where("metric_key = 'view'").withColumn("value", F.col("value") * 20)
    return K.body_composition(weight, pct, USER)


@register("k7_body_composition", with_sql(DENSE_SQL, BODY_SQL) + "SELECT date, round(fat, 9) AS fat, round(lean, 9) AS lean FROM body")
def k7(spark, sf):
    return rounded(body(spark, sf), "fat", "lean", digits=9).select("date", "fat", "lean")


@register(
    "k8_recomposition",
    with_sql(DENSE_SQL, BODY_SQL)
    + """, p AS (SELECT *, row_number() OVER (ORDER BY date) AS a, row_number() OVER (ORDER BY date DESC) AS z FROM body WHERE date >= (SELECT max(date) FROM body) - 56),
    d AS (SELECT avg(CASE WHEN z <= 3 THEN lean END) - avg(CASE WHEN a <= 3 THEN lean END) AS l, avg(CASE WHEN z <= 3 THEN fat END) - avg(CASE WHEN a <= 3 THEN fat END) AS f FROM p)
    SELECT round(l, 6) AS delta_lean, round(f, 6) AS delta_fat, round(CASE WHEN abs(l) + abs(f) < 0.05 THEN 50 ELSE greatest(0, least(100, 50 + (l - f) / (abs(l) + abs(f)) * 50)) END, 6) AS quality,
      CASE WHEN f < -0.2 AND l >= -0.1 THEN 'recomposing' WHEN f < -0.2 AND l < -0.1 THEN 'losing both' WHEN f >= 0.2 AND l > 0.2 THEN 'gaining both' WHEN f >= 0.2 THEN 'gaining fat' ELSE 'holding' END AS verdict FROM d""",
)
def k8(spark, sf):
    return rounded(K.recomposition(body(spark, sf), USER), "delta_lean", "delta_fat", "quality").drop("user_id")


@register(
    "k9_daily_strength",
    with_sql(SETS_SQL)
    + """, d AS (SELECT user_id, date, sum(weight_kg * reps) AS v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(reps) AS DOUBLE) AS r, CAST(count(CASE WHEN rpe >= 7 THEN 1 END) AS DOUBLE) AS h, max(weight_kg) AS t FROM sets GROUP BY 1, 2)
    SELECT user_id, date, metric_key, round(value, 8) AS value FROM (SELECT user_id, date, 'training_volume_kg' AS metric_key, v AS value FROM d UNION ALL SELECT user_id, date, 'sets_count', n FROM d UNION ALL SELECT user_id, date, 'reps_total', r FROM d
      UNION ALL SELECT user_id, date, 'hard_sets', h FROM d UNION ALL SELECT user_id, date, 'top_set_kg', t FROM d) t WHERE value <> 0""",
)
def k9(spark, sf):
    return rounded(K.daily_strength(V.sets(spark, sf), USER), "value", digits=8)


MAIN_SQL = """heavy AS (SELECT * FROM sets WHERE weight_kg > 0 AND reps BETWEEN 1 AND 12),
mainlift AS (SELECT user_id, exercise FROM (SELECT user_id, exercise, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, exercise) AS k FROM heavy GROUP BY 1, 2) t WHERE k <= 3),
e AS (SELECT h.user_id, h.exercise, h.date, max(weight_kg * (1 + reps / 30.0E0)) AS best FROM heavy h JOIN mainlift m ON m.user_id = h.user_id AND m.exercise = h.exercise GROUP BY 1, 2, 3)"""


@register("c2_main_lifts", with_sql(SETS_SQL, MAIN_SQL) + "SELECT user_id, exercise FROM mainlift")
def c2(spark, sf):
    return K.main_lifts(V.sets(spark, sf), USER, most=3)


@register("d6_best_estimates", with_sql(SETS_SQL, MAIN_SQL) + "SELECT user_id, exercise, date, round(best, 6) AS best FROM e")
def d6(spark, sf):
    heavy = K.heavy_sets(V.sets(spark, sf))
    main = K.main_lifts(V.sets(spark, sf), USER, most=3)
    return rounded(heavy.join(F.broadcast(main), ["user_id", "exercise"], "left_semi").groupBy("user_id", "exercise", "date").agg(F.max(K.e1rm()).alias("best")), "best")


@register(
    "k10_strength_index",
    with_sql(SETS_SQL, MAIN_SQL)
    + """, days AS (SELECT DISTINCT user_id, date FROM e)
    SELECT d.user_id, d.date, round(sum(top), 6) AS value FROM (SELECT days.user_id, days.date, e.exercise, max(e.best) AS top FROM days JOIN e ON e.user_id = days.user_id AND e.date <= days.date GROUP BY 1, 2, 3) d GROUP BY 1, 2""",
)
def k10(spark, sf):
    return rounded(K.strength_index(V.sets(spark, sf), USER, most=3), "value")


@register(
    "d7_exercise_progress",
    with_sql(SETS_SQL)
    + f"""SELECT user_id, exercise, count(DISTINCT date) AS sessions, round(max(CASE WHEN reps BETWEEN 1 AND 12 THEN weight_kg * (1 + reps / 30.0E0) END), 6) AS best_e1rm, round(max(weight_kg), 6) AS heaviest, round(sum(weight_kg * reps), 3) AS volume, min(date) AS first, max(date) AS last
    FROM sets WHERE date > DATE '{SETS_TODAY}' - 180 AND weight_kg > 0 GROUP BY 1, 2""",
)
def d7(spark, sf):
    found = K.exercise_progress(V.sets(spark, sf), USER, SETS_TODAY)
    recent_only = found  # six exercises a user: all are among the twelve
    return rounded(rounded(recent_only, "best_e1rm", "heaviest"), "volume", digits=3)


@register("d8_best_of_year", with_sql(SETS_SQL) + f"SELECT user_id, exercise, round(max(weight_kg * (1 + reps / 30.0E0)), 6) AS e1rm FROM sets WHERE weight_kg > 0 AND reps BETWEEN 1 AND 12 AND date > DATE '{SETS_TODAY}' - 365 GROUP BY 1, 2")
def d8(spark, sf):
    heavy = K.heavy_sets(V.sets(spark, sf)).where(F.col("date") > F.date_sub(F.lit(SETS_TODAY).cast("date"), 365))
    return rounded(heavy.groupBy("user_id", "exercise").agg(F.max(K.e1rm()).alias("e1rm")), "e1rm")


SESSIONS_SQL = "s AS (SELECT user_id, date, session_name, max(CASE WHEN session_name % 3 = 0 THEN CAST(session_name % 300 AS DOUBLE) END) AS mins, count(*) AS n_sets, min(set_order) AS started_at FROM sets GROUP BY 1, 2, 3)"


@register(
    "a13_strength_sessions",
    with_sql(SETS_SQL, SESSIONS_SQL) + "SELECT user_id, date, session_name, CASE WHEN mins > 0 AND mins <= 240 THEN mins ELSE greatest(20, least(180, CAST(3 * n_sets AS DOUBLE))) END AS duration_min, n_sets, started_at, 'STRENGTH_TRAINING' AS type FROM s",
)
def a13(spark, sf):
    sets = V.sets(spark, sf).withColumn("session_min", F.when(F.col("session_name") % 3 == 0, (F.col("session_name") % 300).cast("double"))).withColumn("started_at", F.col("set_order"))
    return K.strength_sessions(sets, USER)


GOALS = [(0, 1, "2024-01-01", "2024-03-31"), (1, 2, "2024-01-10", "2024-01-25"), (2, 3, "2024-01-05", None)]
TARGETS = [(0, 1, "click", "increase", None, 0.25, 1.0), (0, 1, "view", "decrease", 0.5, 0.2, 2.0), (1, 2, "purchase", "maintain", None, 0.1, 1.0), (1, 2, "error", "increase", 0.1, 0.1, 3.0), (2, 3, "signup", "increase", None, 0.4, 1.0), (2, 3, "click", "decrease", None, None, 1.0)]


def goal_tables(spark, sf):
    goals = spark.createDataFrame(GOALS, "user_id long, goal_id long, s string, e string").select("user_id", "goal_id", F.to_date("s").alias("start_date"), F.to_date("e").alias("target_date"))
    targets = spark.createDataFrame(TARGETS, "user_id long, goal_id long, metric_key string, direction string, baseline double, target_value double, weight double").join(F.broadcast(goals), ["user_id", "goal_id"])
    users = spark.createDataFrame([(u,) for u in range(3)], "user_id long")
    points = V.dense(spark, sf).crossJoin(F.broadcast(users))
    return goals, targets, points


def literal(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)


def values(rows):
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


GOAL_SQL = f"""goals AS (SELECT CAST(user_id AS BIGINT) AS user_id, CAST(goal_id AS BIGINT) AS goal_id, CAST(s AS DATE) AS start_date, CAST(e AS DATE) AS target_date FROM (VALUES {values(GOALS)}) v(user_id, goal_id, s, e)),
targets AS (SELECT t.*, g.start_date, g.target_date FROM (SELECT CAST(user_id AS BIGINT) AS user_id, CAST(goal_id AS BIGINT) AS goal_id, metric_key, direction, CAST(baseline AS DOUBLE) AS baseline, CAST(target_value AS DOUBLE) AS target_value, CAST(weight AS DOUBLE) AS weight
  FROM (VALUES {values(TARGETS)}) v(user_id, goal_id, metric_key, direction, baseline, target_value, weight)) t JOIN goals g ON g.user_id = t.user_id AND g.goal_id = t.goal_id),
base AS (SELECT t.goal_id, t.metric_key, coalesce(max(t.baseline), CASE WHEN count(CASE WHEN date BETWEEN start_date AND start_date + 14 THEN 1 END) >= 3 THEN avg(CASE WHEN date BETWEEN start_date AND start_date + 14 THEN value END)
  ELSE avg(CASE WHEN date BETWEEN start_date - 14 AND start_date + 21 THEN value END) END) AS base FROM targets t LEFT JOIN dense d ON d.metric_key = t.metric_key GROUP BY 1, 2),
seen AS (SELECT t.goal_id, t.metric_key, count(d.date) AS observations, arg_max(value, date) AS current FROM targets t LEFT JOIN dense d ON d.metric_key = t.metric_key AND d.date BETWEEN t.start_date AND DATE '{EVENTS_TODAY}' GROUP BY 1, 2),
o AS (SELECT t.goal_id, t.metric_key, d.value, row_number() OVER (PARTITION BY t.goal_id, t.metric_key ORDER BY d.date) - 1 AS k, count(*) OVER (PARTITION BY t.goal_id, t.metric_key) AS n FROM targets t JOIN dense d ON d.metric_key = t.metric_key AND d.date BETWEEN t.start_date AND DATE '{EVENTS_TODAY}'),
sm AS (SELECT goal_id, metric_key, sum(value * CASE WHEN k = 0 THEN power(power(CAST(2 AS DOUBLE), -1.0 / 7), n - 1) ELSE (1 - power(CAST(2 AS DOUBLE), -1.0 / 7)) * power(power(CAST(2 AS DOUBLE), -1.0 / 7), n - 1 - k) END) AS smoothed FROM o GROUP BY 1, 2),
pr AS (SELECT t.*, base.base, seen.observations, seen.current, sm.smoothed,
  CASE WHEN base IS NULL OR smoothed IS NULL OR target_value IS NULL THEN NULL WHEN direction = 'maintain' THEN greatest(0, least(1, 1 - abs(smoothed - target_value) / (CASE WHEN target_value = 0 THEN 1 ELSE abs(target_value) * 0.05 END)))
    WHEN abs(target_value - base) < 1e-9 THEN CASE WHEN smoothed = target_value THEN 1 END ELSE (smoothed - base) / (target_value - base) END AS progress,
  CASE WHEN target_date - start_date > 0 THEN greatest(0, least(1, (DATE '{EVENTS_TODAY}' - start_date) / CAST(target_date - start_date AS DOUBLE))) END AS expected
  FROM targets t JOIN base ON base.goal_id = t.goal_id AND base.metric_key = t.metric_key JOIN seen ON seen.goal_id = t.goal_id AND seen.metric_key = t.metric_key LEFT JOIN sm ON sm.goal_id = t.goal_id AND sm.metric_key = t.metric_key),
sc AS (SELECT *, CASE WHEN expected > 0.02 THEN progress / expected END AS pace, least(1.0, observations / CAST(DATE '{EVENTS_TODAY}' - start_date + 1 AS DOUBLE)) AS coverage FROM pr),
st AS (SELECT *, CASE WHEN progress IS NULL THEN 'no_data' WHEN progress >= 1 THEN 'achieved' WHEN pace IS NULL THEN CASE WHEN progress > 0 THEN 'on_track' ELSE 'behind' END WHEN pace >= 1.1 THEN 'ahead' WHEN pace >= 0.85 THEN 'on_track' WHEN pace >= 0.5 THEN 'behind' ELSE 'at_risk' END AS status FROM sc)"""


def scored(spark, sf):
    goals, targets, points = goal_tables(spark, sf)
    inside = targets.join(points, ["user_id", "metric_key"]).where(F.col("date").between(F.col("start_date"), F.lit(EVENTS_TODAY).cast("date")))
    smooth = S.ewma(S.grid(inside, G.TARGET), G.TARGET, 7.0).groupBy(*G.TARGET).agg(F.max_by("ewma", "date").alias("smoothed"))
    return goals, G.score_targets(targets, points, smooth, EVENTS_TODAY)


@register("k13_baselines", with_sql(DENSE_SQL, GOAL_SQL) + "SELECT goal_id, metric_key, round(base, 9) AS baseline FROM base")
def k13(spark, sf):
    _, targets, points = goal_tables(spark, sf)
    return rounded(G.window_baseline(points, targets), "baseline", digits=9).select("goal_id", "metric_key", "baseline")


@register(
    "k16_goal_targets",
    with_sql(DENSE_SQL, GOAL_SQL)
    + """SELECT goal_id, metric_key, round(base, 9) AS baseline, round(current, 9) AS current, round(smoothed, 9) AS smoothed, observations, round(coverage, 9) AS coverage, round(progress, 6) AS progress, round(expected, 9) AS expected, round(pace, 6) AS pace, status,
      CASE WHEN observations >= 21 AND coverage >= 0.6 THEN 'high' WHEN observations >= 8 AND coverage >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM st""",
)
def k16(spark, sf):
    _, s = scored(spark, sf)
    return rounded(rounded(s, "baseline", "current", "smoothed", "coverage", "expected", digits=9), "progress", "pace").select("goal_id", "metric_key", "baseline", "current", "smoothed", "observations", "coverage", "progress", "expected", "pace", "status", "confidence")


INDEX_SQL = f""", ix AS (SELECT g.goal_id, sum(CASE WHEN progress IS NOT NULL THEN greatest(0, least(1, progress)) * weight END) / sum(CASE WHEN progress IS NOT NULL THEN weight END) * 100 AS index, max(expected) * 100 AS expected_index, CAST(max(g.target_date) - DATE '{EVENTS_TODAY}' AS INTEGER) AS days_remaining FROM goals g LEFT JOIN st ON st.goal_id = g.goal_id GROUP BY 1),
    pc AS (SELECT *, CASE WHEN expected_index > 2 THEN index / expected_index END AS pace_ratio FROM ix)"""


@register(
    "k17_goal_index",
    with_sql(DENSE_SQL, GOAL_SQL)
    + INDEX_SQL
    + """SELECT goal_id, round(index, 6) AS index, round(expected_index, 6) AS expected_index, round(pace_ratio, 6) AS pace_ratio, CASE WHEN index IS NULL THEN 'no_data' WHEN pace_ratio IS NULL THEN 'on_track' WHEN pace_ratio >= 1.1 THEN 'ahead' WHEN pace_ratio >= 0.85 THEN 'on_track' WHEN pace_ratio >= 0.5 THEN 'behind' ELSE 'at_risk' END AS status, days_remaining FROM pc""",
)
def k17(spark, sf):
    goals, s = scored(spark, sf)
    return rounded(G.goal_index(s, goals, EVENTS_TODAY), "index", "expected_index", "pace_ratio").select("goal_id", "index", "expected_index", "pace_ratio", "status", "days_remaining")


@register(
    "h26_headlines",
    with_sql(DENSE_SQL, GOAL_SQL)
    + INDEX_SQL
    + """, lg AS (SELECT goal_id, list_sort(list(metric_key)) AS names FROM st WHERE status IN ('behind', 'at_risk') GROUP BY 1),
    sx AS (SELECT pc.*, names, CASE WHEN pace_ratio IS NULL OR pace_ratio >= 0.85 AND pace_ratio < 1.1 THEN 'on plan' WHEN pace_ratio >= 1.1 THEN 'ahead of plan' WHEN pace_ratio >= 0.5 THEN 'behind plan' ELSE 'far behind plan' END AS stands FROM pc LEFT JOIN lg ON lg.goal_id = pc.goal_id)
    SELECT goal_id, CASE WHEN index IS NULL THEN 'No index yet: too few values.' ELSE 'Index ' || CAST(floor(index + 0.5) AS INTEGER) || coalesce(' where ' || CAST(floor(expected_index + 0.5) AS INTEGER) || ' was due', '') || ', ' || stands || '.'
      || CASE WHEN names IS NOT NULL AND stands <> 'ahead of plan' THEN ' Slowest: ' || replace(array_to_string(names[1:2], ', '), '_', ' ') || '.' ELSE '' END || CASE WHEN days_remaining > 0 THEN ' Days to go: ' || days_remaining || '.' ELSE '' END END AS headline FROM sx""",
)
def h26(spark, sf):
    goals, s = scored(spark, sf)
    return G.goal_index(s, goals, EVENTS_TODAY).select("goal_id", "headline")


ANCHOR_SQL = "anchors AS (SELECT metric, sex, decade, CAST(pct AS DOUBLE) AS pct, CAST(value AS DOUBLE) AS value, hib FROM (VALUES " + values(
    [(m, sex, d, p, v, HIGHER_IS_BETTER[m]) for m, by in ANCHORS.items() for sex, tables in by.items() for d, vs in zip(DECADES, tables, strict=True) for p, v in zip(PERCENTILES, vs, strict=True)]
) + ") v(metric, sex, decade, pct, value, hib))"
BAND_SQL = "CASE WHEN percentile >= 90 THEN 'top 10%' WHEN percentile >= 75 THEN 'top quarter' WHEN percentile >= 60 THEN 'above average' WHEN percentile >= 40 THEN 'around average' WHEN percentile >= 25 THEN 'below average' ELSE 'bottom quarter' END"
PERSON_SQL = """person AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CASE WHEN 18 + c_custkey % 70 < 30 THEN '20s' WHEN 18 + c_custkey % 70 < 40 THEN '30s' WHEN 18 + c_custkey % 70 < 50 THEN '40s' WHEN 18 + c_custkey % 70 < 60 THEN '50s' WHEN 18 + c_custkey % 70 < 70 THEN '60s' ELSE '70s' END AS decade,
  CASE c_custkey % 3 WHEN 0 THEN 'vo2max' WHEN 1 THEN 'resting_hr' ELSE 'steps' END AS metric, CASE c_custkey % 3 WHEN 0 THEN CAST(15 + c_custkey % 53 AS DOUBLE) WHEN 1 THEN CAST(48 + c_custkey % 43 AS DOUBLE) ELSE CAST(1500 + c_custkey * 37 % 12000 AS DOUBLE) END AS measured FROM customer)"""
STAND_SQL = """lim AS (SELECT metric, sex, decade, min(value) AS lo, max(value) AS hi, min(pct) AS plo, max(pct) AS phi FROM anchors GROUP BY 1, 2, 3),
seg AS (SELECT *, lead(value) OVER w AS v2, lead(pct) OVER w AS p2 FROM anchors WINDOW w AS (PARTITION BY metric, sex, decade ORDER BY value)),
raw AS (SELECT p.*, CASE WHEN measured <= lo THEN plo WHEN measured >= hi THEN phi ELSE s.pct + (measured - s.value) / (s.v2 - s.value) * (s.p2 - s.pct) END AS raw, CASE WHEN measured <= lo THEN -1 WHEN measured >= hi THEN 1 ELSE 0 END AS cap, p.metric <> 'resting_hr' AS hib
  FROM person p JOIN lim ON lim.metric = p.metric AND lim.sex = p.sex AND lim.decade = p.decade LEFT JOIN seg s ON s.metric = p.metric AND s.sex = p.sex AND s.decade = p.decade AND measured > lo AND measured < hi AND s.v2 IS NOT NULL AND measured >= s.value AND measured < s.v2),
res AS (SELECT c_custkey, metric, measured, CAST(floor(CASE WHEN hib THEN raw ELSE 100 - raw END + 0.5) AS INTEGER) AS percentile, CASE WHEN cap = 0 THEN NULL WHEN (cap = 1) = hib THEN 'high' ELSE 'low' END AS capped FROM raw)"""


@register("k18_percentiles", with_sql(ANCHOR_SQL, PERSON_SQL, STAND_SQL) + f"SELECT *, {BAND_SQL} AS band FROM res")
def k18(spark, sf):
    k = F.col("c_custkey")
    people = V.table(spark, sf, "customer").select(
        k, F.when(k % 2 == 0, "male").otherwise("female").alias("sex"), P.decade(18 + k % 70).alias("decade"), F.when(k % 3 == 0, "vo2max").when(k % 3 == 1, "resting_hr").otherwise("steps").alias("metric"),
        F.when(k % 3 == 0, (15 + k % 53).cast("double")).when(k % 3 == 1, (48 + k % 43).cast("double")).otherwise((1500 + k * 37 % 12000).cast("double")).alias("measured"),
    )
    return P.percentiles(people, P.anchors(spark), ["metric", "sex", "decade"], ["c_custkey", "metric"])


@register(
    "k19_recent_means",
    with_sql(SERIES_SQL)
    + """SELECT metric_key, round(avg(value), 9) AS measured, max(date) AS last_date, CAST(DATE '2001-07-15' - max(date) AS INTEGER) AS stale_days, DATE '2001-07-15' - max(date) > 45 AS stale FROM (
      SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY metric_key) AS n FROM series WHERE date >= DATE '2001-07-15' - 180 AND date < DATE '2001-07-15') t WHERE k <= 28 AND n >= 3 GROUP BY 1""",
)
def k19(spark, sf):
    return rounded(P.recent_mean(V.series(spark, sf), ONE, "2001-07-15"), "measured", digits=9)


LIFT_NAMES = "CASE exercise WHEN 'ECONOMY' THEN 'Barbell Squat' WHEN 'LARGE' THEN 'Front squat' WHEN 'MEDIUM' THEN 'Bench Press' WHEN 'PROMO' THEN 'Incline bench  press barbell' WHEN 'SMALL' THEN 'Deadlift' ELSE 'Squatting machine' END"
LIFT_SQL = "lifts AS (SELECT lift, pattern FROM (VALUES " + values([(k, p) for k, (p, _) in LIFTS.items()]) + ") v(lift, pattern))"


@register(
    "c12_regex_lifts",
    with_sql(SETS_SQL, LIFT_SQL)
    + f""", b AS (SELECT user_id, {LIFT_NAMES} AS exercise, max(weight_kg * (1 + reps / 30.0E0)) AS e1rm FROM sets WHERE weight_kg > 0 AND reps BETWEEN 1 AND 12 GROUP BY 1, 2)
    SELECT user_id, lift, exercise, round(e1rm, 6) AS e1rm FROM (SELECT b.*, lift, row_number() OVER (PARTITION BY user_id, lift ORDER BY regexp_matches(exercise, '(?i)barbell') DESC, e1rm DESC, exercise) AS k FROM b JOIN lifts ON regexp_matches(exercise, pattern)) t WHERE k = 1""",
)
def c12(spark, sf):
    best = K.heavy_sets(V.sets(spark, sf)).withColumn("exercise", F.expr(LIFT_NAMES)).groupBy("user_id", "exercise").agg(F.max(K.e1rm()).alias("e1rm"))
    return rounded(P.best_lifts(best, P.lift_anchors(spark), USER), "e1rm").select("user_id", "lift", "exercise", "e1rm")


LIFT_ANCHOR_SQL = "anchors AS (SELECT lift, sex, CAST(pct AS DOUBLE) AS pct, CAST(value AS DOUBLE) AS value FROM (VALUES " + values([(k, sex, p, v) for k, (_, by) in LIFTS.items() for sex, vs in by.items() for p, v in zip(PERCENTILES, vs, strict=True)]) + ") v(lift, sex, pct, value))"


@register(
    "k20_relative_strength",
    with_sql(SETS_SQL, LIFT_SQL, LIFT_ANCHOR_SQL)
    + f""", b AS (SELECT user_id, {LIFT_NAMES} AS exercise, max(weight_kg * (1 + reps / 30.0E0)) AS e1rm FROM sets WHERE weight_kg > 0 AND reps BETWEEN 1 AND 12 GROUP BY 1, 2),
    p AS (SELECT user_id, lift, exercise, e1rm / 80.0 AS measured, CASE WHEN user_id % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM (SELECT b.*, lift, row_number() OVER (PARTITION BY user_id, lift ORDER BY regexp_matches(exercise, '(?i)barbell') DESC, e1rm DESC, exercise) AS k FROM b JOIN lifts ON regexp_matches(exercise, pattern)) t WHERE k = 1),
    lim AS (SELECT lift, sex, min(value) AS lo, max(value) AS hi, min(pct) AS plo, max(pct) AS phi FROM anchors GROUP BY 1, 2), seg AS (SELECT *, lead(value) OVER w AS v2, lead(pct) OVER w AS p2 FROM anchors WINDOW w AS (PARTITION BY lift, sex ORDER BY value)),
    r AS (SELECT user_id, p.lift, exercise, measured, CASE WHEN measured <= lo THEN plo WHEN measured >= hi THEN phi ELSE s.pct + (measured - s.value) / (s.v2 - s.value) * (s.p2 - s.pct) END AS raw, CASE WHEN measured <= lo THEN 'low' WHEN measured >= hi THEN 'high' END AS capped
      FROM p JOIN lim ON lim.lift = p.lift AND lim.sex = p.sex LEFT JOIN seg s ON s.lift = p.lift AND s.sex = p.sex AND measured > lo AND measured < hi AND s.v2 IS NOT NULL AND measured >= s.value AND measured < s.v2),
    q AS (SELECT user_id, lift, exercise, round(measured, 6) AS measured, CAST(floor(raw + 0.5) AS INTEGER) AS percentile, capped FROM r)
    SELECT *, {BAND_SQL} AS band FROM q""",
)
def k20(spark, sf):
    best = K.heavy_sets(V.sets(spark, sf)).withColumn("exercise", F.expr(LIFT_NAMES)).groupBy("user_id", "exercise").agg(F.max(K.e1rm()).alias("e1rm"))
    lifts = P.best_lifts(best, P.lift_anchors(spark), USER).withColumn("measured", F.col("e1rm") / 80.0).withColumn("sex", F.when(F.col("user_id") % 2 == 0, "male").otherwise("female"))
    anchors = P.lift_anchors(spark).select("lift", "sex", "pct", "value", F.lit(True).alias("higher_is_better"))
    return rounded(P.percentiles(lifts, anchors, ["lift", "sex"], ["user_id", "lift", "exercise"]), "measured")


PROPOSED = [("click", "increase", 0.0001, 5.0), ("view", "sideways", 9.0, None), ("weight_kg", "decrease", 5.0, 2.0), ("purchase", "maintain", None, 0.5), ("nonsense", "increase", 1.0, 1.0)]


@register(
    "k21_goal_checks",
    with_sql(DENSE_SQL)
    + f""", s AS (SELECT metric_key, count(*) AS n, avg(CASE WHEN date > DATE '2024-02-20' - 14 THEN value END) AS recent, avg(CASE WHEN date > DATE '2024-02-20' - 90 THEN value END) AS longer, max(date) AS last FROM dense GROUP BY 1 UNION ALL SELECT 'weight_kg', 0, NULL, NULL, NULL),
    p AS (SELECT metric_key, CASE WHEN direction IN ('increase', 'decrease', 'maintain') THEN direction ELSE 'increase' END AS direction, CAST(tv AS DOUBLE) AS target_value, greatest(1, least(3, coalesce(CAST(w AS DOUBLE), 1))) AS weight FROM (VALUES {values(PROPOSED)}) v(metric_key, direction, tv, w)),
    j AS (SELECT p.*, s.n, coalesce(recent, longer) AS anchor, recent, last FROM p LEFT JOIN s ON s.metric_key = p.metric_key)
    SELECT metric_key, direction, target_value, weight, n IS NOT NULL AS kept, coalesce(n > 0 AND recent IS NULL, FALSE) AS stale,
      concat_ws('; ', CASE WHEN n IS NULL THEN 'not tracked' END, CASE WHEN n IS NOT NULL AND metric_key = 'weight_kg' AND (target_value < 30 OR target_value > 250) THEN 'outside plausible range' END,
        CASE WHEN n IS NOT NULL AND ((direction = 'increase' AND target_value <= anchor) OR (direction = 'decrease' AND target_value >= anchor)) THEN 'wrong side of current value' END, CASE WHEN n = 0 THEN 'never logged' END,
        CASE WHEN n > 0 AND recent IS NULL THEN 'last recorded ' || (DATE '2024-02-20' - last) || ' days ago' END) AS warnings FROM j""",
)
def k21(spark, sf):
    day = F.lit("2024-02-20").cast("date")
    avg = lambda n: F.avg(F.when(F.col("date") > F.date_sub(day, n), F.col("value")))
    stats = V.dense(spark, sf).groupBy("metric_key").agg(F.count("*").alias("n"), avg(14).alias("recent"), avg(90).alias("longer"), F.max("date").alias("last"))
    stats = stats.unionByName(spark.createDataFrame([("weight_kg", 0, None, None, None)], "metric_key string, n long, recent double, longer double, last date"))
    ranges = spark.createDataFrame([(k, float(a), float(z)) for k, (a, z) in PLAUSIBLE_RANGES.items()], "metric_key string, low double, high double")
    proposed = spark.createDataFrame(PROPOSED, "metric_key string, direction string, target_value double, weight double")
    return G.check_targets(proposed, stats, ranges, "2024-02-20")


DOMAIN = {"view": "weight_kg", "click": "body_fat_pct", "purchase": "resting_hr", "signup": "hrv_ms", "error": "sleep_hours"}


def as_domain(points):
    """The events' metrics under the names that derivation and report read."""
    return points.replace(DOMAIN, subset=["metric_key"])


DOMAIN_SQL = (
    "dom AS (SELECT user_id, date, value, CASE metric_key "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DOMAIN.items())
    + " ELSE metric_key END AS metric_key FROM resolved)"
)
HEART_SQL = """heart AS (SELECT user_id, median(value) AS resting FROM dom WHERE metric_key = 'resting_hr' GROUP BY 1),
worked AS (SELECT best.*, coalesce(resting, 55.0) AS resting FROM best LEFT JOIN heart ON heart.user_id = best.user_id),
loaded AS (SELECT *, CASE WHEN duration_min <= 0 THEN 0 ELSE least(600, CASE WHEN coalesce(avg_hr, 0) <> 0 AND resting < 190 THEN duration_min * hrr * 0.64 * exp(1.92 * hrr) WHEN coalesce(rpe, 0) <> 0 THEN duration_min * rpe ELSE duration_min * 2.5 END) END AS load
  FROM (SELECT *, greatest(0, least(1, (avg_hr - resting) / nullif(190.0 - resting, 0))) AS hrr FROM worked) t)"""
DERIVED_SQL = """mass AS (SELECT w.user_id, w.date, w.value * (b.value / 100) AS fat, w.value * (1 - b.value / 100) AS lean FROM dom w JOIN dom b ON b.user_id = w.user_id AND b.date = w.date AND w.metric_key = 'weight_kg' AND b.metric_key = 'body_fat_pct'),
form AS (SELECT user_id, date, load, ctl, atl, lag(ctl - atl) OVER (PARTITION BY user_id ORDER BY date) AS tsb FROM m),
z AS (SELECT user_id, metric_key, date, CASE WHEN n >= 10 AND sd > 0 THEN (value - mean) / sd END AS z FROM (
  SELECT *, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd FROM dom WHERE metric_key IN ('hrv_ms', 'resting_hr', 'sleep_hours') WINDOW w AS (PARTITION BY user_id, metric_key ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) t),
part AS (SELECT user_id, date, 50 + 20 * greatest(-2.5, least(2.5, CASE WHEN metric_key = 'resting_hr' THEN -z ELSE z END)) AS score, CASE metric_key WHEN 'hrv_ms' THEN 0.35 WHEN 'resting_hr' THEN 0.30 ELSE 0.25 END AS w FROM z WHERE z IS NOT NULL
  UNION ALL SELECT user_id, date, 50 + 0.8 * greatest(-40, least(25, tsb)), 0.1 FROM form WHERE tsb IS NOT NULL),
ready AS (SELECT user_id, date, greatest(0, least(100, sum(score * w) / sum(w))) AS value FROM part GROUP BY 1, 2 HAVING round(CAST(sum(w) AS DOUBLE), 9) >= 0.5),
day AS (SELECT user_id, date, sum(weight_kg * reps) AS v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(reps) AS DOUBLE) AS r, CAST(count(CASE WHEN rpe >= 7 THEN 1 END) AS DOUBLE) AS h, max(weight_kg) AS t FROM sets GROUP BY 1, 2),
heavy AS (SELECT * FROM sets WHERE weight_kg > 0 AND reps BETWEEN 1 AND 12),
main AS (SELECT user_id, exercise FROM (SELECT user_id, exercise, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, exercise) AS k FROM heavy GROUP BY 1, 2) t WHERE k <= 6),
e AS (SELECT heavy.user_id, heavy.exercise, date, max(weight_kg * (1 + reps / 30.0E0)) AS best FROM heavy JOIN main ON main.user_id = heavy.user_id AND main.exercise = heavy.exercise GROUP BY 1, 2, 3),
lifted AS (SELECT DISTINCT user_id, date FROM e),
tops AS (SELECT lifted.user_id, lifted.date, e.exercise, max(e.best) AS top FROM lifted JOIN e ON e.user_id = lifted.user_id AND e.date <= lifted.date GROUP BY 1, 2, 3),
every AS (SELECT user_id, date, 'lean_mass_kg' AS metric_key, lean AS value FROM mass UNION ALL SELECT user_id, date, 'fat_mass_kg', fat FROM mass
  UNION ALL SELECT user_id, date, 'training_load', load FROM daily UNION ALL SELECT user_id, date, 'workout_min', minutes FROM daily WHERE minutes > 0
  UNION ALL SELECT user_id, date, 'ctl', ctl FROM form UNION ALL SELECT user_id, date, 'atl', atl FROM form UNION ALL SELECT user_id, date, 'tsb', tsb FROM form UNION ALL SELECT user_id, date, 'acwr', CASE WHEN ctl > 1 THEN atl / ctl END FROM form
  UNION ALL SELECT user_id, date, 'readiness', value FROM ready
  UNION ALL SELECT user_id, date, 'training_volume_kg', v FROM day WHERE v <> 0 UNION ALL SELECT user_id, date, 'sets_count', n FROM day WHERE n <> 0 UNION ALL SELECT user_id, date, 'reps_total', r FROM day WHERE r <> 0
  UNION ALL SELECT user_id, date, 'hard_sets', h FROM day WHERE h <> 0 UNION ALL SELECT user_id, date, 'top_set_kg', t FROM day WHERE t <> 0
  UNION ALL SELECT user_id, date, 'strength_index', sum(top) FROM tops GROUP BY 1, 2)"""
RECOMPUTED_SQL = (
    recursive_sql(RESOLVED_SQL, DOMAIN_SQL, WORKOUTS_SQL, BEST_SQL, HEART_SQL, DAILY_SQL, GRID_OF_LOADS_SQL, SCAN_SQL, SETS_SQL, DERIVED_SQL)
    + "SELECT user_id, date, metric_key, round(CAST(value AS DOUBLE), 7) AS value, 'derived' AS source FROM every WHERE value IS NOT NULL"
)


def domain_store(points):
    return as_domain(T.resolve(points).select("user_id", "metric_key", "date", "value"))


@register("k11_recompute_derived", RECOMPUTED_SQL)
def k11(spark, sf):
    """All derived metrics of all users in one job."""
    return rounded(derive.recompute(domain_store(V.store(spark, sf)), V.workouts(spark, sf), V.sets(spark, sf)), "value", digits=7)


@register("k11_recompute_affected", RECOMPUTED_SQL)
def k11_affected(spark, sf):
    """Derived metrics after late rows, of the users and days that these affect: the same as all of them anew.

    Late are the readings of every fourth day of the store, and the sessions and sets of its last days.
    """
    path, day = V.scratch(spark, "derived"), F.col("date")
    points, workouts, sets = V.store(spark, sf), V.workouts(spark, sf), V.sets(spark, sf)
    late = (F.dayofmonth("date") % 4 == 0, day >= F.lit("2001-06-01").cast("date"), day >= F.lit("1998-09-01").cast("date"))
    before = [frame.where(~is_late) for frame, is_late in zip((points, workouts, sets), late, strict=True)]
    derive.recompute(domain_store(before[0]), *before[1:]).write.parquet(f"{path}/before")
    first = F.min("date").alias("first_day")
    changes = as_domain(points.where(late[0]).groupBy("user_id", "metric_key").agg(first))
    for frame, name, is_late in ((workouts, "workouts", late[1]), (sets, "sets", late[2])):
        changes = changes.unionByName(frame.where(is_late).groupBy("user_id").agg(first).withColumn("metric_key", F.lit(name)))
    changes.write.parquet(f"{path}/changes")
    old = spark.read.parquet(f"{path}/before")
    rows, slices = derive.recompute_affected(domain_store(points), workouts, sets, old, spark.read.parquet(f"{path}/changes"))
    return rounded(derive.replaced(old, rows, slices), "value", digits=7)


@register(
    "k22_snapshot_values",
    with_sql(DENSE_SQL)
    + f""", r AS (SELECT * FROM dense WHERE date >= DATE '{EVENTS_TODAY}' - 180),
    m AS (SELECT metric_key, max(date) AS latest_date, arg_max(value, date) AS latest, avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 7 THEN value END) AS a7, avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 14 AND date <= DATE '{EVENTS_TODAY}' - 7 THEN value END) AS p7,
      avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 28 THEN value END) AS a28 FROM r GROUP BY 1)
    SELECT metric_key, round(latest, 6) AS latest, latest_date, round(a7, 6) AS avg7, round(a28, 6) AS avg28, round(CASE WHEN p7 <> 0 THEN (a7 - p7) / abs(p7) * 100 END, 6) AS delta_pct FROM m""",
)
def k22_values(spark, sf):
    """The numbers of the snapshots; their trends are in ``k22_snapshots``."""
    return report.snapshots(V.dense(spark, sf), ONE, EVENTS_TODAY).select("metric_key", "latest", "latest_date", "avg7", "avg28", "delta_pct")


@register("k22_snapshots")
def k22(spark, sf):
    return report.snapshots(V.dense(spark, sf), ONE, EVENTS_TODAY)


@register("t_list_metrics", ORACLE["d1_inventory"].replace("SELECT s.user_id, s.metric_key,", "SELECT s.user_id, s.metric_key, s.metric_key AS label, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS category,"))
def t1(spark, sf):
    store = V.store(spark, sf)
    return tools.list_metrics(store, T.definitions(spark), EVENTS_TODAY)


@register(
    "t_describe_metric",
    with_sql(DENSE_SQL)
    + f"""SELECT metric_key, count(*) AS n, round(avg(value), 8) AS mean, round(median(value), 8) AS median, round(stddev_samp(value), 8) AS sd, round(quantile_cont(value, 0.1), 8) AS p10, round(quantile_cont(value, 0.9), 8) AS p90, round(min(value), 8) AS min, round(max(value), 8) AS max,
      round(arg_max(value, date), 8) AS latest, max(date) AS latest_date, round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 7 AND date < DATE '{EVENTS_TODAY}' THEN value END), 8) AS avg7, round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 28 AND date < DATE '{EVENTS_TODAY}' THEN value END), 8) AS avg28,
      round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 90 AND date < DATE '{EVENTS_TODAY}' THEN value END), 8) AS avg90, min(date) AS first, max(date) < DATE '{EVENTS_TODAY}' - 10 AS stale FROM dense GROUP BY 1""",
)
def t2(spark, sf):
    found = tools.describe_metric(V.dense(spark, sf), ONE, EVENTS_TODAY)
    return rounded(found, "mean", "median", "sd", "p10", "p90", "min", "max", "latest", "avg7", "avg28", "avg90", digits=8)


@register("t_analyse_metric", VERDICT_SQL.replace("SELECT p.metric_key, e.n,", f"SELECT p.metric_key, e.n, round(sen * 7, 6) AS per_week, DATE '{ORDERS_TODAY}' AS as_of,"))
def t3(spark, sf):
    found = tools.analyse_metric(V.series(spark, sf), ONE, ORDERS_TODAY, 365)["trend"]
    return rounded(found, "per_week", "mk_p", "drift_p", "change_pct").select("metric_key", "n", "per_week", "as_of", "mk_p", "drift_p", "significant", "direction", "change_pct")


LAGS_SQL = """l AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS lag),
al AS (SELECT 'view' AS driver, 'click' AS target, l.lag, x.value AS x, y.value AS y FROM dense x, l, dense y WHERE y.date = x.date + CAST(l.lag AS INTEGER) AND x.metric_key = 'view' AND y.metric_key = 'click'),
rk AS (SELECT driver, target, lag, rank() OVER (PARTITION BY lag ORDER BY x) + (count(*) OVER (PARTITION BY lag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lag ORDER BY y) + (count(*) OVER (PARTITION BY lag, y) - 1) / 2.0 AS ry FROM al),
co AS (SELECT driver, target, lag, count(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 10)"""


@register("t_compare_metrics", with_sql(DENSE_SQL, LAGS_SQL) + f"SELECT target, driver, lag, n, round(r, 6) AS r, round({fisher_p_sql('r', 'n')}, 6) AS p, {fisher_p_sql('r', 'n')} < 0.05 AS significant FROM co")
def t4(spark, sf):
    return rounded(tools.compare_metrics(V.dense(spark, sf), "click", "view", EVENTS_TODAY, 180)["lags"], "r", "p")


@register("t_find_drivers")
def t5(spark, sf):
    return tools.find_drivers(V.dense(spark, sf), "click", EVENTS_TODAY, 365)


@register("t_forecast_metric")
def t6(spark, sf):
    return tools.forecast_metric(V.dense(spark, sf), "click", 30)["bands"]


@register("t_get_series", with_sql(SERIES_SQL) + "SELECT CAST(f + CAST(floor((date - f) / 5.0) * 5 AS INTEGER) AS DATE) AS date, round(CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE) / count(value), 6) AS value FROM (SELECT *, min(date) OVER () AS f FROM series WHERE metric_key = '2-HIGH' AND date BETWEEN DATE '2001-02-02' AND DATE '2001-08-01') t GROUP BY 1")
def t7(spark, sf):
    return rounded(tools.get_series(V.series(spark, sf), "2-HIGH", "2001-08-01", 180), "value")


@register(
    "t_get_workouts",
    with_sql(*CHAIN_SQL)
    + """SELECT w.user_id, w.date, w.type, w.external_id, round(d.load, 6) AS load FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, external_id DESC) AS k FROM workouts WHERE date > DATE '2001-08-01' - 60) w
    LEFT JOIN daily d ON d.user_id = w.user_id AND d.date = w.date WHERE k <= 60""",
)
def t8(spark, sf):
    return rounded(tools.get_workouts(V.workouts(spark, sf), K.daily_load(loaded(spark, sf)), "2001-08-01", 60), "load").select("user_id", "date", "type", "external_id", "load")


@register("t_get_strength", ORACLE["d7_exercise_progress"])
def t9(spark, sf):
    return rounded(rounded(tools.get_strength(V.sets(spark, sf), USER, SETS_TODAY, 180), "best_e1rm", "heaviest"), "volume", digits=3)


@register(
    "t_get_notes",
    "SELECT conv_id, turn, substr(text, 1, 400) AS note FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY turn DESC, conv_id) AS k FROM conversations WHERE text IS NOT NULL) t WHERE role = 'user' AND k <= 25",
)
def t10(spark, sf):
    notes = V.table(spark, sf, "conversations").where("role = 'user'").select(F.lit(0).alias("user_id"), F.col("turn").alias("date"), F.col("conv_id").alias("id"), F.col("text").alias("body"))
    return tools.get_notes(notes, None, 25).select(F.col("id").alias("conv_id"), F.col("date").alias("turn"), "note")


@register("r_full_report")
def full(spark, sf):
    """Every section of the report in one long table, from a written store; sessions are moved to end at the events' last day."""
    goals, targets, points = goal_tables(spark, sf)
    moved = F.date_diff(F.lit(EVENTS_TODAY).cast("date"), F.lit(ORDERS_TODAY).cast("date"))
    sessions = V.workouts(spark, sf).where("user_id < 3").withColumn("date", F.date_add("date", moved))
    path, columns = V.scratch(spark, "report"), ("user_id", "metric_key", "date", "value")
    points = points.select(*columns)
    points.unionByName(as_domain(points)).write.parquet(path)
    held = spark.read.parquet(path)
    derive.recompute(held, sessions, V.sets(spark, sf).where("user_id < 3")).select(*columns).write.mode("append").parquet(path)
    every = spark.read.parquet(path)
    return report.full_report(every, V.store(spark, sf), goals, targets, EVENTS_TODAY)

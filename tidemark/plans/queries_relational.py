"""Queries of small relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.stats import half_up
from tidemark.operators import goals as G
from tidemark.operators import relational as L
from tidemark.operators import relations as R
from tidemark.operators import series as S
from tidemark.operators import store as T
from tidemark.plans import views as V
from tidemark.plans.queries_series import ONE, rounded
from tidemark.plans.views import DENSE_SQL, EVENTS_TODAY, RESOLVED_SQL, SERIES_SQL, STORE_SQL, WORKOUTS_SQL, with_sql
from tidemark.registry import register


@register("b4_finite_filter", "SELECT event_id, value FROM (SELECT event_id, CASE event_id % 10 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN NULL ELSE value END AS value FROM events) t WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)")
def b4(spark, sf):
    from tidemark.functions.stats import finite

    k = F.col("event_id") % 10
    rows = V.table(spark, sf, "events").select("event_id", F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("value")).alias("value"))
    return rows.where(finite("value"))


PAIRS_SQL = "pairs AS (SELECT a, b FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, xs in vocab.DERIVED_FROM.items() for b in xs) + ") v(a, b))"
KEYS = sorted({*vocab.DERIVED_FROM, *(x for xs in vocab.DERIVED_FROM.values() for x in xs)})


@register(
    "b5_derived_pairs",
    f"WITH {PAIRS_SQL}, k AS (SELECT unnest({KEYS!r}) AS k) SELECT x.k AS a, y.k AS b FROM k x, k y WHERE x.k <> y.k AND NOT EXISTS (SELECT 1 FROM pairs p WHERE (p.a = x.k AND p.b = y.k) OR (p.a = y.k AND p.b = x.k))",
)
def b5(spark, sf):
    keys = spark.createDataFrame([(k,) for k in KEYS], "a string")
    pairs = keys.crossJoin(keys.withColumnRenamed("a", "b")).where("a <> b")  # a closed vocabulary of 13 keys
    return R.not_derived(pairs, "a", "b")


RANGE_SQL = "ranges AS (SELECT metric_key, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM (VALUES " + ", ".join(f"('{k}', {a}, {z})" for k, (a, z) in vocab.PLAUSIBLE_RANGES.items()) + ") v(metric_key, low, high))"


def ranges(spark):
    return spark.createDataFrame([(k, float(a), float(z)) for k, (a, z) in vocab.PLAUSIBLE_RANGES.items()], "metric_key string, low double, high double")


NAMED = "CASE metric_key WHEN 'click' THEN 'sleep_hours' WHEN 'view' THEN 'weight_kg' WHEN 'purchase' THEN 'mood' WHEN 'signup' THEN 'hrv_ms' ELSE 'unknown' END"


@register("b6_plausible_values", with_sql(STORE_SQL, RANGE_SQL) + f"SELECT s.seq, s.metric_key, value BETWEEN low AND high AS plausible FROM (SELECT seq, value, {NAMED} AS metric_key FROM store) s LEFT JOIN ranges r ON r.metric_key = s.metric_key")
def b6(spark, sf):
    named = V.store(spark, sf).select("seq", "value", F.expr(NAMED).alias("metric_key"))
    return named.join(F.broadcast(ranges(spark)), "metric_key", "left").select("seq", "metric_key", F.col("value").between(F.col("low"), F.col("high")).alias("plausible"))


@register("b7_staleness", with_sql(STORE_SQL) + "SELECT user_id, metric_key, max(date) AS last, DATE '2024-02-05' - max(date) > 10 AS stale FROM store GROUP BY 1, 2")
def b7(spark, sf):
    last = V.store(spark, sf).groupBy("user_id", "metric_key").agg(F.max("date").alias("last"))
    return last.withColumn("stale", F.date_diff(F.lit("2024-02-05").cast("date"), "last") > 10)


@register("b9_favourable", with_sql(DENSE_SQL) + ", d AS (SELECT metric_key, date, round(value - lag(value) OVER (PARTITION BY metric_key ORDER BY date), 10) AS delta, CASE metric_key WHEN 'click' THEN TRUE WHEN 'view' THEN FALSE END AS hib FROM dense) SELECT metric_key, date, CASE WHEN delta <> 0 THEN (delta > 0) = hib END AS favourable FROM d")
def b9(spark, sf):
    d = S.differences(V.dense(spark, sf), ONE).withColumn("hib", F.when(F.col("metric_key") == "click", True).when(F.col("metric_key") == "view", False))
    return d.select("metric_key", "date", L.favourable(F.round("diff", 10), F.col("hib")).alias("favourable"))


@register("o9_bands", "SELECT c_custkey, CASE WHEN c_acctbal >= 6500 THEN 'high' WHEN c_acctbal >= 3500 THEN 'middle' WHEN c_acctbal IS NOT NULL THEN 'low' END AS band, floor(c_acctbal * 10 + 0.5) / 10 AS shown FROM customer")
def o9(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", L.three_bands(F.col("c_acctbal"), 6500, 3500).alias("band"), half_up(F.col("c_acctbal"), 1).alias("shown"))


@register("c1_targets_of_goals", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")
def c1(spark, sf):
    goals = V.table(spark, sf, "nation").where("n_regionkey = 1")
    return V.table(spark, sf, "supplier").join(F.broadcast(goals), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_name", "n_name")


@register("c3_align_at_lag", with_sql(DENSE_SQL) + "SELECT y.date, round(x.value, 9) AS x, round(y.value, 9) AS y FROM dense x JOIN dense y ON y.date = x.date + 2 WHERE x.metric_key = 'click' AND y.metric_key = 'view'")
def c3(spark, sf):
    d = V.dense(spark, sf)
    return rounded(R.align(d.where("metric_key = 'click'"), d.where("metric_key = 'view'"), 2), "x", "y", digits=9)


@register(
    "c4_complete_cases",
    with_sql(DENSE_SQL) + "SELECT y.date, round(y.value, 9) AS view, round(a.value, 9) AS click, round(b.value, 9) AS purchase FROM dense y JOIN dense a ON a.date = y.date - 1 AND a.metric_key = 'click' JOIN dense b ON b.date = y.date - 3 AND b.metric_key = 'purchase' WHERE y.metric_key = 'view'",
)
def c4(spark, sf):
    d, lags = V.dense(spark, sf), {"click": 1, "purchase": 3, "view": 0}
    lag = F.expr("CASE metric_key " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in lags.items()) + " END")
    wide = d.where(F.col("metric_key").isin(*lags)).withColumn("date", F.date_add("date", lag)).groupBy("date").pivot("metric_key", list(lags)).agg(F.first("value"))
    return rounded(wide.dropna(), "view", "click", "purchase", digits=9)


@register("c7_union_of_dates", with_sql(DENSE_SQL) + "SELECT date, round(max(CASE WHEN metric_key = 'click' THEN value END), 9) AS click, round(max(CASE WHEN metric_key = 'view' THEN value END), 9) AS view FROM dense WHERE (metric_key = 'click' AND date < DATE '2024-01-20') OR (metric_key = 'view' AND date > DATE '2024-01-10') GROUP BY 1")
def c7(spark, sf):
    d = V.dense(spark, sf).where("(metric_key = 'click' AND date < DATE '2024-01-20') OR (metric_key = 'view' AND date > DATE '2024-01-10')")
    return rounded(d.groupBy("date").pivot("metric_key", ["click", "view"]).agg(F.first("value")), "click", "view", digits=9)


@register("c11_lookups", with_sql(WORKOUTS_SQL) + "SELECT w.external_id, CASE WHEN c_custkey IS NULL THEN w.type ELSE c_mktsegment END AS label FROM workouts w LEFT JOIN customer ON c_custkey = w.external_id % 3000 + 1")
def c11(spark, sf):
    labels = V.table(spark, sf, "customer").select((F.col("c_custkey")).alias("k"), "c_mktsegment")
    w = V.workouts(spark, sf).withColumn("k", F.col("external_id") % 3000 + 1)
    return w.join(labels, "k", "left").select("external_id", F.coalesce("c_mktsegment", "type").alias("label"))


@register("d5_conditional_counts", "SELECT l_suppkey, count(*) AS n, count(CASE WHEN l_discount >= 0.07 THEN 1 END) AS hard, max(l_quantity) AS top, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def d5(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") >= 0.07).alias("hard"), F.max("l_quantity").alias("top"), F.countDistinct("l_partkey").alias("parts"))


@register("d10_scalar_counts", "SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS last_order, (SELECT count(*) FROM events WHERE event_type = 'click') AS clicks")
def d10(spark, sf):
    orders = V.table(spark, sf, "orders").agg(F.count("*").alias("n_orders"), F.max(F.to_date("o_orderdate")).alias("last_order"))
    clicks = V.table(spark, sf, "events").where("event_type = 'click'").agg(F.count("*").alias("clicks"))
    return orders.crossJoin(clicks)  # one row each


@register("d13_count_by_type", with_sql(WORKOUTS_SQL) + "SELECT type, count(*) AS n FROM workouts GROUP BY 1")
def d13(spark, sf):
    return V.workouts(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@register(
    "d14_goal_vocabulary",
    with_sql(DENSE_SQL)
    + f"""SELECT metric_key, count(*) AS n, round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 14 THEN value END), 9) AS recent, round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 90 THEN value END), 9) AS longer, round(min(value), 9) AS low, round(max(value), 9) AS high, max(date) AS last
    FROM dense WHERE date < DATE '{EVENTS_TODAY}' GROUP BY 1""",
)
def d14(spark, sf):
    day = F.lit(EVENTS_TODAY).cast("date")
    avg = lambda n: F.round(F.avg(F.when(F.col("date") > F.date_sub(day, n), F.col("value"))), 9)
    return V.dense(spark, sf).where(F.col("date") < day).groupBy("metric_key").agg(F.count("*").alias("n"), avg(14).alias("recent"), avg(90).alias("longer"), F.round(F.min("value"), 9).alias("low"), F.round(F.max("value"), 9).alias("high"), F.max("date").alias("last"))


@register("d16_latest_of_each", "SELECT event_type, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) t WHERE k = 1")
def d16(spark, sf):
    latest = F.max_by(F.struct("user_id", "ts"), F.struct("ts", "event_id")).alias("r")
    return V.table(spark, sf, "events").groupBy("event_type").agg(latest).select("event_type", "r.user_id", "r.ts")


@register("d17_counts_per_metric", with_sql(RESOLVED_SQL) + "SELECT metric_key, count(*) AS n FROM resolved GROUP BY 1")
def d17(spark, sf):
    return T.resolve(V.store(spark, sf)).groupBy("metric_key").agg(F.count("*").alias("n"))


@register("f2_newest_events", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) t WHERE k <= 8")
def f2(spark, sf):
    return L.newest(V.table(spark, sf, "events"), ["user_id"], 8, [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@register("f3_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def f3(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)


@register("g1_key_sets", "SELECT event_type AS k FROM events UNION SELECT o_orderpriority FROM orders EXCEPT SELECT 'click'")
def g1(spark, sf):
    keys = V.table(spark, sf, "events").select(F.col("event_type").alias("k")).union(V.table(spark, sf, "orders").select("o_orderpriority")).distinct()
    return keys.where("k <> 'click'")


@register("g2_bag_union", "SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'event', event_id FROM events")
def g2(spark, sf):
    a = V.table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return L.together([a, V.table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))])


@register(
    "o4_heatmap",
    with_sql(DENSE_SQL)
    + """, c AS (SELECT k.metric_key, CAST(d AS DATE) AS date FROM (SELECT DISTINCT metric_key FROM dense) k, unnest(generate_series(TIMESTAMP '2024-02-03' - INTERVAL 34 DAY, TIMESTAMP '2024-02-03', INTERVAL 1 DAY)) u(d)),
    j AS (SELECT c.metric_key, c.date, d.value FROM c LEFT JOIN dense d ON d.metric_key = c.metric_key AND d.date = c.date)
    SELECT metric_key, date, CAST(dayofweek(date) AS INTEGER) AS row, round((value - min(value) OVER (PARTITION BY metric_key)) / (max(value) OVER (PARTITION BY metric_key) - min(value) OVER (PARTITION BY metric_key)), 9) AS shade FROM j""",
)
def o4(spark, sf):
    return L.heatmap(V.dense(spark, sf), ONE, EVENTS_TODAY, 5).select("metric_key", "date", "row", F.round("shade", 9).alias("shade"))


@register("o6_domain", with_sql(SERIES_SQL) + "SELECT metric_key, round(min(value) - (max(value) - min(value)) * 0.12, 9) AS low, round(max(value) + (max(value) - min(value)) * 0.12, 9) AS high FROM series GROUP BY 1")
def o6(spark, sf):
    return rounded(L.domain(V.series(spark, sf), ONE), "low", "high", digits=9)


@register("o7_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(concat_ws(chr(10), p_name, p_brand, p_type)), 'economy')")
def o7(spark, sf):
    named = L.search(V.table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], " Economy ")
    return L.search(named, ["p_name"], "A").select("p_partkey", "p_name")


@register("o10_slugs", "SELECT p_partkey, CASE WHEN s = '' THEN 'custom' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS s FROM part) t")
def o10(spark, sf):
    from tidemark.functions.parse import slug

    return V.table(spark, sf, "part").select("p_partkey", slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


GOAL_ROWS = "goals AS (SELECT o_custkey AS user_id, o_orderkey AS goal_id, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'done' END AS status, CAST(o_orderdate AS DATE) AS start_date, o_orderpriority AS title FROM orders)"


def goal_rows(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("goal_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("done").alias("status"), F.to_date("o_orderdate").alias("start_date"), F.col("o_orderpriority").alias("title"))


@register("o1_one_active_goal", with_sql(GOAL_ROWS, "act AS (SELECT user_id, max(goal_id) AS g FROM goals WHERE user_id % 2 = 0 GROUP BY 1)") + "SELECT goals.user_id, goal_id, CASE WHEN goal_id = g THEN 'active' WHEN g IS NOT NULL AND status = 'active' THEN 'archived' ELSE status END AS status FROM goals LEFT JOIN act ON act.user_id = goals.user_id")
def o1(spark, sf):
    goals = goal_rows(spark, sf)
    chosen = goals.where("user_id % 2 = 0").groupBy("user_id").agg(F.max("goal_id").alias("goal_id"))
    return G.one_active(goals, chosen).select("user_id", "goal_id", "status")


@register("o2_patch", with_sql(GOAL_ROWS) + "SELECT user_id, goal_id, CASE WHEN goal_id % 3 = 0 THEN 'patched' ELSE status END AS status, CASE WHEN goal_id % 3 = 0 AND goal_id % 2 = 0 THEN 'new title' ELSE title END AS title FROM goals")
def o2(spark, sf):
    goals = goal_rows(spark, sf).select("user_id", "goal_id", "status", "title")
    changes = goals.where("goal_id % 3 = 0").select("goal_id", F.lit("patched").alias("status"), F.when(F.col("goal_id") % 2 == 0, "new title").alias("title"))
    return G.patch(goals, changes, ["goal_id"])


@register("o3_json_merge", "SELECT c_custkey, '{\"age\":\"' || (c_custkey % 70) || '\",' || CASE WHEN c_custkey % 2 = 0 THEN '\"name\":\"x\",' ELSE '' END || '\"sex\":\"' || CASE WHEN c_custkey % 3 = 0 THEN 'f' ELSE 'm' END || '\"}' AS prefs FROM customer")
def o3(spark, sf):
    k = F.col("c_custkey")
    old = F.concat(F.lit('{"age":"1","sex":"'), F.when(k % 3 == 0, "f").otherwise("m"), F.lit('"}'))
    new = F.concat(F.lit('{"age":"'), (k % 70).cast("string"), F.lit('"'), F.when(k % 2 == 0, ',"name":"x"').otherwise(""), F.lit("}"))
    return V.table(spark, sf, "customer").select(k, G.merge_json(old, new).alias("prefs"))


@register(
    "o3_json_merge_of_types",
    """SELECT c_custkey, '{"age":' || (c_custkey % 70) || ',"goals":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '[1,"two",false]' END || ',"on":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END
      || ',"scale":2.5,"units":{"mass":"' || CASE WHEN c_custkey % 3 = 0 THEN 'lb' ELSE 'kg' END || '"}}' AS prefs FROM customer""",
)
def o3_types(spark, sf):
    """Numbers, booleans, nulls, arrays and objects over others; some patches are no objects."""
    k = F.col("c_custkey")
    old = F.concat(F.lit('{"units":{"mass":"kg"},"age":'), (k % 70).cast("string"), F.lit(',"on":false,"goals":[1,"two",false],"scale":2.5}'))
    changes = [F.when(k % 2 == 0, '"on":true'), F.when(k % 3 == 0, '"units":{"mass":"lb"}'), F.when(k % 4 == 0, '"goals":null')]
    new = F.when((k % 2 != 0) & (k % 3 != 0), F.when(k % 5 == 0, "[1]").when(k % 5 == 1, "not json")).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *changes), F.lit("}")))
    return V.table(spark, sf, "customer").select(k, G.merge_json(old, new).alias("prefs"))


@register("f4_goal_order", with_sql(GOAL_ROWS) + "SELECT user_id, goal_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY status = 'active' DESC, start_date DESC, goal_id) AS INTEGER) AS place FROM goals")
def f4(spark, sf):
    return G.goal_order(goal_rows(spark, sf)).select("user_id", "goal_id", "place")


@register("h10_calendar", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 45 AS later, CAST(dayofweek(CAST(o_orderdate AS DATE)) AS INTEGER) AS dow, CAST(DATE '2001-08-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS days FROM orders")
def h10(spark, sf):
    day = F.to_date("o_orderdate")
    return V.table(spark, sf, "orders").select("o_orderkey", F.date_add(day, 45).alias("later"), (F.dayofweek(day) - 1).alias("dow"), F.date_diff(F.lit("2001-08-01").cast("date"), day).alias("days"))


@register("h18_rounding", "SELECT c_custkey, floor(c_acctbal / 10 + 0.5) AS whole, floor(c_acctbal / 10 * 10 + 0.5) / 10 AS tenth FROM customer")
def h18(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", half_up(F.col("c_acctbal") / 10).alias("whole"), half_up(F.col("c_acctbal") / 10, 1).alias("tenth"))


@register(
    "o5_sparkline",
    with_sql(DENSE_SQL)
    + """SELECT metric_key, date, round((row_number() OVER (PARTITION BY metric_key ORDER BY date) - 1) / CAST(greatest(1, count(*) OVER (PARTITION BY metric_key) - 1) AS DOUBLE), 9) AS x,
      round((value - min(value) OVER (PARTITION BY metric_key)) / (max(value) OVER (PARTITION BY metric_key) - min(value) OVER (PARTITION BY metric_key)), 9) AS y FROM dense""",
)
def o5(spark, sf):
    return rounded(L.sparkline(V.dense(spark, sf), ONE), "x", "y", digits=9).select("metric_key", "date", "x", "y")


@register("h23_display", "SELECT p_partkey, printf('%.2f', p_retailprice) AS shown, strftime(DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER), '%d/%m/%Y') AS day FROM part")
def h23(spark, sf):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", F.format_string("%.2f", "p_retailprice").alias("shown"), F.date_format(day, "dd/MM/yyyy").alias("day"))

"""Queries of the store and of ordered series, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators import store as T
from tidemark.plans import views as V
from tidemark.plans.views import DENSE_SQL, EVENTS_TODAY, ORDERS_TODAY, RESOLVED_SQL, SERIES_SQL, STORE_SQL, with_sql
from tidemark.registry import register

ONE = ["metric_key"]
GRID_SQL = """ends AS (SELECT metric_key, min(date) AS a, max(date) AS z FROM series GROUP BY 1),
grid AS (SELECT d.metric_key, d.date, s.value FROM (SELECT metric_key, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM ends) d
         LEFT JOIN series s ON s.metric_key = d.metric_key AND s.date = d.date)"""


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register("e1_resolved", with_sql(RESOLVED_SQL) + "SELECT user_id, metric_key, date, value, source FROM resolved")
def e1(spark, sf):
    return T.resolve(V.store(spark, sf))


@register(
    "d1_inventory",
    with_sql(RESOLVED_SQL)
    + f"""SELECT s.user_id, s.metric_key, s.n, s.first, s.last, round(s.n / CAST(greatest(1, s.last - s.first + 1) AS DOUBLE), 6) AS coverage, round(r.avg7, 6) AS avg7,
      s.last < DATE '{EVENTS_TODAY}' - 10 AS stale
    FROM (SELECT user_id, metric_key, count(*) AS n, min(date) AS first, max(date) AS last FROM store GROUP BY 1, 2) s
    LEFT JOIN (SELECT user_id, metric_key, avg(value) AS avg7 FROM resolved WHERE date >= DATE '{EVENTS_TODAY}' - 8 AND date < DATE '{EVENTS_TODAY}' GROUP BY 1, 2) r
    ON r.user_id = s.user_id AND r.metric_key = s.metric_key""",
)
def d1(spark, sf):
    store = V.store(spark, sf)
    return T.inventory(store, T.resolve(store), EVENTS_TODAY)


@register(
    "d2_data_health",
    with_sql(STORE_SQL)
    + f"""SELECT user_id, metric_key, last, source, n, round(least(1.0, n / 90.0), 6) AS coverage FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, metric_key) AS k FROM (
        SELECT user_id, metric_key, max(date) AS last, count(*) AS n, arg_max(source, (date, {V.PRIORITY_SQL}, seq)) AS source
        FROM store WHERE date > DATE '{EVENTS_TODAY}' - 90 GROUP BY 1, 2) a) b WHERE k <= 40""",
)
def d2(spark, sf):
    return T.data_health(V.store(spark, sf), EVENTS_TODAY)


@register("d3_source_coverage", with_sql(STORE_SQL) + "SELECT metric_key, count(*) AS n, min(date) AS first, max(date) AS last, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM store GROUP BY 1")
def d3(spark, sf):
    return V.store(spark, sf).groupBy("metric_key").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@register("d4_metrics_with_enough", with_sql(STORE_SQL) + "SELECT user_id, metric_key, count(*) AS n FROM store GROUP BY 1, 2 HAVING count(*) >= 3")
def d4(spark, sf):
    return V.store(spark, sf).groupBy("user_id", "metric_key").agg(F.count("*").alias("n")).where("n >= 3")


@register(
    "b1_range_filter",
    with_sql(RESOLVED_SQL) + "SELECT user_id, metric_key, date, value FROM resolved WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND metric_key IN ('click', 'purchase')",
)
def b1(spark, sf):
    return T.in_range(T.resolve(V.store(spark, sf)), "2024-01-05", "2024-01-20", ["click", "purchase"]).select("user_id", "metric_key", "date", "value")


@register(
    "b2_trailing_windows",
    with_sql(DENSE_SQL)
    + f"""SELECT metric_key, round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 7 THEN value END), 6) AS avg7, round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 28 THEN value END), 6) AS avg28,
      round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 14 AND date <= DATE '{EVENTS_TODAY}' - 7 THEN value END), 6) AS prior7 FROM dense GROUP BY 1""",
)
def b2(spark, sf):
    day = F.lit(EVENTS_TODAY).cast("date")
    after = lambda n: F.col("date") > F.date_sub(day, n)
    avg = lambda when: F.round(F.avg(F.when(when, F.col("value"))), 6)
    return V.dense(spark, sf).groupBy("metric_key").agg(avg(after(7)).alias("avg7"), avg(after(28)).alias("avg28"), avg(after(14) & ~after(7)).alias("prior7"))


@register(
    "b3_windows_before_today",
    with_sql(DENSE_SQL)
    + f"SELECT metric_key, round(avg(CASE WHEN date > DATE '{EVENTS_TODAY}' - 7 THEN value END), 6) AS avg7, round(avg(value), 6) AS avg28 FROM dense WHERE date > DATE '{EVENTS_TODAY}' - 28 AND date < DATE '{EVENTS_TODAY}' GROUP BY 1",
)
def b3(spark, sf):
    day = F.lit(EVENTS_TODAY).cast("date")
    seen = V.dense(spark, sf).where((F.col("date") > F.date_sub(day, 28)) & (F.col("date") < day))
    return seen.groupBy("metric_key").agg(F.round(F.avg(F.when(F.col("date") > F.date_sub(day, 7), F.col("value"))), 6).alias("avg7"), F.round(F.avg("value"), 6).alias("avg28"))


BATCH_SQL = f"""batch AS (SELECT user_id, date, metric_key, source, value + 1 AS value, seq FROM store WHERE seq % 7 = 0)"""


@register(
    "a17_upsert",
    with_sql(RESOLVED_SQL, BATCH_SQL)
    + """SELECT user_id, date, metric_key, source, round(arg_max(value, (is_new, seq)), 6) AS value FROM (
      SELECT user_id, date, metric_key, source, value, 0 AS is_new, 0 AS seq FROM resolved UNION ALL SELECT user_id, date, metric_key, source, value, 1, seq FROM batch) t GROUP BY 1, 2, 3, 4""",
)
def a17(spark, sf):
    store = V.store(spark, sf)
    batch = store.where("seq % 7 = 0").withColumn("value", F.col("value") + 1)
    return rounded(T.upsert(T.resolve(store), batch), "value")


@register("a24_batch_dedupe", with_sql(STORE_SQL) + "SELECT date, metric_key, arg_max(value, seq) AS value FROM store GROUP BY 1, 2")
def a24(spark, sf):
    return T.last_of_batch(V.store(spark, sf).select("date", "metric_key", "value", "seq"), ["date", "metric_key"], "seq").select("date", "metric_key", "value")


@register("a28_delete_manual", with_sql(STORE_SQL) + "SELECT user_id, date, metric_key, value, source FROM store WHERE NOT (source = 'manual' AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12')")
def a28(spark, sf):
    store = V.store(spark, sf)
    gone = store.where("date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'").select("user_id", "date", "metric_key").distinct()
    return T.without_manual(store, gone).select("user_id", "date", "metric_key", "value", "source")


@register("c6_calendar_grid", with_sql(SERIES_SQL, GRID_SQL) + "SELECT metric_key, date, round(value, 8) AS value FROM grid")
def c6(spark, sf):
    return rounded(S.grid(V.series(spark, sf), ONE), "value", digits=8)


@register(
    "e2_rolling_means",
    with_sql(SERIES_SQL, GRID_SQL)
    + """SELECT metric_key, date, round(avg(value) OVER (PARTITION BY metric_key ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 10) AS trailing,
      round(avg(value) OVER (PARTITION BY metric_key ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 10) AS centred FROM grid""",
)
def e2(spark, sf):
    days = S.grid(V.series(spark, sf), ONE)
    both = S.rolling_mean(S.rolling_mean(days, ONE, 7).withColumnRenamed("rolling", "trailing"), ONE, 7, centred=True)
    return both.select("metric_key", "date", F.round("trailing", 10).alias("trailing"), F.round("rolling", 10).alias("centred"))


@register(
    "j3_ewma",
    with_sql(DENSE_SQL)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY date) - 1 AS k FROM dense)
    SELECT a.metric_key, a.date, round(sum(b.value * CASE WHEN b.k = 0 THEN power(power(CAST(2 AS DOUBLE), -1.0 / 7), a.k) ELSE (1 - power(CAST(2 AS DOUBLE), -1.0 / 7)) * power(power(CAST(2 AS DOUBLE), -1.0 / 7), a.k - b.k) END), 6) AS ewma
    FROM o a JOIN o b ON a.metric_key = b.metric_key AND b.k <= a.k GROUP BY 1, 2""",
)
def j3(spark, sf):
    return S.ewma(V.dense(spark, sf), ONE, 7.0).select("metric_key", "date", F.round("ewma", 6).alias("ewma"))


@register(
    "j3_ewma_over_gaps",
    with_sql(SERIES_SQL, GRID_SQL)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY date) - 1 AS k FROM series WHERE date >= DATE '2000-01-01'),
    w AS (SELECT a.metric_key, a.date, sum(b.value * CASE WHEN b.k = 0 THEN power(power(CAST(2 AS DOUBLE), -1.0 / 28), a.k) ELSE (1 - power(CAST(2 AS DOUBLE), -1.0 / 28)) * power(power(CAST(2 AS DOUBLE), -1.0 / 28), a.k - b.k) END) AS e
    FROM o a JOIN o b ON a.metric_key = b.metric_key AND b.k <= a.k GROUP BY 1, 2)
    SELECT g.metric_key, g.date, round(last_value(w.e IGNORE NULLS) OVER (PARTITION BY g.metric_key ORDER BY g.date), 6) AS ewma
    FROM grid g LEFT JOIN w ON w.metric_key = g.metric_key AND w.date = g.date WHERE g.date >= (SELECT min(date) FROM o WHERE o.metric_key = g.metric_key)""",
)
def j3_gaps(spark, sf):
    recent = V.series(spark, sf).where("date >= DATE '2000-01-01'")
    return S.ewma(S.grid(recent, ONE), ONE, 28.0).select("metric_key", "date", F.round("ewma", 6).alias("ewma"))


@register(
    "j15_interpolate",
    with_sql(SERIES_SQL, GRID_SQL)
    + """SELECT metric_key, date, round(CASE WHEN value IS NOT NULL THEN value WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (date - pd) / CAST(nd - pd AS DOUBLE) END, 10) AS filled FROM (
      SELECT *, last_value(value IGNORE NULLS) OVER w AS pv, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER w AS pd,
        first_value(value IGNORE NULLS) OVER x AS nv, first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER x AS nd FROM grid
      WINDOW w AS (PARTITION BY metric_key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY metric_key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) t""",
)
def j15(spark, sf):
    return S.interpolated(S.grid(V.series(spark, sf), ONE), ONE).select("metric_key", "date", F.round("filled", 10).alias("filled"))


@register(
    "d12_buckets",
    with_sql(SERIES_SQL)
    + """SELECT metric_key, CAST(f + CAST(floor((date - f) / 10.0) * 10 AS INTEGER) AS DATE) AS date, round(CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE) / count(value), 6) AS value
    FROM (SELECT *, min(date) OVER (PARTITION BY metric_key) AS f FROM series WHERE date BETWEEN DATE '2000-08-01' AND DATE '2001-08-01') t GROUP BY 1, 2""",
)
def d12(spark, sf):
    year = T.in_range(V.series(spark, sf), "2000-08-01", ORDERS_TODAY)
    return rounded(S.buckets(year, ONE, 400), "value")


@register(
    "j12_anomalies",
    with_sql(SERIES_SQL)
    + """, b AS (SELECT *, list(value) OVER w AS base, median(value) OVER w AS m FROM series WINDOW w AS (PARTITION BY metric_key ORDER BY date ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, (value - m) / (list_aggregate(list_transform(base, lambda x: abs(x - m)), 'median') * 1.4826) AS z FROM b WHERE len(base) = 42)
    SELECT metric_key, date, round(value, 6) AS value, round(z, 6) AS z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM z WHERE abs(z) >= 3""",
)
def j12(spark, sf):
    return rounded(S.anomalies(V.series(spark, sf), ONE), "value", "z")


@register(
    "e4_baseline_z",
    with_sql(SERIES_SQL)
    + """SELECT metric_key, date, round(CASE WHEN n >= 10 AND sd > 0 THEN (value - m) / sd END, 6) AS z FROM (
      SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM series
      WINDOW w AS (PARTITION BY metric_key ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) t""",
)
def e4(spark, sf):
    return S.baseline_z(V.series(spark, sf), ONE).select("metric_key", "date", F.round("z", 6).alias("z"))


@register("e5_differences", with_sql(SERIES_SQL) + "SELECT metric_key, date, round(value - lag(value) OVER (PARTITION BY metric_key ORDER BY date), 10) AS diff FROM series")
def e5(spark, sf):
    return S.differences(V.series(spark, sf), ONE).select("metric_key", "date", F.round("diff", 10).alias("diff"))


@register(
    "e6_first_last",
    with_sql(SERIES_SQL)
    + """SELECT metric_key, round(arg_min(value, date), 6) AS first, round(arg_max(value, date), 6) AS last, round(avg(CASE WHEN a <= 3 THEN value END), 6) AS first3,
      round(avg(CASE WHEN z <= 3 THEN value END), 6) AS last3, round(avg(CASE WHEN z <= 28 THEN value END), 6) AS last28
    FROM (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY date) AS a, row_number() OVER (PARTITION BY metric_key ORDER BY date DESC) AS z FROM series) t GROUP BY 1""",
)
def e6(spark, sf):
    from pyspark.sql import Window

    rows = V.series(spark, sf).withColumn("a", F.row_number().over(S.ordered(ONE))).withColumn("z", F.row_number().over(Window.partitionBy("metric_key").orderBy(F.desc("date"))))
    avg = lambda c: F.round(F.avg(F.when(c, F.col("value"))), 6)
    return rows.groupBy("metric_key").agg(
        F.round(F.min_by("value", "date"), 6).alias("first"), F.round(F.max_by("value", "date"), 6).alias("last"), avg(F.col("a") <= 3).alias("first3"), avg(F.col("z") <= 3).alias("last3"), avg(F.col("z") <= 28).alias("last28")
    )


@register(
    "e8_ranks",
    with_sql(STORE_SQL)
    + """SELECT seq, rank() OVER (PARTITION BY metric_key ORDER BY round(value)) + (count(*) OVER (PARTITION BY metric_key, round(value)) - 1) / 2.0 AS average_rank,
      row_number() OVER (PARTITION BY metric_key ORDER BY round(value), seq) AS ordinal FROM store""",
)
def e8(spark, sf):
    from pyspark.sql import Window

    rows = V.store(spark, sf).withColumn("value", F.round("value"))
    ordinal = F.row_number().over(Window.partitionBy("metric_key").orderBy("value", "seq")).cast("long")
    return rows.select("seq", S.average_ranks(rows, ONE).alias("average_rank"), ordinal.alias("ordinal"))


@register(
    "e10_streaks",
    with_sql(DENSE_SQL)
    + """, d AS (SELECT metric_key, date, date - CAST(row_number() OVER (PARTITION BY metric_key ORDER BY date) AS INTEGER) AS island FROM dense WHERE value > 0.08)
    SELECT k.metric_key, coalesce(max(r.n), 0) AS streak FROM (SELECT DISTINCT metric_key FROM dense) k
    LEFT JOIN (SELECT metric_key, island, max(date) AS z, count(*) AS n FROM d GROUP BY 1, 2) r ON r.metric_key = k.metric_key AND r.z = DATE '2024-01-30' GROUP BY 1""",
)
def e10(spark, sf):
    return S.streaks(V.dense(spark, sf), ONE, F.col("value") > 0.08, EVENTS_TODAY).withColumn("streak", F.col("streak").cast("long"))


@register(
    "j14_coverage",
    with_sql(SERIES_SQL) + "SELECT metric_key, 91 AS days, count(CASE WHEN date BETWEEN DATE '2001-05-03' AND DATE '2001-08-01' THEN 1 END) AS observed, round(least(1.0, count(CASE WHEN date BETWEEN DATE '2001-05-03' AND DATE '2001-08-01' THEN 1 END) / 91.0), 6) AS ratio FROM series GROUP BY 1",
)
def j14(spark, sf):
    return rounded(S.coverage(V.series(spark, sf), ONE, "2001-05-03", ORDERS_TODAY), "ratio")


@register(
    "a18_definitions",
    with_sql(STORE_SQL) + "SELECT DISTINCT metric_key AS key, upper(substr(metric_key, 1, 1)) || substr(metric_key, 2) AS label, 'mean' AS agg, 2 AS precision, TRUE AS is_custom FROM store",
)
def a18(spark, sf):
    have = T.definitions(spark)
    return T.ensure_definitions(have, V.store(spark, sf)).join(have.select("key"), "key", "left_anti").select("key", "label", "agg", "precision", "is_custom")


@register(
    "x1_resample_months",
    with_sql(SERIES_SQL)
    + """SELECT metric_key, CAST(date_trunc('month', date) AS DATE) AS date, round(CASE metric_key WHEN '1-URGENT' THEN sum(value) WHEN '2-HIGH' THEN max(value) WHEN '3-MEDIUM' THEN arg_max(value, date) ELSE avg(value) END, 12) AS value
    FROM series GROUP BY 1, 2""",
)
def x1(spark, sf):
    defs = spark.createDataFrame([("1-URGENT", "sum"), ("2-HIGH", "max"), ("3-MEDIUM", "last")], "key string, agg string")
    return rounded(T.resample(V.series(spark, sf), "month", defs, ("metric_key",)), "value", digits=12)

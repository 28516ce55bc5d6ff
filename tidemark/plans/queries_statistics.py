"""Queries of statistics, trends, correlations and drivers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import erf_sql, fisher_p_sql, norm_cdf_sql, t_test_p_sql, two_tailed_sql
from tidemark.functions.vocab import PLAUSIBLE_RANGES
from tidemark.operators import forecast as C
from tidemark.operators import inference as I
from tidemark.operators import relations as R
from tidemark.operators import series as S
from tidemark.operators import store as T
from tidemark.operators import trend as N
from tidemark.plans import views as V
from tidemark.plans.queries_series import ONE, rounded
from tidemark.plans.views import DENSE_SQL, ORDERS_TODAY, SERIES_SQL, with_sql
from tidemark.registry import ORACLE, register

YEAR_SQL = "year AS (SELECT * FROM series WHERE date BETWEEN DATE '2000-08-01' AND DATE '2001-08-01')"


def year(spark, sf):
    """The long series' last year."""
    return T.in_range(V.series(spark, sf), "2000-08-01", ORDERS_TODAY)


def numbered(series):
    """Days since each series' first point."""
    from pyspark.sql import Window

    return series.withColumn("x", F.date_diff("date", F.min("date").over(Window.partitionBy("metric_key"))).cast("double"))


@register(
    "d15_distribution",
    with_sql(SERIES_SQL)
    + """, m AS (SELECT metric_key, median(value) AS m FROM series GROUP BY 1)
    SELECT s.metric_key, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 8) AS median, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90,
      round(min(value), 6) AS min, round(max(value), 6) AS max, round(arg_max(value, date), 6) AS latest, max(date) AS latest_date, round(median(abs(value - m.m)) * 1.4826, 6) AS mad
    FROM series s JOIN m ON m.metric_key = s.metric_key GROUP BY 1""",
)
def d15(spark, sf):
    return rounded(rounded(I.describe(V.series(spark, sf), ONE), "mean", "sd", "p10", "p90", "min", "max", "latest", "mad"), "median", digits=8)


@register(
    "h15_normal_and_t",
    f"""WITH g AS (SELECT CAST(l_linenumber AS DOUBLE) * 0.37 - 1.3 AS z, CAST(l_linenumber * 9 AS BIGINT) AS df, l_linenumber FROM (SELECT DISTINCT l_linenumber FROM lineitem) t)
    SELECT l_linenumber, round({erf_sql('z')}, 9) AS erf, round({norm_cdf_sql('z')}, 9) AS cdf, round({t_test_p_sql('abs(z)', 'df')}, 9) AS p FROM g""",
)
def h15(spark, sf):
    g = V.table(spark, sf, "lineitem").select("l_linenumber").distinct().select("l_linenumber", (F.col("l_linenumber").cast("double") * 0.37 - 1.3).alias("z"), (F.col("l_linenumber") * 9).cast("long").alias("df"))
    return g.select("l_linenumber", F.round(F.expr(erf_sql("z")), 9).alias("erf"), F.round(F.expr(norm_cdf_sql("z")), 9).alias("cdf"), F.round(F.expr(t_test_p_sql("abs(z)", "df")), 9).alias("p"))


OLS_SQL = f"""x AS (SELECT *, CAST(date - min(date) OVER (PARTITION BY metric_key) AS DOUBLE) AS x FROM series),
u AS (SELECT metric_key, count(*) AS n, avg(x) AS mx, avg(value) AS my, regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy, regr_sxy(value, x) AS sxy FROM x GROUP BY 1),
f AS (SELECT *, sxy / sxx AS slope, greatest(0, syy - sxy * sxy / sxx) AS lft FROM u WHERE n >= 3 AND sxx > 0),
h AS (SELECT *, sqrt(lft / (n - 2) / sxx) AS se FROM f), ols AS (SELECT *, slope / nullif(se, 0) AS t, n - 2 AS df FROM h)"""


@register(
    "i9_least_squares",
    with_sql(SERIES_SQL, OLS_SQL) + f"SELECT metric_key, n, round(slope, 9) AS slope, round(my - slope * mx, 6) AS intercept, round(1 - lft / syy, 6) AS r2, round(se, 9) AS se, round(t, 6) AS t, round({t_test_p_sql('abs(t)', 'df')}, 6) AS p FROM ols",
)
def i9(spark, sf):
    return rounded(rounded(I.least_squares(numbered(V.series(spark, sf)), ONE, "x", "value"), "slope", "se", digits=9), "intercept", "r2", "t", "p")


WELCH_SQL = """w AS (SELECT metric_key, count(CASE WHEN NOT b THEN 1 END) AS na, count(CASE WHEN b THEN 1 END) AS nb, avg(CASE WHEN NOT b THEN value END) AS mean_a, avg(CASE WHEN b THEN value END) AS mean_b,
  var_samp(CASE WHEN NOT b THEN value END) AS va, var_samp(CASE WHEN b THEN value END) AS vb FROM (SELECT *, date >= DATE '2001-02-01' AS b FROM year) t GROUP BY 1),
v AS (SELECT *, (mean_b - mean_a) / sqrt(va / na + vb / nb) AS t, power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS df,
  (mean_b - mean_a) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS effect FROM w)"""


@register(
    "i10_welch_and_effect",
    with_sql(SERIES_SQL, YEAR_SQL, WELCH_SQL) + f"SELECT metric_key, na, nb, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(t, 6) AS t, round(df, 6) AS df, round({t_test_p_sql('abs(t)', 'df')}, 6) AS p, round(effect, 6) AS effect FROM v",
)
def i10(spark, sf):
    return rounded(I.two_groups(year(spark, sf), ONE, "value", F.col("date") >= F.lit("2001-02-01").cast("date")), "mean_a", "mean_b", "t", "df", "p", "effect")


@register(
    "j7_drift_test",
    with_sql(SERIES_SQL)
    + f""", d AS (SELECT metric_key, value - lag(value) OVER (PARTITION BY metric_key ORDER BY date) AS diff FROM series),
    s AS (SELECT metric_key, count(diff) AS n, avg(diff) AS m, stddev_samp(diff) AS sd FROM d GROUP BY 1), u AS (SELECT *, m / (sd / sqrt(n)) AS t, n - 1 AS df FROM s)
    SELECT metric_key, n, round(t, 6) AS t, round({t_test_p_sql('abs(t)', 'df')}, 6) AS p, round(m, 9) AS per_step FROM u""",
)
def j7(spark, sf):
    return rounded(rounded(I.drift_test(S.differences(V.series(spark, sf), ONE), ONE), "t", "p"), "per_step", digits=9)


PAIRS_SQL = """pairs AS (SELECT a.metric_key, b.value - a.value AS dv, b.date - a.date AS dx, b.k - a.k AS dk FROM o a JOIN o b ON a.metric_key = b.metric_key AND a.k < b.k),
sen AS (SELECT metric_key, CAST(sum(sign(dv)) AS BIGINT) AS s, median(dv / dx) AS sen, median(dv / dk) AS step FROM pairs GROUP BY 1)"""
NUMBERED_SQL = "o AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY date) - 1 AS k FROM year)"
TREND_SQL = f"""{NUMBERED_SQL}, {PAIRS_SQL},
r0 AS (SELECT o.*, o.value - sen.step * o.k AS e FROM o JOIN sen ON sen.metric_key = o.metric_key),
r AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY e, k) AS rk, count(*) OVER (PARTITION BY metric_key) AS n, avg(e) OVER (PARTITION BY metric_key) AS em FROM r0),
rho AS (SELECT a.metric_key, a.n, b.k - a.k AS lag, sum((a.rk - (a.n + 1) / 2.0) * (b.rk - (a.n + 1) / 2.0)) / (a.n * (CAST(a.n AS DOUBLE) * a.n - 1) / 12) AS rho
        FROM r a JOIN r b ON a.metric_key = b.metric_key AND b.k > a.k GROUP BY 1, 2, 3),
hr AS (SELECT metric_key, least(50, greatest(1, 1 + 2 / (CAST(n AS DOUBLE) * (n - 1) * (n - 2)) * sum(CASE WHEN abs(rho) > 1.96 / sqrt(n) AND lag <= n - 3 THEN CAST(n - lag AS DOUBLE) * (n - lag - 1) * (n - lag - 2) * rho ELSE 0 END))) AS hr FROM rho GROUP BY metric_key, n),
l1 AS (SELECT metric_key, sum((e - em) * (nx - em)) / sum((e - em) * (e - em)) AS r1 FROM (SELECT *, lead(e) OVER (PARTITION BY metric_key ORDER BY k) AS nx FROM r) t GROUP BY 1),
es AS (SELECT metric_key, least(200, greatest(1, (1 + c) / (1 - c))) AS es FROM (SELECT metric_key, least(0.995, greatest(0, r1)) AS c FROM l1) t),
tie AS (SELECT metric_key, sum(CASE WHEN c > 1 THEN c * (c - 1) * (2 * c + 5) ELSE 0 END) AS adj, sum(c) AS n FROM (SELECT metric_key, value, CAST(count(*) AS DOUBLE) AS c FROM year GROUP BY 1, 2) t GROUP BY 1),
mk AS (SELECT sen.metric_key, sen.s, sen.sen, greatest(hr, es) AS inflation, (sen.s - sign(sen.s)) / sqrt((tie.n * (tie.n - 1) * (2 * tie.n + 5) - adj) / 18 * greatest(hr, es)) AS z
       FROM sen JOIN hr ON hr.metric_key = sen.metric_key JOIN es ON es.metric_key = sen.metric_key JOIN tie ON tie.metric_key = sen.metric_key)"""


@register(
    "c8_pairwise_trend",
    with_sql(SERIES_SQL, YEAR_SQL, NUMBERED_SQL, PAIRS_SQL) + "SELECT metric_key, s, round(sen, 9) AS sen FROM sen",
)
def c8(spark, sf):
    return rounded(I.pairwise_trend(year(spark, sf), ONE), "sen", digits=9)


@register(
    "j4_mann_kendall",
    with_sql(SERIES_SQL, YEAR_SQL, TREND_SQL) + f"SELECT metric_key, s, round(sen, 9) AS sen, round(inflation, 6) AS inflation, round(z, 6) AS z, round({two_tailed_sql('abs(z)')}, 6) AS p FROM mk",
)
def j4(spark, sf):
    t = N.trends(year(spark, sf), ONE)
    return t.select("metric_key", "s", F.round("sen_slope_per_day", 9).alias("sen"), F.round("variance_inflation", 6).alias("inflation"), F.round("mk_z", 6).alias("z"), F.round("mk_p", 6).alias("p"))


VERDICT_SQL = (
    with_sql(SERIES_SQL, YEAR_SQL, TREND_SQL)
    + f""", df0 AS (SELECT metric_key, value - lag(value) OVER (PARTITION BY metric_key ORDER BY date) AS diff FROM year),
    dr AS (SELECT metric_key, avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) AS t, count(diff) - 1 AS df FROM df0 GROUP BY 1),
    p AS (SELECT mk.*, {two_tailed_sql('abs(z)')} AS mk_p, {t_test_p_sql('abs(dr.t)', 'dr.df')} AS drift_p FROM mk JOIN dr ON dr.metric_key = mk.metric_key),
    e AS (SELECT metric_key, count(*) AS n, arg_min(value, date) AS first, arg_max(value, date) AS last FROM year GROUP BY 1)
    SELECT p.metric_key, e.n, round(mk_p, 6) AS mk_p, round(drift_p, 6) AS drift_p, mk_p < 0.02 AND drift_p < 0.02 AS significant,
      CASE WHEN NOT (mk_p < 0.02 AND drift_p < 0.02) OR sen = 0 THEN 'flat' WHEN sen > 0 THEN 'rising' ELSE 'falling' END AS direction, round((last - first) / abs(first) * 100, 6) AS change_pct
    FROM p JOIN e ON e.metric_key = p.metric_key"""
)


@register("j9_trend_verdict", VERDICT_SQL)
def j9(spark, sf):
    return rounded(N.trends(year(spark, sf), ONE), "mk_p", "drift_p", "change_pct").select("metric_key", "n", "mk_p", "drift_p", "significant", "direction", "change_pct")


WHOLE_SQL = "year AS (SELECT * FROM series)"


def of_years(sql: str) -> str:
    """The same SQL over the whole series."""
    return sql.replace(YEAR_SQL, WHOLE_SQL)


@register("c8_pairwise_trend_of_years", of_years(ORACLE["c8_pairwise_trend"]))
def c8_long(spark, sf):
    """Kendall's S by merging and the Theil-Sen slope by selection, no pairs formed but those about the median."""
    return N.trends(V.series(spark, sf), ONE).select("metric_key", "s", F.round("sen_slope_per_day", 9).alias("sen"))


@register("j4_mann_kendall_of_years", of_years(ORACLE["j4_mann_kendall"]))
def j4_long(spark, sf):
    t = N.trends(V.series(spark, sf), ONE)
    return t.select("metric_key", "s", F.round("sen_slope_per_day", 9).alias("sen"), F.round("variance_inflation", 6).alias("inflation"), F.round("mk_z", 6).alias("z"), F.round("mk_p", 6).alias("p"))


@register("j9_trend_verdict_of_years", of_years(VERDICT_SQL))
def j9_verdict_long(spark, sf):
    return rounded(N.trends(V.series(spark, sf), ONE), "mk_p", "drift_p", "change_pct").select("metric_key", "n", "mk_p", "drift_p", "significant", "direction", "change_pct")


@register("i10_welch_and_effect_of_years", of_years(ORACLE["i10_welch_and_effect"]))
def i10_long(spark, sf):
    return rounded(I.two_groups(V.series(spark, sf), ONE, "value", F.col("date") >= F.lit("2001-02-01").cast("date")), "mean_a", "mean_b", "t", "df", "p", "effect")


@register("j9_trends_of_years")
def j9_long(spark, sf):
    """Trends of the whole long series: millions of pairs each."""
    return rounded(N.trends(V.series(spark, sf), ONE), "slope_per_day", "sen_slope_per_day", "mk_z", "mk_p", "drift_p", digits=6)


@register("j10_change_points")
def j10(spark, sf):
    return rounded(N.change_points(V.series(spark, sf), ONE), "before", "after", "delta", "effect_size", "p_value")


@register("j10_planted_shifts")
def j10_planted(spark, sf):
    """Change points of the series, raised by three standard deviations from a day on."""
    series = V.series(spark, sf)
    spread = series.groupBy("metric_key").agg((3 * F.stddev_samp("value")).alias("step"))
    raised = series.join(spread, "metric_key").withColumn("value", F.col("value") + F.when(F.col("date") >= F.lit("1998-06-01").cast("date"), F.col("step")).otherwise(0.0))
    return rounded(N.change_points(raised, ONE), "before", "after", "delta", "effect_size", "p_value")


@register(
    "j10_first_split",
    with_sql(DENSE_SQL)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY date) AS k, count(*) OVER (PARTITION BY metric_key) AS n FROM dense),
    c AS (SELECT a.metric_key, a.k, a.n, avg(CASE WHEN b.k <= a.k THEN b.value END) AS ma, avg(CASE WHEN b.k > a.k THEN b.value END) AS mb, var_samp(CASE WHEN b.k <= a.k THEN b.value END) AS va, var_samp(CASE WHEN b.k > a.k THEN b.value END) AS vb
      FROM o a JOIN o b ON a.metric_key = b.metric_key WHERE a.k BETWEEN 14 AND a.n - 14 GROUP BY 1, 2, 3)
    SELECT metric_key, k AS n_before, round(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY round(t, 9) DESC, k) AS rk FROM (SELECT *, abs(mb - ma) / sqrt(va / k + vb / (n - k)) AS t FROM c) u) v WHERE rk = 1""",
)
def j10_split(spark, sf):
    """The strongest single split, by window prefix sums."""
    from pyspark.sql import Window

    w, all_rows = S.ordered(ONE), Window.partitionBy("metric_key")
    q = F.col("value") * F.col("value")
    rows = V.dense(spark, sf).select("metric_key", F.row_number().over(w).cast("long").alias("k"), F.count("*").over(all_rows).alias("n"), F.sum("value").over(w).alias("s"), F.sum(q).over(w).alias("q"), F.sum("value").over(all_rows).alias("ts"), F.sum(q).over(all_rows).alias("tq"))
    rows = rows.where((F.col("k") >= 14) & (F.col("k") <= F.col("n") - 14)).withColumn("m", F.col("n") - F.col("k"))
    va = (F.col("q") - F.col("s") * F.col("s") / F.col("k")) / (F.col("k") - 1)
    vb = (F.col("tq") - F.col("q") - (F.col("ts") - F.col("s")) * (F.col("ts") - F.col("s")) / F.col("m")) / (F.col("m") - 1)
    t = F.abs((F.col("ts") - F.col("s")) / F.col("m") - F.col("s") / F.col("k")) / F.sqrt(va / F.col("k") + vb / F.col("m"))
    best = rows.withColumn("t", t).withColumn("rk", F.row_number().over(all_rows.orderBy(F.desc(F.round("t", 9)), "k"))).where("rk = 1")
    return best.select("metric_key", F.col("k").alias("n_before"), F.round("t", 6).alias("t"))


@register(
    "j13_weekday_profile",
    with_sql(SERIES_SQL)
    + f""", d AS (SELECT metric_key, i.dow, count(CASE WHEN dayofweek(date) = i.dow THEN 1 END) AS n, avg(CASE WHEN dayofweek(date) = i.dow THEN value END) AS mean, var_samp(CASE WHEN dayofweek(date) = i.dow THEN value END) AS vb,
      count(CASE WHEN dayofweek(date) <> i.dow THEN 1 END) AS rn, avg(CASE WHEN dayofweek(date) <> i.dow THEN value END) AS rm, var_samp(CASE WHEN dayofweek(date) <> i.dow THEN value END) AS va, avg(value) AS overall
      FROM series, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS dow) i GROUP BY 1, 2),
    t AS (SELECT *, (mean - rm) / sqrt(va / rn + vb / n) AS t, power(va / rn + vb / n, 2) / (power(va / rn, 2) / (rn - 1) + power(vb / n, 2) / (n - 1)) AS df FROM d)
    SELECT metric_key, (['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'])[dow + 1] AS day, n, round(mean, 6) AS mean, round(mean - overall, 6) AS delta, round({t_test_p_sql('abs(t)', 'df')}, 6) AS p_value, {t_test_p_sql('abs(t)', 'df')} < 0.05 AS significant FROM t""",
)
def j13(spark, sf):
    return rounded(S.weekday_profile(V.series(spark, sf), ONE), "mean", "delta", "p_value")


LAGGED_SQL = f"""l AS (SELECT unnest([0, 1, 2, 3]) AS lag),
al AS (SELECT x.metric_key AS driver, y.metric_key AS target, l.lag, y.date, x.value AS x, y.value AS y FROM dense x, l, dense y WHERE y.date = x.date + CAST(l.lag AS INTEGER) AND x.metric_key <> y.metric_key),
rk AS (SELECT driver, target, lag, rank() OVER (PARTITION BY driver, target, lag ORDER BY x) + (count(*) OVER (PARTITION BY driver, target, lag, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY driver, target, lag ORDER BY y) + (count(*) OVER (PARTITION BY driver, target, lag, y) - 1) / 2.0 AS ry FROM al),
co AS (SELECT driver, target, lag, count(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 10)"""


@register("j20_lagged_correlation", with_sql(DENSE_SQL, LAGGED_SQL) + f"SELECT driver, target, lag, n, round(r, 6) AS r, round({fisher_p_sql('r', 'n')}, 6) AS p FROM co")
def j20(spark, sf):
    d = V.dense(spark, sf)
    return rounded(R.lagged_correlation(R.all_lags(d, d, "driver", "target", 3), ["driver", "target", "lag"]), "r", "p")


@register(
    "j20_best_lag",
    with_sql(DENSE_SQL, LAGGED_SQL) + "SELECT driver, target, lag, n, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY driver, target ORDER BY round(abs(r), 12) DESC, lag) AS k FROM co) t WHERE k = 1",
)
def j20_best(spark, sf):
    d = V.dense(spark, sf)
    found = R.best_lag(R.lagged_correlation(R.all_lags(d, d, "driver", "target", 3), ["driver", "target", "lag"]), ["driver", "target"])
    return rounded(found, "r").select("driver", "target", "lag", "n", "r")


@register(
    "f1_related_metrics",
    with_sql(DENSE_SQL, LAGGED_SQL)
    + f"""SELECT target, driver, lag, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(r), 12) DESC, driver) AS top FROM
      (SELECT *, row_number() OVER (PARTITION BY driver, target ORDER BY round(abs(r), 12) DESC, lag) AS k FROM co) t WHERE k = 1 AND abs(r) > 0.2 AND {fisher_p_sql('r', 'n')} < 0.5) u WHERE top <= 8""",
)
def f1(spark, sf):
    from pyspark.sql import Window

    d = V.dense(spark, sf)
    best = R.best_lag(R.lagged_correlation(R.all_lags(d, d, "driver", "target", 3), ["driver", "target", "lag"]), ["driver", "target"]).where("abs(r) > 0.2 AND p < 0.5")
    top = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round(F.abs("r"), 12)), "driver"))
    return best.withColumn("top", top).where("top <= 8").select("target", "driver", "lag", F.round("r", 6).alias("r"))


@register(
    "i7_pearson",
    with_sql(DENSE_SQL) + "SELECT x.metric_key AS a, y.metric_key AS b, count(*) AS n, round(corr(x.value, y.value), 6) AS r FROM dense x JOIN dense y ON x.date = y.date AND x.metric_key < y.metric_key GROUP BY 1, 2",
)
def i7(spark, sf):
    d = V.dense(spark, sf)
    pairs = d.select(F.col("metric_key").alias("a"), "date", F.col("value").alias("x")).join(d.select(F.col("metric_key").alias("b"), "date", F.col("value").alias("y")), "date").where("a < b")
    return rounded(pairs.groupBy("a", "b").agg(F.count("*").alias("n"), R.pearson("x", "y").alias("r")), "r")


@register(
    "j23_behaviour_split",
    with_sql(DENSE_SQL, LAGGED_SQL)
    + """, m AS (SELECT driver, target, list_sort(list(x))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS threshold FROM al WHERE lag = 1 GROUP BY 1, 2 HAVING count(*) >= 12)
    SELECT al.driver, al.target, round(threshold, 9) AS threshold, round(avg(CASE WHEN x <= threshold THEN y END), 9) AS low_mean, round(avg(CASE WHEN x > threshold THEN y END), 9) AS high_mean,
      count(CASE WHEN x <= threshold THEN 1 END) AS n_low, count(CASE WHEN x > threshold THEN 1 END) AS n_high, round(avg(CASE WHEN x > threshold THEN y END) - avg(CASE WHEN x <= threshold THEN y END), 9) AS delta,
      round((avg(CASE WHEN x > threshold THEN y END) - avg(CASE WHEN x <= threshold THEN y END)) / abs(avg(CASE WHEN x <= threshold THEN y END)) * 100, 9) AS delta_pct
    FROM al JOIN m ON m.driver = al.driver AND m.target = al.target WHERE lag = 1 GROUP BY 1, 2, 3 HAVING count(CASE WHEN x <= threshold THEN 1 END) >= 4 AND count(CASE WHEN x > threshold THEN 1 END) >= 4""",
)
def j23(spark, sf):
    d = V.dense(spark, sf)
    pairs = R.all_lags(d, d, "driver", "target", 1).where("lag = 1")
    return rounded(R.behaviour_split(pairs, ["driver", "target"]), "threshold", "low_mean", "high_mean", "delta", "delta_pct", digits=9)


@register("j21_drivers")
def j21(spark, sf):
    return rounded(R.drivers(V.dense(spark, sf)), "correlation", "p", "coefficient", "contribution", "r2", "adj_r2")


@register(
    "j22_gram_matrix",
    with_sql(DENSE_SQL)
    + """, z AS (SELECT metric_key, date, (value - avg(value) OVER (PARTITION BY metric_key)) / stddev_samp(value) OVER (PARTITION BY metric_key) AS z FROM dense)
    SELECT a.metric_key AS a, b.metric_key AS b, round(sum(a.z * b.z), 6) AS g FROM z a JOIN z b ON a.date = b.date AND a.metric_key <= b.metric_key GROUP BY 1, 2""",
)
def j22(spark, sf):
    """The standardised cross-products that a ridge model is solved from."""
    from pyspark.sql import Window

    w = Window.partitionBy("metric_key")
    z = V.dense(spark, sf).withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w))
    a, b = z.select(F.col("metric_key").alias("a"), "date", F.col("z").alias("x")), z.select(F.col("metric_key").alias("b"), "date", F.col("z").alias("y"))
    return a.join(b, "date").where("a <= b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("g"))


@register("j18_forecast")
def j18(spark, sf):
    return rounded(C.forecasts(V.dense(spark, sf), ONE, 30), "p10", "p25", "p50", "p75", "p90")


@register("j18_forecast_of_years")
def j18_long(spark, sf):
    return rounded(C.forecasts(V.series(spark, sf), ONE, 60), "p10", "p25", "p50", "p75", "p90")


@register("j19_projection")
def j19(spark, sf):
    targets = {"click": (0.2, "increase"), "purchase": (0.05, "decrease"), "view": (0.1, "maintain")}
    return rounded(C.projections(V.dense(spark, sf), ONE, targets, "2024-03-30", "2024-01-30", PLAUSIBLE_RANGES), "probability", "projected", "projected_low", "projected_high")


@register(
    "j17_holt_fixed",
    with_sql(DENSE_SQL)
    + """, a AS (SELECT metric_key, list(value ORDER BY date) AS v FROM dense GROUP BY 1),
    st AS (SELECT metric_key, v, list_reduce(list_prepend({'l': v[1], 't': (v[4] - v[1]) / 3.0, 'e': CAST(0 AS DOUBLE), 'v': CAST(0 AS DOUBLE)}, list_transform(v[2:], lambda x: {'l': CAST(0 AS DOUBLE), 't': CAST(0 AS DOUBLE), 'e': CAST(0 AS DOUBLE), 'v': x})),
      lambda s, x: {'l': 0.3 * x.v + 0.7 * (s.l + 0.9 * s.t), 't': 0.1 * (0.3 * x.v + 0.7 * (s.l + 0.9 * s.t) - s.l) + 0.9 * 0.9 * s.t, 'e': s.e + power(x.v - (s.l + 0.9 * s.t), 2), 'v': CAST(0 AS DOUBLE)}) AS s FROM a)
    SELECT metric_key, CAST(len(v) AS BIGINT) AS n, round(CAST(s.e AS DOUBLE), 6) AS sse, round(CAST(s.l AS DOUBLE), 6) AS level, round(CAST(s.t AS DOUBLE), 6) AS trend FROM st""",
)
def j17(spark, sf):
    return rounded(C.holt_fixed(V.dense(spark, sf), ONE, 0.3, 0.1, 0.9), "sse", "level", "trend")

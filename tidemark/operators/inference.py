"""Descriptive and inferential statistics as aggregates over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import t_test_p


def describe(series: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, median, sd, quantiles, extremes, latest and scaled median deviation of each group."""
    first = series.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.lit(0.1)).alias("p10"), F.percentile("value", F.lit(0.9)).alias("p90"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "date").alias("latest"), F.max("date").alias("latest_date"),
    )
    middle = first.select(*keys, F.col("median").alias("_m"))
    spread = series.join(middle, keys).groupBy(*keys).agg((F.median(F.abs(F.col("value") - F.col("_m"))) * 1.4826).alias("mad"))
    return first.join(spread, keys)


def least_squares(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r2, standard error, t and p of y on x; groups below three rows or without spread in x are left out."""
    n = F.count("*")
    sums = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * n).alias("sxx"), (F.var_pop(y) * n).alias("syy"), (F.covar_pop(x, y) * n).alias("sxy")
    )
    fits = sums.where("n >= 3 AND sxx > 0").withColumn("slope", F.col("sxy") / F.col("sxx"))
    fits = fits.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("left", F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")))
    fits = fits.withColumn("r2", F.when(F.col("syy") == 0, 0.0).otherwise(1 - F.try_divide("left", "syy"))).withColumn("se", F.sqrt(F.col("left") / (F.col("n") - 2) / F.col("sxx")))
    fits = fits.withColumn("t", F.coalesce(F.try_divide("slope", F.nullif("se", F.lit(0.0))), F.lit(0.0))).withColumn("_df", F.col("n") - 2)
    return fits.withColumn("p", t_test_p("abs(t)", "_df")).select(*keys, "n", "slope", "intercept", "r2", "se", "t", "p")


def two_groups(rows: DataFrame, keys: list[str], value: str, second: Column) -> DataFrame:
    """Welch's t (second against first) and Cohen's d; null where a group has under two rows or both no spread."""
    a, b = F.when(~second, F.col(value)), F.when(second, F.col(value))
    s = rows.groupBy(*keys).agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    ea, eb = F.try_divide("va", "na"), F.try_divide("vb", "nb")
    s = s.withColumn("ea", ea).withColumn("eb", eb).withColumn("t", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.nullif(F.sqrt(F.col("ea") + F.col("eb")), F.lit(0.0))))
    df = F.try_divide(F.pow(F.col("ea") + F.col("eb"), 2.0), F.col("ea") * F.col("ea") / (F.col("na") - 1) + F.col("eb") * F.col("eb") / (F.col("nb") - 1))
    s = s.withColumn("df", F.when(F.col("t").isNotNull(), df)).withColumn("p", t_test_p("abs(t)", "df"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    d = F.try_divide(F.col("mean_b") - F.col("mean_a"), F.nullif(F.when(F.col("na") + F.col("nb") > 2, pooled), F.lit(0.0)))
    return s.select(*keys, "na", "nb", "mean_a", "mean_b", "t", "df", F.when(F.col("t").isNotNull(), F.col("p")).alias("p"), d.alias("effect"))


def drift_test(differences: DataFrame, keys: list[str]) -> DataFrame:
    """t-test of the first differences' mean; p is 1 below eight of them, 0 or 1 without spread."""
    s = differences.where("diff IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("sd"))
    s = s.withColumn("t", F.when(F.col("n") >= 8, F.try_divide("m", F.nullif(F.col("sd") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))))).withColumn("_df", F.col("n") - 1)
    p = F.when(F.col("n") < 8, 1.0).when(F.col("sd") == 0, F.when(F.col("m") == 0, 1.0).otherwise(0.0)).otherwise(t_test_p("abs(t)", "_df"))
    return s.select(*keys, "n", F.coalesce("t", F.lit(0.0)).alias("t"), p.alias("p"), F.when(F.col("n") >= 8, F.col("m")).otherwise(0.0).alias("per_step"))


def pairwise_trend(series: DataFrame, keys: list[str]) -> DataFrame:
    """Kendall's S and the Theil-Sen slope by a self-join of each series: the declarative form, for short series."""
    a = series.select(*keys, F.col("date").alias("d1"), F.col("value").alias("v1"))
    b = series.select(*keys, F.col("date").alias("d2"), F.col("value").alias("v2"))
    pairs = a.join(b, keys).where("d1 < d2")
    slope = (F.col("v2") - F.col("v1")) / F.date_diff("d2", "d1")
    return pairs.groupBy(*keys).agg(F.sum(F.signum(F.col("v2") - F.col("v1"))).cast("long").alias("s"), F.median(slope).alias("sen"))

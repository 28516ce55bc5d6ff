"""Operators on ordered daily series, one series for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import t_test_p
from tidemark.operators.scan import collected, scanned, states

WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def ordered(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def grid(series: DataFrame, keys: list[str]) -> DataFrame:
    """Every calendar day from a series' first to its last; missing days have a null value."""
    ends = series.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("z"))
    days = ends.select(*keys, F.explode(F.sequence("a", "z")).alias("date"))
    return days.join(series.select(*keys, "date", "value"), [*keys, "date"], "left")


def rolling_mean(days: DataFrame, keys: list[str], width: int, centred: bool = False) -> DataFrame:
    """Mean over ``width`` grid days (trailing, or around the day), of the days that have a value."""
    half = width // 2
    frame = ordered(keys).rowsBetween(-half, half) if centred else ordered(keys).rowsBetween(-(width - 1), 0)
    return days.withColumn("rolling", F.avg("value").over(frame))


def ewma(days: DataFrame, keys: list[str], half_life: float) -> DataFrame:
    """Exponentially weighted mean that the first value seeds; days without value carry it unchanged.

    Null before the first value. A NaN is no value.
    """
    alpha = 1 - 2 ** (-1 / half_life)
    rows = collected(days.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))), keys)
    at = F.array_compact(F.transform("days", lambda d, i: F.when(d["value"].isNotNull(), i)))
    seen = F.filter(F.transform("days", lambda d: d["value"]), lambda v: v.isNotNull())
    rows = rows.select(*keys, "days", at.alias("at"), F.transform(seen, lambda v, i: F.when(i == 0, v).otherwise(v * alpha)).alias("seen"))
    found = scanned(rows.withColumn("s", states([F.col("seen")])).drop("seen"), "s", [[1 - alpha]])
    after = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("days")))
    held = F.zip_with(F.col("at"), after, lambda p, n: n - p)
    smooth = F.flatten(F.zip_with("s", held, lambda v, n: F.array_repeat(v["x0"], n)))
    none = F.lit(None).cast("double")
    whole = F.when(F.size("at") > 0, F.concat(F.array_repeat(none, F.element_at("at", 1)), smooth)).otherwise(F.array_repeat(none, F.size("days")))
    dates, values = F.transform("days", lambda d: d["date"]), F.transform("days", lambda d: d["value"])
    return found.select(*keys, F.inline(F.arrays_zip(dates.alias("date"), values.alias("value"), whole.alias("ewma"))))


def interpolated(days: DataFrame, keys: list[str]) -> DataFrame:
    """Straight lines across gaps; after the last value it is held; days before the first are dropped."""
    back, ahead = ordered(keys).rowsBetween(Window.unboundedPreceding, 0), ordered(keys).rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("value").isNotNull(), F.struct(F.col("date").alias("d"), F.col("value").alias("v")))
    both = days.withColumn("p", F.last(seen, True).over(back)).withColumn("n", F.first(seen, True).over(ahead))
    share = F.date_diff("date", "p.d") / F.nullif(F.date_diff("n.d", "p.d"), F.lit(0))
    line = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * share
    return both.where("p IS NOT NULL").select(*keys, "date", "value", F.coalesce("value", line, "p.v").alias("filled"))


def buckets(series: DataFrame, keys: list[str], days: int, points: int = 40) -> DataFrame:
    """Means over buckets of ceil(days / points) days that begin at the first point.

    Values are summed as decimals of ten places, so a mean does not depend on the order of rows.
    """
    width = max(1, -(-days // points))
    first = F.min("date").over(Window.partitionBy(*keys))
    at = F.date_add("_first", (F.floor(F.date_diff("date", "_first") / width) * width).cast("int"))
    return series.withColumn("_first", first).groupBy(*keys, at.alias("date")).agg((F.sum(F.col("value").cast("decimal(28,10)")).cast("double") / F.count("value")).alias("value"))


def array_median(values: Column) -> Column:
    """The median of an array of numbers; null if it is empty."""
    ordered_values = F.sort_array(values)
    n = F.size(values)
    return (F.get(ordered_values, F.floor((n - 1) / 2).cast("int")) + F.get(ordered_values, F.floor(n / 2).cast("int"))) / 2.0


def robust_z(base: Column, value: Column) -> Column:
    """Distance from the median in scaled median deviations; null where these are 0."""
    middle = array_median(base)
    spread = array_median(F.transform(base, lambda x: F.abs(x - middle))) * 1.4826
    return F.try_divide(value - middle, F.nullif(spread, F.lit(0.0)))


def anomalies(series: DataFrame, keys: list[str], lookback: int = 42, threshold: float = 3.0) -> DataFrame:
    """Points whose robust z against the previous ``lookback`` points is extreme."""
    before = F.collect_list("value").over(ordered(keys).rowsBetween(-lookback, -1))
    scored = series.withColumn("_base", before).where(F.size("_base") == lookback).withColumn("z", robust_z(F.col("_base"), F.col("value")))
    return scored.where(F.abs("z") >= threshold).select(*keys, "date", "value", "z", F.when(F.col("z") > 0, "high").otherwise("low").alias("direction"))


def baseline_z(series: DataFrame, keys: list[str], window: int = 60, least: int = 10) -> DataFrame:
    """z of each point against up to ``window`` points before it, where there are ``least``."""
    before = ordered(keys).rowsBetween(-window, -1)
    sd = F.when(F.count("value").over(before) >= least, F.stddev_samp("value").over(before))
    z = F.try_divide(F.col("value") - F.avg("value").over(before), F.nullif(sd, F.lit(0.0)))
    return series.withColumn("z", z)


def differences(series: DataFrame, keys: list[str]) -> DataFrame:
    """First differences in order of observation."""
    return series.withColumn("diff", F.col("value") - F.lag("value").over(ordered(keys)))


def average_ranks(series: DataFrame, keys: list[str], column: str = "value") -> Column:
    """Ranks of a column with ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(w.partitionBy(*keys, column)) - 1) / 2.0


def weekday_profile(series: DataFrame, keys: list[str]) -> DataFrame:
    """Seven rows a series: mean of the weekday, its distance from all, Welch's p against the other days.

    Only sums by weekday are moved; the other days are the total less the day.
    """
    days = series.groupBy(*keys, (F.dayofweek("date") - 1).alias("dow")).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = series.groupBy(*keys).agg(F.count("value").alias("tn"), F.sum("value").alias("ts"), F.sum(F.col("value") * F.col("value")).alias("tq"))
    all_days = total.withColumn("dow", F.explode(F.array(*[F.lit(i) for i in range(7)])))
    rows = all_days.join(days, [*keys, "dow"], "left").fillna(0, ["n"]).fillna(0.0, ["s", "q"])
    rows = rows.withColumn("rn", F.col("tn") - F.col("n")).withColumn("mean", F.try_divide("s", "n")).withColumn("rmean", F.try_divide(F.col("ts") - F.col("s"), "rn"))
    var = lambda q, s, n: F.greatest(F.lit(0.0), F.try_divide(q - F.try_divide(s * s, n), n - 1))
    rows = rows.withColumn("va", F.try_divide(var(F.col("tq") - F.col("q"), F.col("ts") - F.col("s"), F.col("rn")), "rn")).withColumn("vb", F.try_divide(var(F.col("q"), F.col("s"), F.col("n")), "n"))
    enough = (F.col("n") >= 3) & (F.col("rn") >= 3) & (F.col("va") + F.col("vb") > 0)
    rows = rows.withColumn("t", F.when(enough, (F.col("mean") - F.col("rmean")) / F.sqrt(F.col("va") + F.col("vb"))))
    rows = rows.withColumn("df", F.when(enough, F.pow(F.col("va") + F.col("vb"), 2.0) / (F.col("va") * F.col("va") / (F.col("rn") - 1) + F.col("vb") * F.col("vb") / (F.col("n") - 1))))
    rows = rows.withColumn("p_value", t_test_p("abs(t)", "df"))
    rows = rows.withColumn("p_value", F.when(F.col("t").isNotNull(), F.col("p_value")))
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.col("dow") + 1)
    return rows.select(*keys, day.alias("day"), "n", "mean", (F.col("mean") - F.col("ts") / F.col("tn")).alias("delta"), "p_value", F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"))


def coverage(series: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Days of the window, days observed and their ratio, of every series (also without a day in it)."""
    a, z = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = F.date_diff(z, a) + 1
    return series.groupBy(*keys).agg(F.count_if(F.col("date").between(a, z)).alias("observed")).select(
        *keys, days.alias("days"), "observed", F.when(days > 0, F.least(F.lit(1.0), F.col("observed") / days)).otherwise(0.0).alias("ratio")
    )


def streaks(series: DataFrame, keys: list[str], holds: Column, end: str, most: int = 3651) -> DataFrame:
    """Length of the run of consecutive days, ending at ``end``, on which ``holds``; 0 if it does not then."""
    day = F.lit(end).cast("date")
    good = series.where(holds & (F.col("date") <= day))
    island = F.date_sub("date", F.row_number().over(ordered(keys)))
    runs = good.withColumn("_island", island).groupBy(*keys, "_island").agg(F.max("date").alias("z"), F.count("*").alias("n")).where(F.col("z") == day)
    return series.select(*keys).distinct().join(runs, keys, "left").select(*keys, F.least(F.coalesce("n", F.lit(0)), F.lit(most)).alias("streak"))

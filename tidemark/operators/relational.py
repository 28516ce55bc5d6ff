"""Small relational operators: tones, bands, event lists, heatmaps, scaling, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio_tone(acwr: Column, established: Column) -> Column:
    """Risk of the load ratio; null while the model warms up or has no ratio."""
    return F.when(established & acwr.isNotNull(), F.when(acwr > 1.5, "critical").when((acwr > 1.3) | (acwr < 0.8), "warning").otherwise("good"))


def form_tone(tsb: Column, established: Column) -> Column:
    return F.when(established & tsb.isNotNull(), F.when(tsb < -25, "critical").when((tsb < -10) | (tsb > 20), "warning").otherwise("good"))


def favourable(delta: Column, higher_is_better: Column) -> Column:
    """Whether a change goes the wanted way; null without direction or change."""
    return F.when(delta != 0, (delta > 0) == higher_is_better)


def three_bands(value: Column, high: float, low: float) -> Column:
    return F.when(value >= high, "high").when(value >= low, "middle").when(value.isNotNull(), "low")


def newest(events: DataFrame, by: list[str], most: int, order: list[Column]) -> DataFrame:
    """The first ``most`` rows of every group in a total order."""
    ranked = events.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_k") <= most).drop("_k")


def together(frames: list[DataFrame]) -> DataFrame:
    """A bag union by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def heatmap(series: DataFrame, keys: list[str], today: str, weeks: int) -> DataFrame:
    """weeks x 7 cells that end on the Saturday of this week, values scaled between the window's least and most."""
    end = F.date_add(F.lit(today).cast("date"), 7 - F.dayofweek(F.lit(today).cast("date")))
    days = F.explode(F.sequence(F.date_sub(end, weeks * 7 - 1), end, F.expr("interval 1 day")))
    cells = series.select(*keys).distinct().select(*keys, days.alias("date")).withColumn("row", F.dayofweek("date") - 1)
    joined = cells.join(series.select(*keys, "date", "value"), [*keys, "date"], "left")
    w = Window.partitionBy(*keys)
    low, span = F.min("value").over(w), F.max("value").over(w) - F.min("value").over(w)
    return joined.withColumn("shade", (F.col("value") - low) / F.when(span == 0, 1.0).otherwise(span))


def sparkline(series: DataFrame, keys: list[str], width: float = 1.0, height: float = 1.0) -> DataFrame:
    """Each point's place in a box: by its number along, by least and most value up."""
    w = Window.partitionBy(*keys)
    at = F.row_number().over(w.orderBy("date")) - 1
    steps = F.greatest(F.count("*").over(w) - 1, F.lit(1))
    span = F.max("value").over(w) - F.min("value").over(w)
    up = (F.col("value") - F.min("value").over(w)) / F.when(span == 0, 1.0).otherwise(span)
    return series.withColumn("x", at / steps * width).withColumn("y", up * height)


def domain(series: DataFrame, keys: list[str], margin: float = 0.12) -> DataFrame:
    """Least and most value with a margin; a flat series gets a tenth of its value, or 1."""
    ends = series.groupBy(*keys).agg(F.min("value").alias("a"), F.max("value").alias("z"))
    flat = F.when(F.col("z") == 0, 1.0).otherwise(F.abs("z") * 0.1)
    pad = F.when(F.col("a") == F.col("z"), flat).otherwise((F.col("z") - F.col("a")) * margin)
    return ends.select(*keys, (F.col("a") - pad).alias("low"), (F.col("z") + pad).alias("high"))


def search(dictionary: DataFrame, columns: list[str], words: str) -> DataFrame:
    """Rows of a dictionary that have the words in one of the columns, whatever the case."""
    text = F.lower(F.concat_ws("\n", *columns))
    return dictionary.where(text.contains(words.lower().strip()))

"""Exported files as tables of text cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")


def sniff_delimiter(line: str) -> str:
    """The most frequent delimiter of a header line, the first of equals; a comma if there is none."""
    best = max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))
    return best if best in line else ","


def read_csv(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """All cells as text: doubled quotes, quoted line breaks, any delimiter; blank rows go, headers are trimmed.

    ``order`` names a column that numbers the rows in file order.
    """
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0].lstrip("﻿") if first else ""
    cells = spark.read.csv(path, header=True, sep=sniff_delimiter(line), quote='"', escape='"', multiLine=True, inferSchema=False, mode="PERMISSIVE", encoding="UTF-8")
    names = [c.lstrip("﻿").strip().strip('"') for c in cells.columns]
    cells = cells.toDF(*names)
    if names:
        cells = cells.where(reduce(lambda a, b: a | b, [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "" for c in names]))
    return cells.withColumn(order, F.monotonically_increasing_id()) if order else cells


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed API documents, a JSON text a line: (seq, day, body)."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return lines.select("seq", F.coalesce(F.get_json_object("value", "$.date"), F.get_json_object("value", "$.civilStartTime"), F.get_json_object("value", "$.sampleTime")).alias("day"), F.col("value").alias("body"))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with path, time and content."""
    return spark.read.format("binaryFile").load(path)


def write_store(metrics: DataFrame, path: str) -> None:
    """The long store as Parquet, a folder for each metric, so that a series read prunes the rest."""
    metrics.repartition("metric_key").write.mode("overwrite").partitionBy("metric_key").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)

"""The engine's relations as projections of the benchmark tables, in Spark and in SQL.

``*_SQL`` are common table expressions for the oracle; the functions give the same
rows. "Today" is always an explicit date.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_TODAY, ORDERS_TODAY, SETS_TODAY = "2024-01-30", "2001-08-01", "1999-01-01"
SOURCES = ("manual", "csv", "google_health", "photo", "derived")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder where the cluster keeps checkpoints, or a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


STORE_SQL = """store AS (
    SELECT CAST(user_id AS BIGINT) AS user_id, CAST(ts AS DATE) AS date, event_type AS metric_key, value,
           CASE event_id % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'csv' WHEN 2 THEN 'google_health' WHEN 3 THEN 'photo' ELSE 'derived' END AS source,
           event_id AS seq
    FROM events)"""

PRIORITY_SQL = "CASE source WHEN 'manual' THEN 100 WHEN 'csv' THEN 80 WHEN 'google_health' THEN 60 WHEN 'photo' THEN 40 WHEN 'derived' THEN 20 ELSE 0 END"

RESOLVED_SQL = f"""{STORE_SQL},
resolved AS (
    SELECT user_id, metric_key, date, value, source FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, metric_key, date ORDER BY {PRIORITY_SQL} DESC, seq) AS rn FROM store) t
    WHERE rn = 1)"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long metric store, with several rows a day from different sources."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("metric_key"),
        "value",
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("event_id") % 5 + 1).cast("int")).alias("source"),
        F.col("event_id").alias("seq"),
    )


SERIES_SQL = """series AS (
    SELECT o_orderpriority AS metric_key, CAST(o_orderdate AS DATE) AS date,
           CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 AS value
    FROM orders GROUP BY 1, 2)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily series: order value by priority, over years (exact sums of cents)."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("metric_key"), F.to_date("o_orderdate").alias("date"))
        .agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 1e8).alias("value"))
    )


DENSE_SQL = """dense AS (
    SELECT event_type AS metric_key, CAST(ts AS DATE) AS date,
           CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / 1e6 AS value
    FROM events GROUP BY 1, 2)"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily series: event value by type over all users."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("metric_key"), F.to_date("ts").alias("date"))
        .agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 1e6).alias("value"))
    )


WORKOUTS_SQL = """workouts AS (
    SELECT o_custkey % 20 AS user_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS type,
           CASE o_orderkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'csv' ELSE 'google_health' END AS source,
           CAST(o_orderkey % 121 AS DOUBLE) AS duration_min,
           CASE WHEN o_orderkey % 4 < 2 THEN CAST(90 + o_orderkey % 90 AS DOUBLE) END AS avg_hr,
           CASE WHEN o_orderkey % 4 = 2 THEN CAST(1 + o_orderkey % 10 AS DOUBLE) END AS rpe,
           o_orderkey AS external_id
    FROM orders)"""


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from orders."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("user_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("type"),
        F.when(k % 3 == 0, "manual").when(k % 3 == 1, "csv").otherwise("google_health").alias("source"),
        (k % 121).cast("double").alias("duration_min"),
        F.when(k % 4 < 2, (90 + k % 90).cast("double")).alias("avg_hr"),
        F.when(k % 4 == 2, (1 + k % 10).cast("double")).alias("rpe"),
        k.alias("external_id"),
    )


SETS_SQL = """sets AS (
    SELECT l_suppkey % 5 AS user_id, CAST(l_shipdate AS DATE) AS date, p_type AS exercise, l_orderkey AS session_name,
           CAST(ROUND(l_extendedprice * 100) AS BIGINT) / 100.0E0 / l_quantity / 10.0E0 AS weight_kg,
           l_quantity AS reps, ROUND(l_discount * 100) AS rpe, l_linenumber AS set_order
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength sets from line items and part types; the parts grow with the data, so both sides are exchanged."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").hint("shuffle_hash"), F.col("p_partkey") == F.col("l_partkey"))
        .select(
            (F.col("l_suppkey") % 5).alias("user_id"),
            F.to_date("l_shipdate").alias("date"),
            F.col("p_type").alias("exercise"),
            F.col("l_orderkey").alias("session_name"),
            (F.round(F.col("l_extendedprice") * 100).cast("long") / 100.0 / F.col("l_quantity") / 10.0).alias("weight_kg"),
            F.col("l_quantity").alias("reps"),
            F.round(F.col("l_discount") * 100).alias("rpe"),
            F.col("l_linenumber").alias("set_order"),
        )
    )


def with_sql(*ctes: str) -> str:
    """WITH clause of common table expressions, each once."""
    return "WITH " + ",\n".join(ctes) + "\n"

"""Cells and documents are read once and by the short way, and what grows is not what goes to every task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse as P
from tidemark.operators import goals as G
from tidemark.operators import ingest as N
from tidemark.plans import derive, sync
from tidemark.plans import views as V

NUMBERS = [
    "12", "-0.50", "+7", "170.0 lb", "170.0lb", "3 reps", "9%", "5 h", "5h", "15 Min", "90sec", "5e", "5 E", "5e3", "-2E-2", "1.234", "1,234", "12.", ".5", "1.2.3", "12/05/2024", "2024-05-12", "-1-2-3", "7 e", "1234567890123456789",
    "1" * 400, "3 km/h", "4 kg x", "12 µg", "$5", "(3)", "- 4", "--4", "+-4", "5\n", "5 lb\n", " 6 ", "6 kg", "n/a", "", "e", "1d", "2f", "0x10", "NaN", "8 hours", "8 hourly", "8 s.", None,
]
DATES = ["2024-02-29", "2023-02-29", "1899-12-31", "1900-01-01", "2200-12-31", "2201-01-01", "2024-13-01", "2024-00-10", "2024-1-5", "2024-01-05T08:00:00Z", "2024-01-05\n", " 2024-01-05", "05/01/2024", "31/02/2024", "1/13/24", "Jan 5, 2024", "5.1.99", "", "soon", None]


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_ways_give_what_peeling_gives(spark):
    cells = spark.createDataFrame([(i, c) for i, c in enumerate(NUMBERS)], "i int, c string")
    for row in cells.select("c", P.parse_number(F.col("c")).alias("a"), P.peeled_number(F.col("c")).alias("b")).collect():
        assert str(row.a) == str(row.b), row
    days = spark.createDataFrame([(i, c) for i, c in enumerate(DATES)], "i int, c string")
    for row in days.select("c", P.parse_date(F.col("c")).alias("a"), P.peeled_date(F.col("c")).alias("b")).collect():
        assert row.a == row.b, row


def test_plain_cells_are_not_peeled(spark, monkeypatch):
    monkeypatch.setattr(P, "peeled_number", lambda raw: F.lit(None).cast("double"), raising=False)
    monkeypatch.setattr(P, "peeled_date", lambda raw, day_first=True: F.lit(None).cast("date"), raising=False)
    row = spark.createDataFrame([("170.0 lb", "2024-02-29", "(3)")], "n string, d string, odd string").select(P.parse_number(F.col("n")), P.parse_date(F.col("d")), P.parse_number(F.col("odd"))).first()
    assert tuple(row) == (170.0, dt.date(2024, 2, 29), None)


def test_merge_parses_each_text_once(spark):
    rows = spark.createDataFrame([('{"b":1,"a":{"x":[1]}}', '{"b":null,"c":"z"}'), ("no", None), ('{"a":1}', "[2]")], "o string, n string")
    merged = rows.select(G.merge_json(F.col("o"), F.col("n")).alias("m"))
    assert [r.m for r in merged.collect()] == ['{"a":{"x":[1]},"b":null,"c":"z"}', "{}", '{"a":1}']
    assert optimised(merged).count("variant_get") == 2


@pytest.mark.parametrize(
    ("day", "date"),
    [
        ('"2024-01-05"', "2024-01-05"), ("2024-01-05T07:00:00Z", "2024-01-05"), ('{"date":{"year":2024,"month":1,"day":5}}', "2024-01-05"), ('{"civilTime":{"date":{"year":"2024","month":"01","day":"05"}}}', "2024-01-05"),
        ('{"year":2024,"month":2,"day":30}', None), ('{"year":2024,"month":1}', None), ('{"year":12345,"month":1,"day":1}', None), ('{"year":987,"month":1,"day":1}', "0987-01-01"), ('{"year":2024,"month":-1,"day":1}', None),
        ('{"date":{"year":2024,"month":13,"day":1},"year":2023,"month":4,"day":6}', "2023-04-06"), ('"2024-02-30"', None), ("{", None), (None, None),
    ],
)
def test_civil_dates(spark, day, date):
    assert spark.createDataFrame([(day,)], "d string").select(N.civil_date(F.col("d")).cast("string")).first()[0] == date


def test_documents_are_read_once(spark):
    docs = spark.createDataFrame([(1, '{"year":2024,"month":1,"day":5}', '{"activeMinutesRollupByActivityLevel":[{"activityLevel":"LIGHT","activeMinutesSum":"4"},{"activityLevel":"VIGOROUS","activeMinutesSum":3}]}'), (2, "no", "{}")], "seq long, day string, body string")
    points = N.api_points(docs, "active-minutes")
    assert sorted((r.metric_key, r.value) for r in points.collect()) == [("active_minutes", 7.0), ("moderate_vigorous_min", 3.0)]
    plan = optimised(points)
    assert plan.count("$.year") == 1 and plan.count("$.activeMinutesRollupByActivityLevel") == 1
    pages = spark.createDataFrame([(1, "steps", "2024-01-01", 0, 0, None, '{"year":2024,"month":1,"day":5}', '{"countSum":"4"}', None)], "user_id long, kind string, window string, page int, place int, name string, day string, body string, message string")
    points = sync.document_points(pages, "2024-01-01", "2024-01-31")
    assert [(r.metric_key, r.value) for r in points.collect()] == [("steps", 4.0)]
    assert optimised(points).count("$.year") == 1


def test_changes_and_parts_do_not_go_to_every_task(spark, tmp_path):
    spark.range(3).selectExpr("id AS user_id", "'sets' AS metric_key", "DATE '2024-01-01' AS first_day").write.parquet(f"{tmp_path}/changes")
    plan = physical(derive.affected(spark.read.parquet(f"{tmp_path}/changes")))
    assert "Broadcast" not in plan
    assert "BroadcastHashJoin" not in physical(V.sets(spark, "/root/testdata/sf0.001"))

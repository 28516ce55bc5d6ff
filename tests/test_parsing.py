"""The contracts of the cell parsers."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import ingest
from tidemark.sources import files

NUMBERS = {
    "1,234.56": 1234.56, "1.234,56": 1234.56, "1234.56": 1234.56, "0,5": 0.5, "12": 12, "-3.5": -3.5, "1000 steps": 1000, "12 reps": 12, "5 miles": 5, "70 kg": 70, "50%": 50, "$1,250.00": 1250,
    "−5": -5, "–5": -5, "(1.5)": -1.5, "1.5e3": 1500, "12/05/2024": None, "2024-05-12": None, "1:30": None, "7.5h": None, "": None, "N/A": None, "—": None, "abc": None, "1.5e": None, "$-5": None, "1.2.3": None, "1,234,567": 1234567, "1,2,3": None, "1.234.567,8": 1234567.8, "1,2.3.4": None, ".5": 0.5, "5,": 5, "USD 5": None, "5 km h": None, "£ 12 p/m": 12, "- $3": -3, "(2 kg)": -2, "()": None, "12,34,567": 1234567, "3 e": None, "1,": 1, ",": None,
}
DURATIONS = {"1:30": 90, "1:30:00": 90, "1h 30m": 90, "1.5h": 90, "90m": 90, "90 min": 90, "PT1H30M": 90, "2h": 120, "45s": 0.75, "0:45:30": 45.5, "1h 15min 30s": 75.5, "90": None, "": None, "P1DT2H": 120, "1:75": None, "1:30.5": None, "1:02:03.5": 62 + 3.5 / 60, "2 Hours 5 Mins": 125, "a:b": None, "n/a": None}
DATES = {
    "2024-05-12": "2024-05-12", "12/05/2024": "2024-05-12", "29/02/2024": "2024-02-29", "05/13/2024": "2024-05-13", "1.2.99": "1999-02-01", "Mar 12, 2024": "2024-03-12",
    "2024-05-12T08:00:00Z": "2024-05-12", "Tue, 12 March 2024 10:30": "2024-03-12", "March 12th, 2024": "2024-03-12", "2024 Mar 3": "2024-03-03", "Mar 2024": "2024-03-01", "12 Foo 2024": None, "Feb 30, 2024": None, "Tue Mar 12 2024 08:00:00 GMT+0100": "2024-03-12", "12-May-2024": "2024-05-12",
    "2024-13-45": None, "31/02/2024": None, "0/0/2024": None, "2024-02-30": None, "29/02/2023": None, "": None, "not a date": None,
}


@pytest.mark.parametrize("parser, cases", [(parse.parse_number, NUMBERS), (parse.parse_duration, DURATIONS), (parse.parse_date, DATES)])
def test_contract(spark, parser, cases):
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "cell string")
    got = {r["cell"]: r["v"] for r in rows.select("cell", parser(F.col("cell")).alias("v")).collect()}
    assert got.pop(None) is None
    for cell, want in cases.items():
        found = got[cell].isoformat() if isinstance(got[cell], datetime.date) else got[cell]
        assert found == (pytest.approx(want) if isinstance(want, (int, float)) else want), cell


def test_header_maps_and_plans():
    assert ingest.auto_map(["Date", "Body Weight", "Notes"]) == {"Date": "date", "Body Weight": "weight_kg"}
    assert ingest.auto_map(["When", "Total steps walked"])["Total steps walked"] == "steps"
    plan = ingest.rules_plan(["When", "Mood"], {"When": 0.9})
    assert {c.header: c.metric for c in plan.columns} == {"When": "date", "Mood": "mood"}
    wild = ingest.ImportPlan("metrics", (ingest.ColumnPlan("a", "weight_kg", "magic", 0.0), ingest.ColumnPlan("b", "BAD KEY"), ingest.ColumnPlan("zzz", "mood"), ingest.ColumnPlan("d", None)))
    clean = ingest.sanitise(wild, ["a", "b", "d"], {"weight_kg"}, {"d": 0.95})
    assert [(c.header, c.metric, c.transform, c.scale) for c in clean.columns] == [("a", "weight_kg", "none", None), ("b", None, "none", None), ("d", "date", "none", None)]


def test_proposals_are_made_fit():
    new = ingest.NewMetric("x" * 99, "u" * 30, "nonsense", "yes", "median", 9.7)
    assert ingest.checked_metric(new, "h") == ingest.NewMetric("x" * 60, "u" * 16, "custom", None, "mean", 4)
    assert ingest.checked_metric(ingest.NewMetric("", None, "body", True, "sum", float("nan")), "h") == ingest.NewMetric("h", None, "body", True, "sum", 2)
    C = ingest.ColumnPlan
    sets = ingest.ImportPlan("sets", (C("a", "reps"), C("b", "reps", confidence="sure"), C("c", "mood", new_metric=new), C("d", "date", reasoning="r" * 300)), ("w" * 300,) * 9)
    clean = ingest.sanitise(sets, ["a", "b", "c", "d", "e"], {"mood"}, {})
    assert [(c.header, c.metric, c.confidence) for c in clean.columns] == [("a", "reps", "high"), ("b", None, "medium"), ("c", None, "high"), ("d", "date", "high"), ("e", None, "low")]
    assert len(clean.columns[3].reasoning) == 200 and [len(w) for w in clean.warnings] == [220] * 6
    metrics = ingest.ImportPlan("other", (C("a", "cups", new_metric=new), C("b", "tea"), C("c", "9lives", new_metric=new), C("d", " weight_kg ")))
    clean = ingest.sanitise(metrics, ["a", "b", "c", "d", "e", "f"], {"weight_kg"}, {"e": 0.7, "f": 0.7})
    assert clean.kind == "metrics" and [c.metric for c in clean.columns] == ["cups", None, None, "weight_kg", "date", None]
    assert ingest.new_definitions(clean) == [("cups", "x" * 60, "u" * 16, "custom", None, "mean", 4, True)]
    assert [c.metric for c in ingest.sanitise(metrics, ["a", "b"], set(), {}).columns] == ["cups", None]


def test_implausible_columns_lower_the_confidence(spark):
    rows = spark.createDataFrame([(i, str(150 + i), str(400 + i), "7") for i in range(9)], "k long, w string, s string, ok string")
    C = ingest.ColumnPlan
    plan = ingest.ImportPlan("metrics", (C("w", "weight_kg", "kg_to_lb" if "kg_to_lb" in ingest.TRANSFORMS else "none"), C("s", "sleep_hours", reasoning="by name"), C("ok", "sleep_hours")), tuple(f"w{i}" for i in range(9)))
    checked = ingest.checked_plan(rows, plan, "k")
    by_header = {c.header: c for c in checked.columns}
    assert by_header["s"].confidence == "low" and by_header["s"].reasoning.startswith("by name; about 404") and by_header["ok"].confidence == "high"
    assert len(checked.warnings) <= 10 and checked.warnings[:9] == plan.warnings and checked.warnings[9].endswith(("would fit", "check the unit"))
    assert ingest.checked_plan(rows, ingest.ImportPlan("sets", plan.columns), "k").columns == plan.columns


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿day ; "a note"\r\n2024-01-01;"says ""hi""; ok"\r\n ; \r\n2024-01-02;"two\nlines"\r\n')
    rows = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert rows.columns == ["day", "a note"]
    assert [tuple(r) for r in rows.collect()] == [("2024-01-01", 'says "hi"; ok'), ("2024-01-02", "two\nlines")]
    assert files.sniff_delimiter("a,b;c;d") == ";" and files.sniff_delimiter("one") == ","

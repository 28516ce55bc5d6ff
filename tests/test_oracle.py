"""Every query that has SQL gives the same rows in Spark and in DuckDB."""

import math

import duckdb
import pytest

from tidemark import registry
from tidemark.plans import views as V

DATA = "/root/testdata/sf0.001"
#: Series without a shift have no change points.
MAY_BE_EMPTY = {"j10_change_points"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0) for x in r])


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, duck, name):
    frame = registry.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in frame.collect()])
    result = duck.sql(registry.ORACLE[name])
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    want = ordered([tuple(plain(r[i]) for i in place) for r in result.fetchall()])
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert rows or name in MAY_BE_EMPTY


def test_planted_shifts_are_found(spark):
    """Each series' shift of three standard deviations is found within ten observations."""
    days = {}
    for r in V.series(spark, DATA).select("metric_key", "date").collect():
        days.setdefault(r.metric_key, []).append(r.date)
    found = registry.QUERIES["j10_planted_shifts"](spark, DATA).collect()
    for key, of in days.items():
        of.sort()
        at = next(i for i, d in enumerate(of) if str(d) >= "1998-06-01")
        near = [r for r in found if r.metric_key == key and abs(of.index(r.date) - at) <= 10]
        assert near and near[0].delta > 0

"""Planning of requests, pages in turn, isolated failures."""

import datetime as dt
import json

import pytest

from tidemark.plans import sync
from tidemark.sources import pages
from tidemark.sources.pages import Landed, PageReader, PagedSource, Request, documents, planned, windows


def put(root, kind, user, token, page, window="2024-01-01"):
    folder = root / f"kind={kind}" / f"window={window}" / f"user={user}" / f"token={token}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text(page if isinstance(page, str) else json.dumps(page))


def weights(*grams, day="2024-01-05", after=None):
    points = [{"weight": {"sampleTime": {"physicalTime": f"{day}T07:00:00Z"}, "weightGrams": str(g)}} for g in grams]
    return {"dataPoints": points} | ({"nextPageToken": after} if after else {})


def test_windows_cover_every_day_once():
    for kind, most in (("heart-rate", 14), ("steps", 90), ("weight", 180)):
        found = list(windows(kind, dt.date(2023, 1, 1), dt.date(2024, 3, 1)))
        days = [a + dt.timedelta(i) for a, z in found for i in range((z - a).days + 1)]
        assert days == [dt.date(2023, 1, 1) + dt.timedelta(i) for i in range(426)]
        assert max((z - a).days + 1 for a, z in found) == most
        # No window crosses from one request of 180 days into the next.
        assert all((a - dt.date(2023, 1, 1)).days // 180 == (z - dt.date(2023, 1, 1)).days // 180 for a, z in found)
    assert list(windows("steps", dt.date(2024, 1, 2), dt.date(2024, 1, 1))) == []


def test_requests_are_dealt_to_partitions():
    with pytest.raises(ValueError, match="unknown kinds: naps"):
        planned(["naps"], "2024-01-01", "2024-01-02", 1)
    options = {"root": "/x", "start": "2024-01-01", "end": "2024-01-31", "kinds": "heart-rate, weight", "splits": "2"}
    every = planned(["heart-rate", "weight"], "2024-01-01", "2024-01-31", 2)
    assert len(every) == 8 and [len(p.requests) for p in PageReader(options).partitions()] == [1] * 8
    dealt = PageReader(options | {"concurrency": "5"}).partitions()
    assert len(dealt) == 5 and sorted(str(r) for p in dealt for r in p.requests) == sorted(map(str, every))


def test_users_are_split_whole(tmp_path):
    for user in range(30):
        put(tmp_path, "weight", user, "first", weights(1))
    requests = [Request("weight", "2024-01-01", "2024-01-31", i, 4) for i in range(4)]
    found = [Landed(str(tmp_path)).users(r) for r in requests]
    assert sorted(u for us in found for u in us) == list(range(30)) and sum(map(bool, found)) > 1
    assert Landed(str(tmp_path)).users(Request("steps", "2024-01-01", "2024-01-31", 0, 1)) == []


def test_a_failure_ends_its_own_request(tmp_path):
    put(tmp_path, "weight", 1, "first", weights(70_000, after="b"))
    put(tmp_path, "weight", 1, "b", weights(71_000, 72_000))
    put(tmp_path, "weight", 2, "first", weights(60_000, after="b"))
    put(tmp_path, "weight", 2, "b", {"error": {"code": 403, "message": "no scope"}})
    put(tmp_path, "weight", 3, "first", "{not json")
    put(tmp_path, "weight", 4, "first", weights(1, after="first"))
    put(tmp_path, "weight", 5, "first", weights(1, after="gone"))
    put(tmp_path, "weight", 6, "first", [1, 2])
    put(tmp_path, "weight", 7, "first", {"dataPoints": ["odd"]})
    put(tmp_path, "weight", 8, "first", {})
    transport, request = Landed(str(tmp_path)), Request("weight", "2024-01-01", "2024-01-31", 0, 1)
    ended = {u: list(documents(transport, u, request))[-1] for u in range(1, 9)}
    assert [len(list(documents(transport, u, request))) for u in (1, 2, 8)] == [4, 2, 1]
    assert {u: r[-1] for u, r in ended.items()} == {
        1: None, 2: "403 weight: no scope", 3: "weight: page first is no JSON", 4: "weight: page first comes twice", 5: "404 weight: no page gone", 6: "500 weight: None", 7: "'str' object has no attribute 'get'", 8: None,
    }
    assert all(r[4] == -1 and r[7] is None for r in ended.values())


def test_listed_kinds_end_after_so_many_pages(tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "LISTED_PAGES", 3)
    for kind, key in (("weight", "dataPoints"), ("steps", "rollupDataPoints")):
        for i in range(5):
            put(tmp_path, kind, 1, "first" if not i else f"p{i}", {key: []} | ({"nextPageToken": f"p{i + 1}"} if i < 4 else {}))
    ends = [list(documents(Landed(str(tmp_path)), 1, Request(k, "2024-01-01", "2024-01-31", 0, 1)))[-1] for k in ("weight", "steps")]
    assert [e[3] for e in ends] == [3, 5] and [e[-1] for e in ends] == [None, None]


def test_sync_of_landed_pages(spark, tmp_path):
    put(tmp_path, "weight", 1, "first", weights(70_000, 71_000, after="b"))
    put(tmp_path, "weight", 1, "b", weights(72_000))
    put(tmp_path, "weight", 2, "first", weights(60_000, after="b"))
    put(tmp_path, "weight", 2, "b", {"error": {"code": 401, "message": "UNAUTHENTICATED"}})
    put(tmp_path, "steps", 2, "first", {"rollupDataPoints": [{"civilStartTime": {"date": {"year": 2024, "month": 1, "day": 3}}, "steps": {"countSum": "900"}}, {"civilStartTime": None, "steps": {"countSum": "1"}}]})
    put(tmp_path, "height", 2, "first", {"dataPoints": [{"height": {"sampleTime": {"physicalTime": "2031-01-05T07:00:00Z"}, "heightMillimeters": 1800}}]})
    put(tmp_path, "sleep", 1, "first", {"dataPoints": [{"sleep": {"interval": {"startTime": "2024-01-04T23:30:00Z", "endTime": "2024-01-05T06:30:00Z"}, "stages": [{"type": "deep", "startTime": "2024-01-05T00:00:00Z", "endTime": "2024-01-05T01:30:00Z"}]}}, {"sleep": {}}]})
    put(tmp_path, "exercise", 1, "first", {"dataPoints": [{"name": "a/b/x1", "exercise": {"interval": {"startTime": "2024-01-04T10:00:00Z", "endTime": "2024-01-04T10:30:00Z"}, "exerciseType": "RUN"}}, {"name": "a/b/x2", "exercise": {"interval": {"startTime": "2024-01-04T10:00:00Z", "endTime": "2024-01-06T10:30:00Z"}}}]})
    PagedSource.register(spark)
    read = spark.read.format("tidemark_pages").options(root=str(tmp_path), start="2024-01-01", end="2024-01-31", splits="3", concurrency="4").load()
    assert read.rdd.getNumPartitions() == 4
    got = sync.sync(read, "2024-01-01", "2024-01-31")
    points = {(r.user_id, str(r.date), r.metric_key): r.value for r in got.points.collect()}
    assert points == {
        (1, "2024-01-05", "weight_kg"): 72.0, (2, "2024-01-03", "steps"): 900.0, (1, "2024-01-05", "sleep_hours"): 7.0, (1, "2024-01-05", "sleep_efficiency"): 100.0,
        (1, "2024-01-05", "deep_sleep_min"): 90.0, (1, "2024-01-05", "sleep_start_hour"): -0.5,
    }
    assert [(r.user_id, r.external_id, str(r.date), r.type, r.name, r.duration_min) for r in got.workouts.collect()] == [(1, "x1", "2024-01-04", "RUN", "RUN", 30.0)]
    log = {(r.user_id, r.kind): (r.ok, r.rows, r.message) for r in got.log.collect()}
    assert log == {
        (1, "weight"): (True, 1, None), (2, "weight"): (False, 0, "401 weight: UNAUTHENTICATED"), (2, "steps"): (True, 1, None), (2, "height"): (True, 0, None), (1, "sleep"): (True, 4, None), (1, "exercise"): (True, 1, None),
    }

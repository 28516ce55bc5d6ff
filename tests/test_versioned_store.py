"""The versioned store: touched folders, late and repeated batches, conflicts, removal of old versions, streams."""

import datetime as dt
import random
from pathlib import Path

import pytest

from tidemark.sources.versioned import Conflict, VersionedStore
from tidemark.streaming import ingest

DAY = dt.date(2024, 1, 1)
SCHEMA = "user_id long, date date, metric_key string, value double, source string, seq long"


def batch(spark, rows):
    return spark.createDataFrame([(u, DAY + dt.timedelta(d) if d is not None else None, m, v, s, q) for u, d, m, v, s, q in rows], SCHEMA)


def held(store, **how):
    return {(r.user_id, r.date, r.metric_key, r.source): (r.value, r.seq) for r in store.read(**how).collect()}


def files(root):
    return {p.relative_to(root): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet") if "/data/" in str(p)}


def test_only_touched_folders_are_written(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=4)
    assert held(store) == {}
    first = store.upsert(batch(spark, [(u, d, m, float(u + d), "csv", 1) for u in range(12) for d in range(3) for m in ("steps", "heart rate/min", "7")]))
    assert first.count() == 36 and {r.first_day for r in first.collect()} == {DAY}
    before = files(tmp_path)
    changed = store.upsert(batch(spark, [(3, 1, "steps", 99.0, "csv", 5), (3, 2, "steps", 98.0, "csv", 5)])).collect()
    assert [tuple(r) for r in changed] == [(3, "steps", DAY + dt.timedelta(1))]
    after = files(tmp_path)
    assert before.items() <= after.items() and len({p.parts[2:4] for p in after.keys() - before.keys()}) == 1
    assert held(store)[(3, DAY + dt.timedelta(1), "steps", "csv")] == (99.0, 5) and len(held(store)) == 108
    assert len(held(store, keys=["heart rate/min"])) == 36 and len(held(store, number=1)) == 108
    assert held(store, number=1)[(3, DAY + dt.timedelta(1), "steps", "csv")] == (4.0, 1)


def test_repeated_and_late_batches_change_nothing(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    rows = [(1, 0, "m", 1.0, "csv", 7), (1, 0, "m", 2.0, "csv", 8), (1, 0, "m", 3.0, "manual", 1)]
    store.upsert(batch(spark, rows))
    number, seen = store.manifest()[0], files(tmp_path)
    for again in (rows, [(1, 0, "m", 5.0, "csv", 3)], [(None, 0, "m", 1.0, "csv", 9), (1, None, "m", 1.0, "csv", 9), (1, 0, "m", float("nan"), "csv", 9), (1, 0, None, 1.0, "csv", 9)], []):
        assert store.upsert(batch(spark, again)).count() == 0
    assert store.manifest()[0] == number and files(tmp_path) == seen
    assert set(held(store).values()) == {(2.0, 8), (3.0, 1)}


def test_batches_in_any_order_give_the_same_store(spark, tmp_path):
    random.seed(1)
    rows = [(random.randrange(3), random.randrange(3), random.choice("ab"), float(q), "csv", q) for q in range(60)]
    want = {}
    for u, d, m, v, s, q in rows:
        want[(u, DAY + dt.timedelta(d), m, s)] = (v, q)
    parts = [rows[i::4] for i in range(4)]
    random.shuffle(parts)
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=2)
    for part in parts:
        store.upsert(batch(spark, part))
    assert held(store) == want


def test_a_conflict_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    store, other = VersionedStore(spark, root), VersionedStore(spark, root)
    store.upsert(batch(spark, [(1, 0, "m", 1.0, "csv", 1)]))
    write, raced = store.folder.write_new, []

    def late(name, text):
        if not raced:
            raced.append(name)
            other.upsert(batch(spark, [(1, 0, "m", 2.0, "csv", 2), (2, 0, "n", 2.0, "csv", 2)]))
        write(name, text)

    monkeypatch.setattr(store.folder, "write_new", late)
    changed = store.upsert(batch(spark, [(1, 0, "m", 9.0, "csv", 9)]))
    assert changed.count() == 1 and store.manifest()[0] == 3
    assert set(held(store).values()) == {(9.0, 9), (2.0, 2)}
    with pytest.raises(Conflict):
        store.folder.write_new("manifests/000000000003.json", "[]")


def test_vacuum_keeps_what_the_last_manifests_name(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=1)
    for q in range(1, 5):
        store.upsert(batch(spark, [(1, 0, "m", float(q), "csv", q)] + ([(1, 0, "n", 1.0, "csv", 1)] if q == 1 else [])))
    assert len(files(tmp_path)) == 5 and store.vacuum(keep=2) == 2
    assert len(files(tmp_path)) == 3 and store.manifests() == [3, 4]
    assert set(held(store).values()) == {(4.0, 4), (1.0, 1)} and set(held(store, number=3).values()) == {(3.0, 3), (1.0, 1)}
    assert store.vacuum(keep=2) == 0


def test_stream(spark, tmp_path):
    source, target, seen = str(tmp_path / "in"), str(tmp_path / "s"), []
    for q, rows in enumerate(([(1, 0, "m", 5.0, "csv", 2)], [(1, 0, "m", 4.0, "csv", 1), (2, 3, "m", 1.0, "csv", 3)])):
        batch(spark, rows).write.mode("append").parquet(source)
        ingest.start(spark.readStream.schema(SCHEMA).parquet(source), target, str(tmp_path / "check"), lambda keys: seen.append(sorted(map(tuple, keys.collect())))).awaitTermination()
    assert seen == [[(1, "m", DAY)], [(2, "m", DAY + dt.timedelta(3))]]
    assert set(held(VersionedStore(spark, target)).values()) == {(5.0, 2), (1.0, 3)}

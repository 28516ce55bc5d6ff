"""The log: batches once, repeated and failed tasks, readers of commits only."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources.log import LogSource, LogWriter, Store, Written

SCHEMA = "id long, note string"


@pytest.fixture
def log(spark, tmp_path):
    LogSource.register(spark)
    path = str(tmp_path / "log")
    write = lambda df, batch: df.write.format("tidemark_log").options(path=path, batch=batch).mode("append").save()
    read = lambda: sorted(r.id for r in spark.read.format("tidemark_log").schema(SCHEMA).options(path=path).load().collect())
    return path, write, read


def rows(spark, a, z):
    return spark.range(a, z, 1, 3).withColumn("note", F.lit("x"))


def files(path):
    return len(list(Path(path, "files").glob("*.parquet")))


def test_a_batch_is_written_once(spark, log):
    path, write, read = log
    assert read() == []
    write(rows(spark, 0, 10), "run/1")
    write(rows(spark, 10, 20), "run/2")
    kept = files(path)
    write(rows(spark, 0, 10), "run/1")
    assert read() == list(range(20)) and files(path) == kept
    write(rows(spark, 0, 0), "empty")
    assert read() == list(range(20)) and len(Store(path).commits()) == 3
    with pytest.raises(Exception, match="only appended"):
        rows(spark, 0, 1).write.format("tidemark_log").options(path=path, batch="b").mode("overwrite").save()


def test_a_failed_batch_leaves_nothing_to_read(spark, log):
    path, write, read = log
    broken = rows(spark, 0, 9).withColumn("note", F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        write(broken, "a")
    assert read() == [] and not Store(path).commits()
    write(rows(spark, 0, 9), "a")
    assert read() == list(range(9))


def test_repeated_tasks_and_commits(tmp_path):
    """Two attempts of a task, of which one is reported; two drivers that commit the same batch."""
    import pyarrow as pa

    path = str(tmp_path / "log")
    writer = LogWriter({"path": path, "batch": "b"})
    batch = pa.record_batch({"id": [1, 2]})
    lost, won = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([won, None, Written(None)])
    assert Store(path).commits() == [[won.name]] and lost.name != won.name
    again = writer.write(iter([batch]))
    writer.commit([again])
    assert Store(path).commits() == [[won.name]] and Store(path).text(again.name) is None
    writer.abort([lost, None])
    writer.abort([lost])
    assert files(path) == 1

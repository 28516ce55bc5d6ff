"""What a run leaves on disk while it goes on: shuffle files and written tables."""

import os
import random
import time

from pyspark.sql import functions as F

from tests.llm.test_side_by_side import tables
from tests.llm.test_whole_jobs import template_family
from tidemark.llm import common, components, near_dups


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n for d in manager.localDirsString() for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}


def test_shuffle_files_end_with_the_write(spark):
    was, before = spark.conf.get(common.CLEANUP), shuffle_files(spark)
    written = common.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    dealt = common.bucketed(written, "k", 1)
    for _ in range(100):  # executors are told, not waited for
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(common.CLEANUP) == was
    assert dealt.count() == 7
    common.forget(written, dealt)


def test_rounds_of_a_long_path(spark, monkeypatch):
    """A path whose nodes are in random order, beside a star and a cycle."""
    nodes = list(range(3000))
    random.Random(3).shuffle(nodes)
    links = list(zip(nodes, nodes[1:], strict=False)) + [(5000, n) for n in range(5001, 5100)] + [(6000 + i, 6000 + (i + 1) % 50) for i in range(50)] + [(7000, 7000)]
    written, most, before = [], 0, len(tables(spark))

    def counted(df):
        nonlocal most
        written.append(real(df))
        most = max(most, len(tables(spark)) - before)
        return written[-1]

    real = common.materialize
    monkeypatch.setattr(components, "materialize", counted)
    labels = components.components(spark.createDataFrame(links, "a long, b long"))
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert got == {n: 0 for n in range(3000)} | {n: 5000 for n in range(5000, 5100)} | {n: 6000 for n in range(6000, 6050)}
    assert len(written) <= 12 and most <= 3 and len(tables(spark)) - before == 1
    more = components.merged(labels, spark.createDataFrame([(2999, 5050), (6049, 8000), (8001, 8002)], "a long, b long"))
    after = {r["node"]: r["label"] for r in more.collect()}
    assert after == {n: 0 for n in [*range(3000), *range(5000, 5100)]} | {n: 6000 for n in [*range(6000, 6050), 8000]} | {8001: 8001, 8002: 8001}
    assert components.merged(more, spark.createDataFrame([(1, 2999), (8001, 8002)], "a long, b long")) is more
    common.forget(labels, more)


def test_tables_held_at_once_by_near_duplicates(spark, monkeypatch):
    """All steps run: sure links, open pairs, blocks of a large bucket."""
    docs = spark.createDataFrame([*template_family(13).items(), (900, "one two three"), (901, "one two three")], "doc_id long, text string")
    most, before, real = [], len(tables(spark)), common.materialize

    def counted(df):
        out = real(df)
        most.append(len(tables(spark)) - before)
        return out

    for module in (common, components, near_dups):
        monkeypatch.setattr(module, "materialize", counted)
    out = common.finished(lambda: near_dups.near_duplicates(docs))
    assert {r["doc_id"]: r["class_id"] for r in out.where("doc_id <> class_id").collect()} == {13249 - 13000: 248, 901: 900}
    assert max(most) <= 14 and len(tables(spark)) - before == 1
    common.discard(out)

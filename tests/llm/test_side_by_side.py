"""Queries of several threads, and of runs that fail, leave each other's tables alone."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import DATA
from tidemark.llm import common, queries


def tables(spark):
    base = os.path.dirname(common.shared_dir(spark)).removeprefix("file:")
    return {n for n in os.listdir(base) if n.startswith("tidemark-")}


def test_three_queries_at_once(spark):
    names, found, failed = ("op3_imatch_fingerprints", "op4_histogram_shards", "op8_source_mix"), {}, []
    before = tables(spark)

    def run(name):
        try:
            found[name] = queries.QUERIES[name](spark, DATA).count()
        except Exception as error:
            failed.append((name, str(error)[:500]))

    threads = [threading.Thread(target=run, args=(n,)) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and found["op3_imatch_fingerprints"] == found["op4_histogram_shards"] == 200
    assert len(tables(spark) - before) == 3


def test_nested_and_failed_runs(spark):
    before = tables(spark)

    def inner():
        common.materialize(spark.range(3))
        return common.materialize(spark.range(4))

    def outer():
        left, kept = common.materialize(spark.range(5)), common.finished(inner)
        return left.join(kept, "id")

    assert common.finished(outer).count() == 4 and len(tables(spark) - before) == 1

    def broken():
        common.bucketed(spark.range(9), "id", 1)
        common.materialize(spark.range(5))
        return spark.range(1).select(F.raise_error(F.lit("no")))

    with pytest.raises(Exception, match="no"):
        common.finished(broken)
    assert len(tables(spark) - before) == 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_")]

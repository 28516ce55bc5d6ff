"""The license scan against its SQL, which holds every block against every template, and on awkward tables."""

import random

import duckdb
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import DATA, awkward
from tidemark.llm import licenses, queries

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def by_sql(frame, sql):
    con = duckdb.connect()
    documents = frame.select("doc_id", "text").toArrow()  # noqa: F841
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sql}) t").fetchall(), key=repr)


def by_spark(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def test_against_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert by_spark(queries.op12_license_scan(spark, DATA)) == by_sql(docs, queries.ORACLE["op12_license_scan"])


def test_edited_and_wrapped_statements(spark):
    random.seed(4)
    filler = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(400):
        words = random.choices(filler, k=random.randrange(60))
        for _ in range(random.randrange(3)):
            statement = licenses.split_words(random.choice(licenses.TEMPLATES)[2])
            for _ in range(random.randrange(4)):
                p = random.randrange(len(statement))
                if random.random() < 0.5:
                    statement[p] = random.choice(filler)
                elif len(statement) > 1:
                    del statement[p]
            at = random.randrange(len(words) + 1)
            words[at:at] = statement
        texts.append(random.choice([" ", "\n", ", "]).join(words).title())
    texts += ["MIT License MIT license", "the mit\nlicense", "license mit", "GENERAL PUBLIC LICENSE", "mit licenses", "apache license apache-license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        got = by_spark(licenses.summarise(licenses.scan(docs, threshold=threshold)))
        assert got == by_sql(docs, licenses.brute_sql(threshold=threshold))
        assert sum(1 for r in got if r[6]) > 50


def test_spans(spark):
    text = "zero one two Released under the\nMIT License, five six"
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(p.label, p.word) for p in row.places] == [("mit", 6)]
    assert [(m.template, m.label, m.first_word, m.n_words, m.containment) for m in row.matches] == [("mit-released", "mit", 0, 10, 1.0)]


def test_awkward_tables(spark):
    extra = [(20, "x " * 30_000 + "mit license " * 20_000, "en", "a"), (20, "Licensed under CC BY-NC 4.0", None, None)]
    docs = awkward(spark).unionByName(awkward(spark, extra)).withColumn("labels", F.lit("x")).withColumn("row", F.lit("x")).withColumn("blocks", F.lit("x"))
    got = by_spark(licenses.summarise(licenses.scan(docs)))
    assert got == by_sql(docs, licenses.brute_sql()) and len(got) == 15
    assert (None, 0, 0, None, None, "", "", 0.0) in got and (20, 7, 0, None, None, "", "cc-by-nc", 1.0) in got
    assert (20, 70_000, 20_000, 30_000, 69_998, "mit", "mit", 1.0) in got
    assert licenses.scan(awkward(spark, [])).count() == 0

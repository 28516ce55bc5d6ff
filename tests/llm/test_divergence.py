"""The source audit against its SQL, on large counts, and on awkward tables."""

import duckdb
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import DATA, awkward
from tidemark.llm import divergence, queries

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def by_sql(frame, sql):
    con = duckdb.connect()
    documents = frame.select("doc_id", "text", "lang", "source").toArrow()  # noqa: F841
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sql}) t").fetchall(), key=repr)


def by_spark(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def test_against_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert by_spark(queries.op13_source_divergence(spark, DATA)) == by_sql(docs, queries.ORACLE["op13_source_divergence"])


def test_ties_case_and_groups_without_terms(spark):
    """Equal values rank by the item's bytes; groups without terms and languages without kept terms keep their pairs."""
    rows = [(i, "Éa éa Zebra zebra apple beta" if i % 3 else "apple, beta; gamma 1gamma", "en", f"s{i % 3}") for i in range(36)]
    rows += [(100 + i, "12 34 !", "en", "digits") for i in range(3)] + [(200, None, "en", None), (201, "lonely words", "xx", "a"), (202, "other", "xx", "b"), (203, "solo", "yy", "a"), (204, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = by_spark(divergence.audit(docs))
    assert got == by_sql(docs, queries.ORACLE["op13_source_divergence"])
    assert ("xx", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == "yy"]
    assert {r[3] for r in got if r[1] == ""} == {"digits", "s0", "s1", "s2"}


def test_exact_beyond_64_bits(spark):
    """10^9 times these counts leaves 64 bits."""
    frame = spark.createDataFrame([(97_000_000_000_123, 10**15 + 7, 3)], "c long, n long, v long")
    (got,) = frame.select(divergence.scaled_share("c", "n", "v").alias("p")).first()
    assert got == 1 + 10**9 * (97_000_000_000_123 + 2) // (10**15 + 7 + 6)


def test_awkward_tables(spark):
    many = spark.range(12).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same words in many rows").alias("text"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("source"))
    docs = awkward(spark).withColumns({"count": F.lit("x"), "p": F.lit("x"), "term": F.lit("x"), "terms": F.lit("x")}).unionByName(many, allowMissingColumns=True)
    assert by_spark(divergence.audit(docs)) == by_sql(docs, queries.ORACLE["op13_source_divergence"])
    assert divergence.audit(awkward(spark, [])).count() == 0

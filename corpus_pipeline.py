"""A training-corpus pipeline: five stages, each one of the corpus operators.

Every stage gets all documents that its predecessor kept, read again from Parquet,
and its decisions take effect. All but the last return the columns of ``documents``;
the last returns each document's place in the shards.

Columns beside doc_id, text, lang and source pass, whatever their names; a clash with an
operator's own columns is harmless, because stages keep the documents' columns. Every stage
takes empty tables, texts of any length, repeated rows and nulls in any column; each says
below what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, near_dups, quality, sharding
from tidemark.llm.common import discard, finished, table
from tidemark.llm.queries import held_out


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good.

    Null and empty texts score 0.5 and go. Rows with equal texts share their fate; ids play no part.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return docs.where(quality.scorer(spark, model)(F.col("text")) >= 0.7)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    Null and empty texts are copies of one another. Of rows that share an id one stays;
    rows without an id are all kept.
    """
    return near_dups.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts are clean. Rows with equal texts share their fate; ids play no part.
    """
    found = decontaminate.found_items(spark, F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.where(F.size(found) == 0)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that token weights meet the targets of the three marginals.

    A document whose cell is to grow is returned as often as it is drawn. Null sources and
    languages are levels of their own; null and empty texts have no tokens and go. Rows with
    equal ids are drawn alike, those without an id too.
    """
    return mixing.sample(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, repeated ones included; null ids and texts are values like others."""
    return sharding.shard_documents(docs, shards=40)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL cannot express the classifier, the signatures or the alignment; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last table stays."""
    docs, held = table(spark, sf_dir, "documents"), ()
    for _, stage in STAGES:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(*held)
        held = (docs,)
    return docs

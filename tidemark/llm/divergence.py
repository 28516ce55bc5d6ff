"""Audit of how far the sources of a language diverge in their words, in plain relations.

Regexp matches (what a split by the other characters leaves) are exploded and counted by
(lang, source, term) in one pre-aggregated exchange; equal matches of a document leave it
as one row with their number, so the same groups give document frequencies. A language keeps the terms in at least ``min_docs`` of its
documents. Each (lang, source) group is crossed with its language's kept terms, which
makes zeros dense, and the cells meet themselves on (lang, term): one pass gives the
squared difference of every two sources, summed over all kept terms. All arithmetic is
in whole numbers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) in decimals, because
10^9 times a count leaves 64 bits, and the rest in longs.

A language may hold most rows, so groups meet terms by (lang, salt), the salt a hash of
the term: no task sees a whole language. Cells are dealt by (lang, term), of which each
has one row a source. The best terms of a group are cut to ``top`` before they travel.

Null text, lang and source are read as ''; a group without terms, or in a language
without kept terms, still has its pairs (of value 0 where nothing is kept). Repeated rows
count as documents of their own, whatever their ids. Very long texts are read whole,
ties are broken by the item's bytes. An empty table gives no rows; columns other than
text, lang and source are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, materialize, runs_between, text_or_empty

#: Terms are runs of letters, all characters beyond ASCII among them.
SEPARATORS = r"\x00-\x40\x5B-\x60\x7B-\x7F"
SCALE = 1_000_000_000


def scaled_share(count: str, n: str, v: str) -> Column:
    """p = 1 + floor(SCALE (count + 2) / (n + 2 v)), exact."""
    return F.expr(f"1L + (CAST({count} + 2 AS DECIMAL(19, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div CAST({n} + 2 * {v} AS DECIMAL(20, 0))")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, df) of all documents.

    Equal terms of a document stand together in its sorted terms, so they leave it as one row.
    """
    lower = ascii_lower(text_or_empty("text"))
    terms = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), F.sort_array(runs_between(lower, SEPARATORS)).alias("terms"))
    begins = F.array_compact(F.transform("terms", lambda t, i: F.when((i == 0) | (F.get("terms", i - 1) != t), i)))
    runs = terms.select("lang", "source", "terms", begins.alias("begins"))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("terms")))
    counted = F.zip_with("begins", ends, lambda a, z: F.struct(F.get("terms", a).alias("term"), (z - a).alias("n")))
    return runs.select("lang", "source", F.inline(counted)).groupBy("lang", "source", "term").agg(F.sum("n").alias("count"), F.count("*").alias("df"))


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """Counts of the terms that their language keeps; ``head`` marks one row of each (lang, term)."""
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns(
        {"lang_df": F.sum("df").over(of_term), "lang_count": F.sum("count").over(of_term), "head": F.row_number().over(of_term.orderBy("source")) == 1}
    )
    return counts.where(F.col("lang_df") >= min_docs).select("lang", "source", "term", "count", "lang_count", "head")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, lang_n, v) of every occurring group: sums over kept terms and the number of these."""
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count_if("head").alias("heads"))
    of_lang = of_group.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("heads").alias("v"))
    return groups.join(of_group.drop("heads"), ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "lang_n", "v"])


def salted(kept: DataFrame, groups: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms with a salt, and every group once a salt."""
    terms = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)))
    return terms, groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


def dense_cells(kept: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """(lang, term, source, p): every group with every kept term of its language."""
    terms, sides = salted(kept.where("head").select("lang", "term"), groups.select("lang", "source", "n", "v"), salts)
    zeros = terms.join(sides, ["lang", "salt"]).select("lang", "term", "source", F.lit(0).cast("long").alias("count"), "n", "v")
    counted = kept.select("lang", "term", "source", "count")
    cells = (
        zeros.unionByName(counted, allowMissingColumns=True)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("count").alias("count"), F.max("n").alias("n"), F.max("v").alias("v"))
    )
    return cells.select("lang", "term", "source", scaled_share("count", "n", "v").alias("p"))


def terms_over(kept: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """(lang, source, item, value): the terms that a group has, and has more than its language; only counted cells are met."""
    terms, sides = salted(kept.select("lang", "source", "term", "count", "lang_count"), groups, salts)
    shares = terms.join(sides, ["lang", "source", "salt"]).select("lang", "source", "term", scaled_share("count", "n", "v").alias("p"), scaled_share("lang_count", "lang_n", "v").alias("q"))
    return shares.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each group and each other source of its language."""
    one = cells.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"))
    two = cells.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    sums = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(divergence("pa", "pb")).alias("value"))
    both = sums.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    return others.join(both, ["lang", "source", "item"], "left").na.fill(0, ["value"])


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language with the divergence of the two
    groups over all kept terms. Part ``term``: the ``top`` kept terms that the group uses
    more than its language does, with their divergence from the language.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("text", "lang", "source")
    kept = materialize(kept_counts(docs, min_docs))
    groups = materialize(group_totals(docs, kept))
    cells, over = dense_cells(kept, groups, salts), terms_over(kept, groups, salts)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(cells, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    terms = over.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)

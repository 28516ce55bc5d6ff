"""License statements in documents: phrases word by word, and an exact set-similarity join with templates.

A template is a license statement, seen as the set of its words. A block is a run of
consecutive words of a document; it meets a template if it holds at least ``threshold``
of the template's words (containment). Blocks of a template of n words are runs of 2 c
words that start at each multiple of c, c the least power of two that is not below n, so
every run of n words lies whole in a block. Every such block is found:

* Words of templates are ordered by their count in all documents, rarest first. A block
  that meets a template of k words, ``need`` of them wanted, holds one of the template's
  k - need + 1 first words (its prefix), so only blocks about such words are made.
* A block's words, cut to those that templates have, are sorted in the same order; it
  joins templates on its own prefix, if it has ``need`` words at all (length filter) and
  if the words left after the two places can still make ``need`` (positional filter).
* The two sorted sets are intersected.

Documents stay where they lie: the templates (of a bounded number of words, see
``MAX_TEMPLATE_WORDS``) go to them, and the joined rows of one document, which are
together already, are aggregated before they travel, without texts. The blocks of a
document hold at most two times its words for each template size. Only built-in
expressions run.

Null and empty texts have no words and no labels. Each row is scanned by itself, repeated
rows and ids alike; very long texts are scanned whole. An empty table gives no rows;
columns other than doc_id and text are not carried, whatever their names. A phrase of
one word is found as well; templates without words are refused.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, runs_between, text_or_empty

#: Words are runs of digits, lower-case letters and all characters beyond ASCII.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: What the driver holds and every task gets.
MAX_TEMPLATE_WORDS = 100_000

# Phrases whose places count, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license statements.
TEMPLATES = (
    ("mit-released", "mit", "Released under the MIT License"),
    ("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-licensed", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", "apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-licensed", "gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "all-rights-reserved", "All rights reserved"),
)


class Template(NamedTuple):
    """A license statement, its distinct words, the words wanted and its blocks' stride."""

    name: str
    label: str
    words: tuple[str, ...]
    need: int
    stride: int


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return runs_between(ascii_lower(text), SEPARATORS)


def split_words(text: str) -> list[str]:
    """``words_of`` for the driver's few statements, which are ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def prepared(templates: Sequence[tuple[str, str, str]], threshold: float) -> list[Template]:
    """The templates as word sets; ``need`` is the least whole number that makes the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a share of a template's words above 0")
    out = []
    for name, label, text in templates:
        words = split_words(text)
        if not words:
            raise ValueError(f"template {name} has no words")
        distinct = tuple(dict.fromkeys(words))
        out.append(Template(name, label, distinct, math.ceil(threshold * len(distinct) - 1e-9), 1 << (len(words) - 1).bit_length()))
    if sum(len(t.words) for t in out) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    return out


def corpus_order(docs: DataFrame, vocabulary: set[str]) -> list[str]:
    """The vocabulary by its counts in all documents, rarest first, ties by the word; as many rows reach the driver as it has words."""
    wanted = F.filter(words_of(text_or_empty("text")), lambda w: w.isin(*sorted(vocabulary)))
    counts = {r[0]: r[1] for r in docs.select(F.explode(wanted).alias("word")).groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def places_of(phrase: list[str], anchor: int, hits: Column, words: Column) -> Column:
    """Where the phrase's words stand consecutively, found from the hits on its rarest word."""

    def stands(p: Column) -> Column:
        here = [F.get(words, p + (j - anchor)) == w for j, w in enumerate(phrase)]
        return F.coalesce(functools.reduce(lambda a, b: a & b, here), F.lit(False))

    return F.transform(F.filter(hits, stands), lambda p: p - anchor)


def labelled(places: Column, label: str) -> Column:
    """Places as (label, word)."""
    return F.transform(places, lambda w: F.struct(F.lit(label).alias("label"), w.cast("long").alias("word")))


def blocks_about(hits: Column, words: Column, of_stride: list[Template], rank: dict[str, int]) -> Column:
    """The blocks of one stride about prefix words, each with its template words in the corpus order."""
    stride = of_stride[0].stride
    prefix = {w for t in of_stride for w in sorted(t.words, key=rank.get)[: len(t.words) - t.need + 1]}
    known = sorted({w for t in of_stride for w in t.words}, key=rank.get)
    places = F.array(*[F.lit(w) for w in known])
    numbers = F.array(*[F.lit(rank[w]) for w in known])
    near = F.filter(hits, lambda p: F.get(words, p).isin(*prefix))
    at = lambda p: F.floor(p / stride).cast("int")
    numbered = F.filter(F.array_distinct(F.flatten(F.transform(near, lambda p: F.array(at(p) - 1, at(p))))), lambda k: k >= 0)
    tokens = lambda k: F.filter(F.slice(words, k * stride + 1, 2 * stride), lambda w: w.isin(*known))
    ranked = lambda k: F.sort_array(F.array_distinct(F.transform(tokens(k), lambda w: F.get(numbers, F.array_position(places, w).cast("int") - 1))))
    return F.transform(
        numbered,
        lambda k: F.struct(
            F.lit(stride).alias("stride"), (k * stride).cast("long").alias("first_word"), F.least(F.lit(2 * stride), F.size(words) - k * stride).cast("long").alias("n_words"), ranked(k).alias("tokens")
        ),
    )


def postings(docs: DataFrame, templates: list[Template], rank: dict[str, int]) -> DataFrame:
    """(stride, token, place, ...) of every template's prefix."""
    rows = []
    for t in templates:
        tokens = sorted(rank[w] for w in t.words)
        rows += [(t.stride, token, i + 1, t.name, t.label, t.need, len(tokens), tokens) for i, token in enumerate(tokens[: len(tokens) - t.need + 1])]
    return docs.sparkSession.createDataFrame(rows, "t_stride int, token int, place int, template string, label string, need int, k int, t_tokens array<int>")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, places, matches) of every document.

    ``places``: each place of a phrase (label, word). ``matches``: each block that meets a
    template (template, label, first_word, n_words, containment).
    """
    docs = docs.select("doc_id", "text")
    made = prepared(templates, threshold)
    said = [(split_words(p), label) for p, label in phrases]
    rank = {w: i for i, w in enumerate(corpus_order(docs, {w for t in made for w in t.words} | {w for p, _ in said for w in p}))}
    anchors = [min(range(len(p)), key=lambda j, p=p: rank[p[j]]) for p, _ in said]
    looked_for = {p[a] for (p, _), a in zip(said, anchors, strict=True)}
    looked_for |= {w for t in made for w in sorted(t.words, key=rank.get)[: len(t.words) - t.need + 1]}
    strides = [[t for t in made if t.stride == s] for s in sorted({t.stride for t in made})]
    words, hits = F.col("words"), F.col("hits")
    found = [labelled(places_of(p, a, hits, words), label) for (p, label), a in zip(said, anchors, strict=True)]
    read = docs.select("doc_id", words_of(text_or_empty("text")).alias("words"))
    marked = read.withColumn("hits", F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*looked_for), i))))
    rows = marked.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.flatten(F.array(*found)).alias("places"),
        F.flatten(F.array(*[blocks_about(hits, words, of_stride, rank) for of_stride in strides])).alias("blocks"),
    )
    least = min(t.need for t in made)
    blocks = rows.select("row", "doc_id", "n_words", "places", F.explode_outer("blocks").alias("block"))
    size = F.size("block.tokens")
    heads = blocks.withColumn("size", size).select("*", F.posexplode_outer(F.when(size >= least, F.slice("block.tokens", F.lit(1), size - least + 1))).alias("at", "head"))
    index = F.broadcast(postings(docs, made, rank))
    can = (F.col("block.stride") == F.col("t_stride")) & (F.col("head") == F.col("token")) & (F.col("size") >= F.col("need"))
    can &= F.least(F.col("k") - F.col("place"), F.col("size") - 1 - F.col("at")) + 1 >= F.col("need")
    joined = heads.join(index, can, "left").withColumn("common", F.size(F.array_intersect("block.tokens", "t_tokens")))
    match = F.struct("template", "label", F.col("block.first_word").alias("first_word"), F.col("block.n_words").alias("n_words"), (F.col("common") / F.col("k")).alias("containment"))
    return (
        joined.groupBy("row")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "places")], F.collect_set(F.when(F.col("common") >= F.col("need"), match)).alias("matches"))
        .select("doc_id", "n_words", "places", F.array_sort("matches").alias("matches"))
    )


def summarise(scanned: DataFrame) -> DataFrame:
    """A row a document: base places, labels and the highest containment (1 where a phrase stands, 0 where nothing is found)."""
    labels = lambda c: F.array_sort(F.array_distinct(c))
    places, matches = F.col("places"), F.col("matches")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places["word"]).alias("first_word"),
        F.array_max(places["word"]).alias("last_word"),
        F.array_join(labels(places["label"]), ",").alias("base_labels"),
        F.array_join(labels(F.concat(places["label"], matches["label"])), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce(F.array_max(matches["containment"]), F.lit(0.0))).alias("score"),
    )


def brute_sql(templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.8) -> str:
    """DuckDB SQL that holds every block of every document against every template, for ``summarise(scan(documents))``."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    made = ", ".join(f"('{t.name}', '{t.label}', {listed(t.words)}, {t.need}, {t.stride})" for t in prepared(templates, threshold))
    said = [(split_words(p), label) for p, label in phrases]
    ahead = "".join(f", lead(w, {i}) OVER (PARTITION BY k ORDER BY word) AS w{i}" for i in range(1, max(len(p) for p, _ in said)))
    places = " UNION ALL ".join(
        f"SELECT k, '{label}' AS label, word FROM ahead WHERE w = '{p[0]}'" + "".join(f" AND w{i} = '{w}'" for i, w in enumerate(p) if i) for p, label in said
    )
    return rf"""
        WITH templates(name, label, tokens, need, stride) AS (VALUES {made}),
        d AS (SELECT row_number() OVER () AS k, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SEPARATORS}]+') AS words FROM documents),
        word AS (SELECT k, unnest(words) AS w, unnest(generate_series(0, len(words) - 1)) AS word FROM d),
        ahead AS (SELECT *{ahead} FROM word),
        place AS ({places}),
        base AS (SELECT k, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY k),
        token AS (SELECT name, label, need, stride, len(tokens) AS size, unnest(tokens) AS w FROM templates),
        held AS (SELECT k, name, label, need, size, word.w, unnest([word // stride, word // stride - 1]) AS block FROM word JOIN token ON token.w = word.w),
        meets AS (SELECT k, label, count(DISTINCT w) / size AS share FROM held WHERE block >= 0 GROUP BY k, name, label, need, size, block HAVING count(DISTINCT w) >= need),
        every AS (SELECT k, label FROM place UNION SELECT k, label FROM meets),
        label AS (SELECT k, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY k),
        best AS (SELECT k, max(share) AS share FROM meets GROUP BY k)
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
               CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base.labels, '') AS base_labels, coalesce(label.labels, '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(CAST(share AS DOUBLE), 0.0::DOUBLE) END AS score
        FROM d LEFT JOIN base USING (k) LEFT JOIN label USING (k) LEFT JOIN best USING (k)
    """

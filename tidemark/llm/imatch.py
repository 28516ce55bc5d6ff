"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms (runs of letters and digits, lower case) whose inverse
document frequency over all documents lies in a band: not so common that they say
nothing, not so rare that one edit brings or takes them. A document keeps its distinct
terms in the lexicon, sorted. The lexicon is dealt at random into ``SUBSETS`` subsets,
and again at ``LEVELS`` thinnings of it, each with a quarter of the terms of the one
before; every subset's sorted terms are hashed. All hashes together are the
fingerprint. An edit changes the hashes of the subsets that hold a term it touches
and leaves the others.

The likeness of two fingerprints is the share of equal hashes among the subsets that
are not empty in both, at the first thinning at which the first document leaves some
subsets empty (its subsets then hold a few terms each, so long and short texts
compare alike). Equal fingerprints have likeness 1.

Document frequencies are exact: one pre-aggregated exchange of (term hash, count). Only
the terms in the band are kept, as a bitmap of ``BITS_PER_TERM`` bits a term, sized from
their number. A term of the band is in at least the share ``low`` of all texts, so there
are at most 1 / ``low`` times as many as a text has distinct terms on average, however
large the corpus. The bitmap is one value, a scalar subquery that Spark runs once and hands
to the tasks, so a text meets the lexicon where it lies: no (document, term) pair is joined,
and no plan holds the bitmap. A term outside the band passes for one inside with probability 1 in
``BITS_PER_TERM``, the same in every text. Only built-in expressions run.

A text with no term in the band is fingerprinted by all of its terms; null and empty
texts, and texts without terms, share the fingerprint of no terms. Repeated rows are
fingerprinted alike, very long texts whole. An empty table gives no rows; extra columns
are not carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, global_rank, materialize, text_or_empty

BITS_PER_TERM = 32
SUBSETS, LEVELS = 32, 4
ABSENT = "---"
#: The part of an empty subset, and xxhash64 of an empty array (its seed).
NO_PART, NO_TERMS = -1, 42


def terms(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes."""
    hashed = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit("")))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) of every term of the corpus."""
    return docs.select(F.explode(terms(text_or_empty("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lexicon(docs: DataFrame, low: float, high: float) -> tuple[Column, int]:
    """The bitmap of the terms whose document frequency is in the band, as a scalar subquery, and its bits.

    In the band: in at least two documents, in at least ``low`` and at most ``high`` of all.
    """
    n = docs.count()
    banded = materialize(document_frequencies(docs).where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term"))
    bits = max(12, (banded.count() * BITS_PER_TERM - 1).bit_length())
    place = F.col("term").bitwiseAND((1 << bits) - 1)
    words = banded.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits"))
    # One row for each word of the bitmap, whose size is bounded by the band.
    every = docs.sparkSession.range(1 << bits - 6, numPartitions=1).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    in_order = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(in_order, lambda w: w["bits"]).alias("bitmap")).scalar(), bits


def beside_lexicon(rows: DataFrame, bitmap: tuple[Column, int], times: int = 1) -> tuple[DataFrame, list[tuple[Column, int]]]:
    """``rows`` with the bitmap as ``times`` columns, as a function of lambdas may not hold a subquery itself.

    Use each column once in a ``select``: Spark then puts the subquery in its place and no row carries it.
    """
    names = [f"_lexicon{i}" for i in range(times)]
    return rows.select("*", *[bitmap[0].alias(name) for name in names]), [(F.col(name), bitmap[1]) for name in names]


def banded_terms(text: Column, bitmap: tuple[Column, int]) -> Column:
    """The sorted terms of a text that are in the lexicon; all of them if none is."""
    words, bits = bitmap

    def inside(t: Column) -> Column:
        place = t.bitwiseAND((1 << bits) - 1)
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    def kept(every: Column) -> Column:
        return bind(F.filter(every, inside), lambda some: F.sort_array(F.when(F.size(some) > 0, some).otherwise(every)))

    return bind(terms(text), kept)


def parts(text: Column, bitmap: tuple[Column, int]) -> Column:
    """The hashes of all subsets, level after level, of 12 bits each; ``NO_PART`` where a subset has no term.

    A term's subset is named by its five highest bits, so in the sorted terms each subset is one slice.
    """

    def at_level(every: Column, level: int) -> Column:
        mask = 4**level - 1
        kept = F.filter(every, lambda t: F.shiftright(t, 44).bitwiseAND(mask) == 0) if mask else every

        def hashes(k: Column) -> Column:
            def of_subset(of: Column, r: Column) -> Column:
                first, behind = F.array_position(of, r), F.array_position(F.reverse(of), r)
                return F.when(first == 0, NO_TERMS).otherwise(F.xxhash64(F.slice(k, first.cast("int"), (F.size(k) - behind - first + 2).cast("int"))))

            subsets = F.transform(k, lambda t: F.shiftrightunsigned(t, 59))
            return bind(subsets, lambda of: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), lambda r: of_subset(of, r)))

        return bind(kept, hashes)

    whole = bind(banded_terms(text, bitmap), lambda every: F.concat(*[at_level(every, level) for level in range(LEVELS)]))
    return F.transform(whole, lambda h: F.when(h == NO_TERMS, NO_PART).otherwise(h.bitwiseAND(0xFFF)).cast("short"))


def fingerprint(hashes: Column) -> Column:
    """The parts as text, three hexadecimal digits each."""
    return F.array_join(F.transform(hashes, lambda h: F.when(h == NO_PART, ABSENT).otherwise(F.lpad(F.lower(F.hex(h)), 3, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes, 0 to 1."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.slice(a, i * SUBSETS + 1, F.lit(SUBSETS)))
    fits = F.transform(levels, lambda p: F.size(F.filter(p, lambda x: x == NO_PART)) >= SUBSETS // 4)
    level = F.coalesce(F.nullif(F.array_position(fits, True), F.lit(0)), F.lit(LEVELS)) - 1
    x, y = (F.slice(c, (level * SUBSETS + 1).cast("int"), F.lit(SUBSETS)) for c in (a, b))
    seen = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != NO_PART) | (q != NO_PART)), lambda s: s))
    equal = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != NO_PART) & (p == q)), lambda s: s))
    return F.when(a == b, 1.0).otherwise(F.when(seen > 0, equal / seen).otherwise(0.0))


def fingerprint_documents(docs: DataFrame, low: float = 0.0002, high: float = 0.03) -> DataFrame:
    """doc_id, n_chars and fingerprint (with its ``parts``) of every text."""
    bitmap = lexicon(docs, low, high)
    texts, (held,) = beside_lexicon(docs.select("doc_id", text_or_empty("text").alias("text")), bitmap)
    hashed = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"), parts(F.col("text"), held).alias("parts"))
    return hashed.withColumn("fingerprint", fingerprint(F.col("parts")))


def edited_fingerprints(docs: DataFrame, low: float = 0.0002, high: float = 0.03) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last quarter (rounded down, in characters) gives way to the beginning
    of the next document's text in ascending doc_id, the first's after the last. Texts
    move once, by doc_id (both joins share that exchange). The parts of each text are
    made once and move, without the text, to the document itself and, with the text's
    beginning, to the document before it. Rows that share a doc_id have the same next
    document, the least beginning if that id repeats; rows without an id have none: their
    edited text is their own, ``near_next`` 0.
    """
    bitmap = lexicon(docs, low, high)
    # The same plan on both sides of the two joins, filter included, so that Spark reuses its exchange.
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_or_empty("text").alias("text"))
    sizes = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    ranked = global_rank(sizes, "doc_id")
    n = ranked.count()
    after = ranked.select(F.col("doc_id").alias("cur"), F.floor(F.col("n") / 4).cast("int").alias("need"), F.pmod(F.col("rank") + 1, F.lit(max(n, 1))).alias("rank"))
    wanted = after.join(ranked.select("rank", "doc_id"), "rank").select("doc_id", "cur", "need")

    followed, (held,) = beside_lexicon(texts.join(wanted, "doc_id"), bitmap)
    made = followed.select("doc_id", "cur", F.left("text", F.col("need")).alias("head"), F.xxhash64("text").alias("hash"), parts(F.col("text"), held).alias("parts"))
    no_next = F.lit(None).cast("struct<head:string,parts:array<smallint>>")
    no_own = F.lit(None).cast("struct<hash:bigint,parts:array<smallint>>")
    to_both = F.array(
        F.struct(F.col("cur").alias("to"), F.struct("head", "parts").alias("next"), no_own.alias("own")),
        F.struct(F.col("doc_id").alias("to"), no_next.alias("next"), F.struct("hash", "parts").alias("own")),
    )
    given = made.select(F.explode(to_both).alias("r")).groupBy(F.col("r.to").alias("doc_id")).agg(F.min("r.next").alias("next"), F.max("r.own").alias("own"))

    size = F.length("text")
    need = F.floor(size / 4).cast("int")
    edited = F.concat(F.left("text", size - need), F.left("next.head", need))
    def of_edit(text: Column, lexicon: tuple[Column, int]) -> Column:
        return bind(text, lambda e: F.struct(F.sha2(F.encode(e, "UTF-8"), 256).alias("sha256"), parts(e, lexicon).alias("parts")))

    # Only rows that share an id with another text have no parts of their own yet.
    owned, (held, held_edit) = beside_lexicon(texts.join(given, "doc_id"), bitmap, 2)
    own = F.when(F.col("own.hash") == F.xxhash64("text"), F.col("own.parts")).otherwise(parts(F.col("text"), held))
    with_next = owned.select("doc_id", size.cast("long").alias("n_chars"), of_edit(edited, held_edit).alias("edit"), own.alias("a"), F.col("next.parts").alias("c"))
    without_id, (held, held_edit) = beside_lexicon(docs.where("doc_id IS NULL").select("doc_id", text_or_empty("text").alias("text")), bitmap, 2)
    alone = without_id.select("doc_id", size.cast("long").alias("n_chars"), of_edit(F.col("text"), held_edit).alias("edit"), parts(F.col("text"), held).alias("a"), F.lit(None).cast("array<smallint>").alias("c"))
    both = with_next.union(alone).select("doc_id", "n_chars", F.col("edit.sha256").alias("edited_sha256"), "a", F.col("edit.parts").alias("b"), "c")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        F.coalesce(likeness(F.col("a"), F.col("c")), F.lit(0.0)).alias("near_next"),
    )

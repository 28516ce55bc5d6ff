"""Near-duplicate documents: DartMinHash signatures, banded joining, components.

1. Texts are exchanged once, into buckets by id. Every text is one row of a signature
   table: a digest, ``bands`` band keys and a 16-bit sketch of its ``bands * rows``
   coordinates.
2. Exact copies are grouped by digest; each group is stood for by its least id.
3. A bucket is a band key that several distinct texts share. Each member is paired
   with two members that stand for the bucket: the one least by a hash that all
   buckets share and the one least by a hash of the bucket's own. Most buckets are
   one component after these at most 2 n pairs of n members.
4. The sketches decide the clear pairs: at ``sure`` or more equal coordinates they
   link, below ``doubt`` they don't. Pairs between are verified on the shingles of the
   whole texts (64-bit hashes with their counts), first each document's best pair, then every pair that still
   joins different components; a pair inside a component needs no proof.
5. In buckets whose members are still in different components every pair across
   components is compared, on longer sketches of other darts: the members are dealt to
   blocks of about ``BLOCK`` by hash and two blocks meet at a time, so no task holds a
   bucket and rows of blocks, not of pairs, meet. Pairs that the longer sketches leave
   open are verified there, on the shingles that the blocks carry; only links that join
   components become rows.
6. Components of the links are the classes; a class is named by its least doc_id.

Similarity is the weighted Jaccard similarity of five-word shingles (lower case, split at
white space), weighted by how often a text has them; 0.8 or more links. Texts of fewer than five words have one
shingle. Null and empty texts are copies of one another; texts without words
otherwise match only equal texts. Rows that share a ``doc_id`` are one document. Rows
without ``doc_id`` belong to no class: ``class_id`` null, kept. Extra columns are not
carried; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import dart_minhash as dart
from tidemark.llm.common import bucketed, by_bucket, forget, materialize, only_result, text_or_empty
from tidemark.llm.components import components, merged

#: Members of a bucket that are compared with as many others at once.
BLOCK = 256
#: Coordinates of the sketches that such members are compared by.
LONG = 1024


def signature_table(texts_by_id: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, keys, sketch) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, z in dart.groups(texts):
                hashes, owner, counts = dart.shingles(texts[a:z], shingle)
                ident, any_word = dart.signatures(hashes, owner, counts.astype(float), z - a, bands * rows)
                keys = dart.bands_of(ident, bands, rows).view(np.int64)
                n_keys = np.where(any_word, bands, 0)
                sketch = (ident >> np.uint64(48)).astype(np.uint16).view(np.int16)
                n_sketch = np.where(any_word, bands * rows, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, z - a),
                        digests.slice(a, z - a),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_keys)], pa.int32()), pa.array(keys[any_word].ravel())),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_sketch)], pa.int32()), pa.array(sketch[any_word].ravel())),
                    ],
                    ["doc_id", "digest", "keys", "sketch"],
                )

    text = text_or_empty("text")
    slim = texts_by_id.select("doc_id", F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"), text.alias("text"))
    return materialize(slim.mapInArrow(sign, "doc_id long, digest binary, keys array<long>, sketch array<short>"))


def by_id(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have an id, in buckets by it."""
    named = docs.where("doc_id IS NOT NULL")
    return bucketed(named, "doc_id", named.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])


@only_result
def members_of(texts: DataFrame, shingle: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy_of) of every id, and (doc_id, keys, sketch) of every distinct text."""
    signed = signature_table(texts, shingle, bands, rows)
    # Written, so that both sides of the join are plain exchanges and Spark can split the rows of one digest.
    firsts = materialize(signed.groupBy("digest").agg(F.min("doc_id").alias("copy_of")))
    members = materialize(signed.select("doc_id", "digest").join(firsts, "digest").select("doc_id", "copy_of").distinct())
    distinct = signed.join(members.where("doc_id = copy_of").select("doc_id"), "doc_id", "left_semi")
    return members, materialize(distinct.select("doc_id", "keys", "sketch"))


@only_result
def judged_pairs(distinct: DataFrame, doubt: float) -> DataFrame:
    """(a, b, agree) of the distinct pairs, a < b, of distinct texts that stand in one bucket and agree on ``doubt`` of their sketches."""
    members = distinct.select("doc_id", F.explode("keys").alias("key"))
    shared, own = F.xxhash64("doc_id"), F.xxhash64("doc_id", "key")
    buckets = members.groupBy("key").agg(F.min(F.struct(shared.alias("o"), "doc_id")).alias("one"), F.min(F.struct(own.alias("o"), "doc_id")).alias("two"), F.max("doc_id").alias("most"), F.min("doc_id").alias("least"))
    # Written for the same reason: one key may be in a third of all texts.
    buckets = materialize(buckets.where("least < most").select("key", F.array_distinct(F.array("one.doc_id", "two.doc_id")).alias("by")))
    pairs = members.join(buckets, "key").select("doc_id", F.explode("by").alias("with")).where("doc_id <> with")
    pairs = pairs.select(F.least("doc_id", "with").alias("a"), F.greatest("doc_id", "with").alias("b")).distinct()
    x = distinct.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"))
    y = distinct.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"))
    return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", agreement(F.col("x"), F.col("y")).alias("agree")).where(F.col("agree") >= doubt))


def agreement(a, b):
    """Share of equal coordinates of two sketches."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return equal / F.greatest(F.size(a), F.lit(1))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose shingles, each as often as it occurs, are similar enough; ``texts`` is bucketed by id."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            for a, z in dart.groups(held):
                hashes, owner = dart.occurrences(*dart.shingles(held[a:z], shingle))
                n = np.bincount(owner, minlength=z - a) if len(owner) else np.zeros(z - a, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(hashes.view(np.int64)))], ["doc_id", "grams"])

    grams = materialize(by_bucket(texts, ids, "doc_id", "left_semi").select("doc_id", text_or_empty("text").alias("text")).mapInArrow(sets, "doc_id long, grams array<long>"))
    both = pairs.select("a", "b").join(grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b").distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*pairs.columns)


def long_sketches(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, long, grams) of the texts with these ids: ``LONG`` coordinates of other darts, a byte each, and all shingles, sorted."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            for a, z in dart.groups(held):
                hashes, owner, counts = dart.shingles(held[a:z], shingle)
                ident, _ = dart.signatures(dart.mix(hashes ^ dart.GOLD), owner, counts.astype(float), z - a, LONG)
                coded = (ident >> np.uint64(56)).astype(np.uint8)
                grams, of = dart.occurrences(hashes, owner, counts)
                grams = grams[np.lexsort((grams, of))].view(np.int64)
                n = np.bincount(of, minlength=z - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array([row.tobytes() for row in coded], pa.binary()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(grams))],
                    ["doc_id", "long", "grams"],
                )

    return by_bucket(texts, ids, "doc_id", "left_semi").select("doc_id", text_or_empty("text").alias("text")).mapInArrow(sign, "doc_id long, long binary, grams array<long>")


@only_result
def links_across(distinct: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of links between components that share a bucket: enough of them to join all that a pair of one bucket joins.

    What becomes a row is at most a link for each member of two blocks that meet, however many pairs they are.
    """
    known = labels.select(F.col("node").alias("doc_id"), "label")
    labelled = distinct.join(known, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"), "keys")
    members = labelled.select("doc_id", "label", F.explode("keys").alias("key"))
    # Two members are a pair that was judged.
    mixed = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    mixed = materialize(mixed.where("n > 2 AND least < most").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    if mixed.isEmpty():
        return materialize(mixed.select(F.col("key").alias("a"), F.col("key").alias("b")))
    placed = materialize(members.join(mixed, "key").select("doc_id", "label", "key", F.pmod(F.xxhash64("doc_id", F.lit(3)), "blocks").cast("int").alias("block")))
    sketches = materialize(long_sketches(texts, placed.select("doc_id").distinct(), shingle))
    dealt = materialize(placed.join(sketches, "doc_id").groupBy("key", "block").agg(F.collect_list(F.struct("doc_id", "label", "long", "grams")).alias("held")))
    forget(placed, sketches)
    other = dealt.select("key", F.col("block").alias("block_b"), F.col("held").alias("held_b"))
    met = dealt.join(other, "key").where("block <= block_b").select("held", "held_b")
    # A pair 3 standard deviations below ``similarity`` is not looked at. (A byte also agrees by chance, once in 256.)
    doubt = similarity - 3.0 * (similarity * (1 - similarity) / LONG) ** 0.5

    def arrays(held: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        ids, label, sketch, grams = (held.values.field(c) for c in ("doc_id", "label", "long", "grams"))
        values, offsets = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
        return ids.to_numpy(), label.to_numpy(), np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint8).reshape(len(ids), LONG), [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common >= similarity * (len(x) + len(y) - common) - 1e-9

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                ids_x, label_x, x, grams_x = arrays(batch.column(0)[i])
                ids_y, label_y, y, grams_y = arrays(batch.column(1)[i])
                wanted = label_x[:, None] != label_y[None, :]
                rows, cols = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
                if not len(rows):
                    continue
                equal = np.zeros((len(rows), len(cols)), dtype=np.int16)
                for u, v in zip(x[rows].T, y[cols].T, strict=True):
                    equal += u[:, None] == v[None, :]
                agree = (equal / LONG - 1 / 256) / (1 - 1 / 256)
                a, b = np.nonzero(wanted[np.ix_(rows, cols)] & (agree >= doubt))
                parent: dict[int, int] = {}

                def root(n: int, parent: dict[int, int] = parent) -> int:
                    while (up := parent.get(n, n)) != n:
                        n = up
                    return n

                # The likeliest first; a pair whose components are joined by then needs no proof.
                for k in np.argsort(-agree[a, b], kind="stable"):
                    one, two = root(int(label_x[rows[a[k]]])), root(int(label_y[cols[b[k]]]))
                    if one != two and similar(grams_x[rows[a[k]]], grams_y[cols[b[k]]]):
                        parent[max(one, two)] = min(one, two)
                        links.append((int(ids_x[rows[a[k]]]), int(ids_y[cols[b[k]]])))
            ends = np.array(links, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    return materialize(met.mapInArrow(compare, "a long, b long").distinct())


@only_result
def proved(labels: DataFrame, pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``labels`` after those of the pairs that are similar enough."""
    return merged(labels, verified(pairs, texts, shingle, similarity))


@only_result
def joined(judged: DataFrame, texts: DataFrame, shingle: int, similarity: float, sure: float) -> DataFrame:
    """(node, label, ...) after the judged pairs that join components are decided."""
    labels = components(judged.where(F.col("agree") >= sure))
    open_pairs = materialize(apart(judged.where(F.col("agree") < sure), labels))
    if open_pairs.isEmpty():
        return labels
    ends = open_pairs.select(F.col("a").alias("node"), "agree", "a", "b").union(open_pairs.select(F.col("b").alias("node"), "agree", "a", "b"))
    best = ends.groupBy("node").agg(F.max(F.struct("agree", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("p")).select((-F.col("p.na")).alias("a"), (-F.col("p.nb")).alias("b")).distinct()
    best = materialize(best)
    labels = proved(labels, best, texts, shingle, similarity)
    rest = materialize(apart(open_pairs, labels).select("a", "b").join(best, ["a", "b"], "left_anti"))
    return labels if rest.isEmpty() else proved(labels, rest, texts, shingle, similarity)


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, copy_of, class_id, is_kept) of every row: the exact copy it stands for, its class, whether it is the one that stays."""
    classed = classes(by_id(docs.select("doc_id", "text")), **parameters)
    unnamed = docs.where("doc_id IS NULL").select(*[F.lit(None).cast("long").alias(c) for c in classed.columns])
    return classed.union(unnamed).withColumn("is_kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def classes(texts: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 25, rows: int = 5, sure: float = 0.93, doubt: float = 0.65) -> DataFrame:
    """(doc_id, copy_of, class_id) of every id of a table in buckets by id."""
    members, distinct = members_of(texts, shingle, bands, rows)
    judged = judged_pairs(distinct, doubt)
    labels = joined(judged, texts, shingle, similarity, sure)
    forget(judged)
    across = links_across(distinct, labels, texts, shingle, similarity)
    forget(distinct)
    if not across.isEmpty():
        labels = merged(labels, across)
    return members.join(labels.select(F.col("node").alias("copy_of"), "label"), "copy_of", "left").select("doc_id", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each class, with its own columns, and all rows without id. Rows are exchanged once, into buckets by id."""
    held = by_id(docs)
    gone = classes(held.select("doc_id", "text"), **parameters).where("doc_id <> class_id").select("doc_id").distinct()
    left = by_bucket(held, materialize(gone), "doc_id", "left_anti")
    twice = materialize(held.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not twice.isEmpty():
        left = by_bucket(left, twice, "doc_id", "left_anti").unionByName(by_bucket(left, twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))

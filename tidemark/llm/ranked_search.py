"""Exact ranked lexical search over dual-sorted wavelet trees, one a shard of documents.

**Index.** A shard is a run of consecutive documents of a partition, cut at
``SHARD_BYTES`` of text, so documents are indexed where they lie: no text is exchanged,
and no shard outgrows its bound but for its last document. Its documents are numbered by
ascending doc_id. The posting lists of all terms stand one after the other, each ordered
by impact, the highest first; the sequence of their document numbers is kept as a wavelet
tree: one bit vector a level, most significant bit first, each level stably dealt into
zeros and ones. A stable deal keeps the order, so within any node (a range of document
numbers) a term's postings are still ordered by impact, and still one range: the tree is
navigated by doc_id, the lists by impact. Bit vectors, root impacts, terms and list
starts are the index row; counts of ones and the impacts of the lower levels are derived
from them when a shard is read.

**Search.** A node's bound for an item is the sum, over the terms with postings in it, of
the term's weight times the impact of the first posting: no document below can score
more. Nodes are expanded best bound first, the ranges of all terms at once; a leaf is a
document and its bound the exact score. A node is left out when its bound can't beat the
k-th best so far (of all shards that the task has read), ties going to the smaller
doc_id. So the k best are exact, ties included. The ``WIDTH`` best nodes of each item are
expanded in one array step.

**Weights.** Corpus counts come from whole-table aggregates; the impact of a posting,
(10^9 tf) div (1000 tf + 20 m), has no term weight in it, so an index serves any items.
Items are searched in blocks of ``BLOCK_BYTES`` of text (or one item, if larger), each a
pass over the index: the driver holds one block's terms, document frequencies and weights
at a time. A task keeps k documents an item; these are cut to k again by (item, salt) and
then by item, so no task sees more than k rows a salt or a task.

Null and empty texts have no terms: such documents are never found, such items find
nothing. Every row of either table counts as a document or item of its own, repeated rows
and ids too. A null doc_id comes before all numbers where scores tie (in the index it is
the smallest long). Very long texts are indexed whole, in a shard that they fill. Empty
tables give no rows; columns other than the ids and texts are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, materialize, runs_between, text_or_empty

#: Terms are runs of digits, letters and all characters beyond ASCII; in UTF-8 bytes after lower-casing, the same runs.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BYTE_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
#: Nodes of an item expanded in one step, and items searched together.
WIDTH, TOGETHER = 48, 32
SALTS = 64
NO_ID = -(1 << 63)

INDEX = pa.schema(
    [
        ("terms", pa.list_(pa.binary())),
        ("starts", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("bits", pa.list_(pa.binary())),
        ("impacts", pa.binary()),
    ]
)
INDEX_DDL = "terms array<binary>, starts array<int>, doc_ids array<long>, bits array<binary>, impacts binary"


class Index(NamedTuple):
    """The written shards, the number of documents with terms and the number of their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


# --- one shard -----------------------------------------------------------------------


def postings(texts: list[bytes], n_docs: int, n_terms: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, list starts, document numbers, impacts) of texts in order, each list by impact."""
    number: dict[bytes, int] = {}
    tokens, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        found = BYTE_TERM.findall(text.lower())
        lengths[i] = len(found)
        tokens.append(np.fromiter((number.setdefault(t, len(number)) for t in found), dtype=np.int64, count=len(found)))
    terms = sorted(number)
    place = np.empty(len(terms), dtype=np.int64)
    place[[number[t] for t in terms]] = np.arange(len(terms))
    flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
    docs = np.repeat(np.arange(len(texts)), lengths)
    pairs, tf = np.unique(place[flat] * max(1, len(texts)) + docs, return_counts=True)
    term, doc = np.divmod(pairs, max(1, len(texts)))
    # Whole numbers of any size: 50 n N leaves 64 bits only where n N is beyond 10^17.
    m = np.array([50 + (50 * int(n) * n_docs) // max(1, n_terms) for n in lengths], dtype=np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
    order = np.lexsort((doc, -impact, term))
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    return terms, starts.astype(np.int32), doc[order], impact[order].astype(np.int32)


def deal(docs: np.ndarray, n: int) -> list[np.ndarray]:
    """The wavelet tree's bits, a boolean array a level."""
    levels, seq, out = max(1, (n - 1).bit_length()), docs, []
    for level in range(levels):
        bit = ((seq >> (levels - 1 - level)) & 1).astype(bool)
        out.append(bit)
        seq = np.concatenate([seq[~bit], seq[bit]])
    return out


def shard_row(ids: list[int | None], texts: list[bytes], n_docs: int, n_terms: int) -> dict:
    """The index row of some documents."""
    keys = [NO_ID if i is None else i for i in ids]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    terms, starts, docs, impacts = postings([texts[i] for i in order], n_docs, n_terms)
    bits = [np.packbits(b, bitorder="little").tobytes() for b in deal(docs, len(keys))]
    return {"terms": terms, "starts": starts, "doc_ids": [keys[i] for i in order], "bits": bits, "impacts": impacts.tobytes()}


class Shard:
    """An index row made navigable: counts of ones before each word of bits, and the impacts of each level."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = np.array(row["doc_ids"], dtype=np.int64)
        impacts = np.frombuffer(row["impacts"], dtype=np.int32)
        n, self.levels = len(impacts), len(row["bits"])
        n_words = n // 64 + 1
        self.words = np.zeros((self.levels, n_words), dtype=np.uint64)
        self.ones = np.zeros((self.levels, n_words), dtype=np.int64)
        self.zeros = np.zeros(self.levels, dtype=np.int64)
        self.impacts = np.empty((self.levels + 1, n), dtype=np.int32)
        self.impacts[0] = impacts
        for level, packed in enumerate(row["bits"]):
            self.words[level] = np.frombuffer(packed.ljust(8 * n_words, b"\0"), dtype="<u8")
            counts = np.bitwise_count(self.words[level]).astype(np.int64)
            self.ones[level, 1:] = np.cumsum(counts)[:-1]
            bit = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n, bitorder="little").astype(bool)
            self.zeros[level] = n - counts.sum()
            self.impacts[level + 1] = np.concatenate([self.impacts[level][~bit], self.impacts[level][bit]])

    def zeros_before(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many bits before ``at`` are zero."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return at - self.ones[level, word] - np.bitwise_count(self.words[level, word] & below)


class Items(NamedTuple):
    """A block of items: keys, and (item, term, weight) of their terms with a weight, sorted by item."""

    keys: np.ndarray
    terms: pa.Array
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray


class Best:
    """The k best documents of each item so far, and what a newcomer must beat."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least, self.last = np.zeros(n_items, dtype=np.int64), np.full(n_items, np.iinfo(np.int64).max)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        at = np.arange(len(item)) - np.searchsorted(item, item)
        kept = at < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        full = at == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]

    def open(self, item: np.ndarray, bound: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
        """Whether a node could still hold a document that belongs here."""
        least = self.least[item]
        return (bound > least) | ((bound == least) & (bound > 0) & (first_doc < self.last[item]))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def search_shard(shard: Shard, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, item: np.ndarray, best: Best) -> None:
    """Best-first search for some items; (lo, hi, weight, item): a range of the root for each of their terms, by item."""
    items, size = np.unique(item, return_counts=True)
    bound = np.bincount(np.repeat(np.arange(len(items)), size), weight * shard.impacts[0, lo]).astype(np.int64)
    # The frontier: nodes as (item, level, prefix of document numbers, bound, ranges), their ranges one after the other.
    level, prefix = np.zeros(len(items), dtype=np.int64), np.zeros(len(items), dtype=np.int64)
    item = items
    while len(item):
        first = shard.doc_ids[np.minimum(prefix << (shard.levels - level), len(shard.doc_ids) - 1)]
        order = np.lexsort((-bound, item))
        order = order[best.open(item[order], bound[order], first[order])]
        by_item = item[order]
        ahead = np.arange(len(order)) - np.searchsorted(by_item, by_item) < WIDTH
        now, later = order[ahead], order[~ahead]
        begin = np.cumsum(size) - size
        at = spread(begin[now], size[now])
        node = np.repeat(np.arange(len(now)), size[now])
        r_level, r_lo, r_hi, r_weight = level[now][node], lo[at], hi[at], weight[at]
        left_lo, left_hi = shard.zeros_before(r_level, r_lo), shard.zeros_before(r_level, r_hi)
        zeros = shard.zeros[r_level]
        c_lo = np.concatenate([left_lo, zeros + r_lo - left_lo])
        c_hi = np.concatenate([left_hi, zeros + r_hi - left_hi])
        child = np.concatenate([2 * node, 2 * node + 1])
        held = np.flatnonzero(c_lo < c_hi)
        held = held[np.argsort(child[held], kind="stable")]
        c_lo, c_hi, child = c_lo[held], c_hi[held], child[held]
        c_weight = np.concatenate([r_weight, r_weight])[held]
        value = c_weight * shard.impacts[level[now][child >> 1] + 1, c_lo]
        # Sums of whole numbers below 2^53, so exact in doubles.
        c_bound = np.bincount(child, value, minlength=2 * len(now)).astype(np.int64)
        c_size = np.bincount(child, minlength=2 * len(now))
        c_item, c_level = np.repeat(item[now], 2), np.repeat(level[now] + 1, 2)
        c_prefix = np.repeat(prefix[now] * 2, 2) + np.tile([0, 1], len(now))
        leaf = (c_level == shard.levels) & (c_bound > 0)
        if leaf.any():
            best.add(c_item[leaf], c_bound[leaf], shard.doc_ids[c_prefix[leaf]])
        inner = np.flatnonzero((c_level < shard.levels) & (c_bound > 0))
        back, more = spread(begin[later], size[later]), spread((np.cumsum(c_size) - c_size)[inner], c_size[inner])
        lo, hi, weight = (np.concatenate(x) for x in ((lo[back], c_lo[more]), (hi[back], c_hi[more]), (weight[back], c_weight[more])))
        item, level, prefix, bound, size = (
            np.concatenate([old[later], new[inner]]) for old, new in ((item, c_item), (level, c_level), (prefix, c_prefix), (bound, c_bound), (size, c_size))
        )


def search_row(row: dict, terms: pa.Array, items: Items, best: Best) -> None:
    """All items against one index row, ``TOGETHER`` at a time."""
    place = pc.index_in(items.terms, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    place = place[items.term]
    present = place >= 0
    if not present.any():
        return
    item, weight, place = items.item[present], items.weight[present], place[present].astype(np.int64)
    starts = np.array(row["starts"], dtype=np.int64)
    shard = Shard(row)
    for first in range(0, len(items.keys), TOGETHER):
        a, b = np.searchsorted(item, [first, first + TOGETHER])
        if a < b:
            search_shard(shard, starts[place[a:b]], starts[place[a:b] + 1], weight[a:b], item[a:b], best)


# --- Spark jobs ----------------------------------------------------------------------


def index_documents(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every row of ``docs`` (doc_id, text), shard by shard, as a table in the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    n_docs, n_terms = docs.select(F.size(runs_between(F.col("text"), SEPARATORS)).alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = text.as_buffer().to_pybytes()
                ids.append(i.as_py())
                texts.append(data)
                size += len(data)
                if size >= shard_bytes:
                    yield pa.RecordBatch.from_pylist([shard_row(ids, texts, n_docs, n_terms)], INDEX)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([shard_row(ids, texts, n_docs, n_terms)], INDEX)

    return Index(materialize(docs.mapInArrow(build, INDEX_DDL)), n_docs, n_terms)


def term_weight(n_docs: int, df: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def document_frequencies(index: Index, terms: list[bytes]) -> dict[int, int]:
    """Documents of each of a block's terms, by its place; reads only the terms and starts of the shards."""
    held = index.shards.sparkSession.sparkContext.broadcast(pa.array(terms, pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for own, starts in zip(batch["terms"], batch["starts"], strict=True):
                place = pc.index_in(held.value, value_set=own.values).fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = np.append(np.diff(starts.values.to_numpy(zero_copy_only=False)), 0)
                total += sizes[place]
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    rows = index.shards.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r["term"]: r["df"] for r in rows}


def search_block(index: Index, rows: list, k: int) -> DataFrame:
    """(key, doc_id, score) of the k best documents of each item of one block."""
    terms = sorted({t.encode() for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    df = document_frequencies(index, terms)
    weights = {i: term_weight(index.n_docs, n) for i, n in df.items()}
    uses = [(i, t, weights[t]) for i, r in enumerate(rows) for t in (number[x.encode()] for x in r["terms"]) if weights.get(t)]
    item, term, weight = np.array(uses, dtype=np.int64).reshape(-1, 3).T
    items = index.shards.sparkSession.sparkContext.broadcast(Items(np.array([r["key"] for r in rows], dtype=np.int64), pa.array(terms, pa.binary()), item, term, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.value.keys), k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {"starts": batch["starts"][i].values.to_numpy(), "doc_ids": batch["doc_ids"][i].values.to_numpy(), "bits": batch["bits"][i].as_py(), "impacts": batch["impacts"][i].as_py()}
                search_row(row, batch["terms"][i].values, items.value, best)
        doc = pa.array(best.doc, pa.int64(), mask=best.doc == NO_ID)
        yield pa.record_batch([pa.array(items.value.keys[best.item], pa.int64()), doc, pa.array(best.score, pa.int64())], ["key", "doc_id", "score"])

    found = index.shards.mapInArrow(search, "key long, doc_id long, score long")
    for keys in (["key", "salt"], ["key"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("key", "rank", "doc_id", "score")


def search(index: Index, benchmark: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of ``benchmark`` (item_id, text)."""
    text = ascii_lower(text_or_empty("text"))
    items = materialize(
        benchmark.select("item_id", F.monotonically_increasing_id().alias("key"), F.octet_length(text).alias("size"), F.array_distinct(runs_between(text, SEPARATORS)).alias("terms"))
    )
    n_blocks = max(1, -(-(items.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    out = None
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == block).select("key", "terms").collect()
        part = search_block(index, rows, k)
        part = materialize(part) if n_blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out.join(items.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")

"""Exact removal of long repeated byte strings, wherever they start.

A window is the ``WINDOW`` bytes that start at a position of a document. It is a
repeat if the same bytes also start earlier: in a document of smaller id, or before
it in the same one. Every byte that a repeat covers is removed. Whether windows are
repeats is judged on the input alone; windows never cross documents.

Comparing every window of a corpus would shuffle a row a byte. Four exact steps
leave few of them, each a pre-aggregated group by content and a join back to the
contents that occur more than once:

1. Units. Texts are cut where a hash of eight bytes says so, about every ``UNIT``
   bytes. A unit's string is its bytes and the WINDOW - 1 that follow, that is, all
   windows that start in it. If that string has occurred before, all of them are
   repeats. The earliest occurrence of any window lies in a unit whose string is new,
   so only windows that start in such units are looked at again.
2. Anchors. The least hash of the ``GRAM``-byte strings inside a window is a function
   of the window's content. A window whose anchor occurs at one position only is no
   repeat. Each anchor is one row, however many windows share it.
3. Blocks. Windows with a repeated anchor are put together, ``BLOCK`` neighbouring
   starts at a fixed distance from their anchor. If a block's whole string has
   occurred before, all its windows are repeats. The bytes that all windows of a block
   share are its core: if no block with another string has this core, no other window
   of the block is a repeat.
4. Windows. The windows left (at the ends of repeated passages) are grouped by a hash
   of all their bytes; all but the earliest of each group are repeats.

Texts are exchanged once, into buckets by id; what a step finds out about them is a slim
table that goes to these buckets, so every step has one plan for any size.

"The same string" means equal 96 bits: a 64-bit polynomial hash of all their bytes and a
32-bit mix of bytes from three places and the length. Bytes are not compared again: two
different strings of a corpus of 10^13 windows agree in all of them with a probability of
about 10^-3.

Nulls are empty. Texts shorter than WINDOW keep all bytes. Rows that repeat both id and
text are one document, each with its result; texts that share an id are different
documents, ordered by a hash; rows without an id come before all others. Extra columns are not carried; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, by_bucket, discard, global_rank, materialize, text_or_empty
from tidemark.llm.dart_minhash import BASE, GOLD, GROUP, INVERSE, MIX_A, MIX_B, mix, powers

U = np.uint64
WINDOW, UNIT, GRAM, BLOCK = 100, 128, 24, 16
#: Bytes that all windows of a block share.
CORE = WINDOW - BLOCK + 1
#: k-gram positions in a window.
SPAN = WINDOW - GRAM + 1
NO_ID = -(1 << 63)


class Block:
    """Several documents as one array of bytes, with what all steps need of it."""

    def __init__(self, texts: list[bytes]):
        self.hold(np.frombuffer(b"".join(texts) + bytes(WINDOW + 8), dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64))

    def hold(self, data: np.ndarray, sizes: np.ndarray) -> None:
        self.data, self.sizes, self.n = data, sizes, int(sizes.sum())
        self.starts = np.cumsum(sizes) - sizes
        self.eight = np.ndarray((self.n + WINDOW,), dtype="<u8", buffer=data, strides=(1,))
        #: Whether a whole window of the same document starts here.
        long = sizes >= WINDOW
        edges = np.zeros(self.n + 1, dtype=np.int8)
        edges[self.starts[long]] = 1
        edges[self.starts[long] + sizes[long] - WINDOW + 1] -= 1
        self.whole = np.cumsum(edges[: self.n], dtype=np.int8).astype(bool)
        self._sums = None

    def cut(self, start: np.ndarray, end: np.ndarray) -> tuple[Block, np.ndarray]:
        """The windows that start in [start, end) as documents of their own, and where each byte of these is in this block."""
        sizes = end - start + WINDOW - 1
        at = np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        pieces = Block.__new__(Block)
        pieces.hold(np.append(self.data[at], np.zeros(WINDOW + 8, dtype=np.uint8)), sizes)
        return pieces, at

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 64 and 32 bits of the strings [start, end), each of WINDOW bytes or more."""
        if self._sums is None:
            self._sums = np.zeros(self.n + 1, dtype=U)
            np.cumsum((self.data[: self.n].astype(U) + U(1)) * powers(BASE, self.n), out=self._sums[1:])
        first = mix((self._sums[end] - self._sums[start]) * powers(INVERSE, self.n + 1)[start] + (end - start).astype(U) * GOLD)
        second = mix(self.eight[start] * MIX_A + self.eight[end - 8] * MIX_B + self.eight[start + (end - start) // 2] * GOLD + (end - start).astype(U))
        return first.view(np.int64), (second >> U(32)).astype(np.uint32).view(np.int32)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts + self.sizes, position, "right")

    def cover(self, of: list, into: np.ndarray, value: bool) -> None:
        """Set the positions in each document's intervals (start, end, start, end ...)."""
        for s, intervals in zip(self.starts, of, strict=True):
            if intervals is not None:
                for a, z in zip(intervals[::2], intervals[1::2], strict=True):
                    into[s + a : s + z] = value

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the runs of window starts that are hashed as one."""
        cut = (self.eight[: self.n] * MIX_A) >> U(64 - 7) == 0
        last = self.starts[self.sizes > 0]
        cut[last] = True
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], self.n]
        doc = self.document(start)
        end = np.minimum(end, self.starts[doc] + self.sizes[doc] - WINDOW + 1)
        return start[start < end], end[start < end]

    def anchors(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k-gram hashes, least of each window, positions that are least for a wanted window)."""
        grams = self.eight[: self.n] * MIX_A
        grams ^= self.eight[8 : self.n + 8] * MIX_B
        grams ^= self.eight[16 : self.n + 16] * GOLD
        grams = mix(grams)
        if self.n < WINDOW:
            return grams, np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
        least = sliding(grams, SPAN, np.minimum)
        of_wanted = np.where(wanted[: len(least)], least, U(0))
        padded = np.r_[np.zeros(SPAN - 1, dtype=U), of_wanted, np.zeros(SPAN - 1, dtype=U)]
        most = sliding(padded, SPAN, np.maximum)[: self.n]
        return grams, least, np.flatnonzero((grams[: len(most)] == most) & (most > 0))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def in_groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes], list[list]]]:
    """Ids, texts as bytes, and the other columns, about GROUP bytes at a time."""
    ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    texts, at = batch.column(1), 0
    while at < len(ids):
        to, held, size = at, [], 0
        while to < len(ids) and (to == at or size < GROUP):
            held.append(texts[to].as_buffer().to_pybytes())
            size += len(held[-1])
            to += 1
        yield ids[at:to], held, [batch.column(i).slice(at, to - at).to_pylist() for i in range(2, batch.num_columns)]
        at = to


def table_of(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Sorted intervals as start, end, start, end ..., touching ones joined."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return np.c_[starts[new], ends[np.r_[new[1:], True]]].ravel().tolist()


def emit_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts, _ in in_groups(batch):
            b = Block(texts)
            start, end = b.units()
            h, c = b.hashes(start, end + WINDOW - 1)
            doc = b.document(start)
            yield table_of({"h": h, "c": c, "doc_id": ids[doc], "at": (start - b.starts[doc]).astype(np.int32), "size": (end - start).astype(np.int32)})


def wanted_windows(b: Block, known: list) -> np.ndarray:
    wanted = b.whole.copy()
    b.cover(known, wanted, False)
    return wanted


def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts, (known,) in in_groups(batch):
            b = Block(texts)
            grams, _, at = b.anchors(wanted_windows(b, known))
            doc = b.document(at)
            yield table_of({"h": grams[at].view(np.int64), "doc_id": ids[doc], "at": (at - b.starts[doc]).astype(np.int32)})


def positions(b: Block, lists: list) -> np.ndarray:
    """The numbers that are listed for each document, as positions in the block, sorted."""
    found = [s + np.array(x, dtype=np.int64) for s, x in zip(b.starts, lists, strict=True) if x]
    return np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


def anchored(b: Block, wanted: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor position) of the wanted windows whose anchor is one of the ``repeated`` positions' strings."""
    grams, least, marked = b.anchors(wanted)
    own = np.sort(grams[repeated])
    at = np.flatnonzero(wanted[: len(least)])
    if not len(own) or not len(at):
        return at[:0], at[:0]
    place = np.minimum(np.searchsorted(own, least[at]), len(own) - 1)
    at = at[own[place] == least[at]]
    # The anchor is the first marked position of the window that has its least hash.
    k = np.searchsorted(marked, at)
    while (miss := grams[marked[k]] != least[at]).any():
        k[miss] += 1
    return at, marked[k]


def around(b: Block, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of window starts that a window with one of these anchors, or its block, can have."""
    doc = b.document(repeated)
    start = np.maximum(repeated - SPAN - BLOCK + 2, b.starts[doc])
    end = np.minimum(repeated, b.starts[doc] + b.sizes[doc] - WINDOW) + 1
    start, end = start[start < end], end[start < end]
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(start) else np.empty(0, dtype=np.int64)
    return start[new], end[np.r_[new[1:], len(end)] - 1] if len(start) else end


def anchored_in(b: Block, start: np.ndarray, end: np.ndarray, known: list, repeated: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """``anchored`` on the windows that start in [start, end): the cut block, the origin of its bytes, and the result in the cut block."""
    pieces, origin = b.cut(start, end)
    run = np.searchsorted(start, repeated, "right") - 1
    inside = (run >= 0) & (repeated < end[run] + WINDOW - GRAM) if len(start) else np.zeros(len(repeated), dtype=bool)
    moved = repeated[inside] - start[run[inside]] + pieces.starts[run[inside]]
    at, anchor = anchored(pieces, pieces.whole & wanted_windows(b, known)[origin], moved)
    return pieces, origin, at, anchor


def emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts, (known, repeated) in in_groups(batch):
            whole = Block(texts)
            marks = positions(whole, repeated)
            b, origin, at, anchor = anchored_in(whole, *around(whole, marks), known, marks)
            last = np.unique(anchor - (anchor - at) // BLOCK * BLOCK)
            piece = b.document(last)
            start = np.maximum(last - BLOCK + 1, b.starts[piece])
            end = np.minimum(last, b.starts[piece] + b.sizes[piece] - WINDOW) + 1
            k, kc = b.hashes(last, last + CORE)
            h, c = b.hashes(start, end + WINDOW - 1)
            place = origin[start]
            doc = whole.document(place)
            yield table_of({"k": k, "kc": kc, "h": h, "c": c, "doc_id": ids[doc], "at": (place - whole.starts[doc]).astype(np.int32), "size": (end - start).astype(np.int32)})


def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts, (known, repeated, look) in in_groups(batch):
            whole = Block(texts)
            edges = positions(whole, look)
            b, origin, at, _ = anchored_in(whole, edges[::2], edges[1::2], known, positions(whole, repeated))
            h, c = b.hashes(at, at + WINDOW)
            place = origin[at]
            doc = whole.document(place)
            yield table_of({"h": h, "c": c, "doc_id": ids[doc], "at": (place - whole.starts[doc]).astype(np.int32), "size": np.ones(len(at), dtype=np.int32)})


def emit_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts, (units, blocks, windows) in in_groups(batch):
            removed, spans, digests = [], [], []
            for text, *found in zip(texts, units, blocks, windows, strict=True):
                pairs = np.array([x for f in found for x in f or ()], dtype=np.int64).reshape(-1, 2)
                gone = merged(pairs[:, 0], pairs[:, 1] + WINDOW - 1)
                sha, at = hashlib.sha256(), 0
                for s, e in zip(gone[::2], gone[1::2], strict=True):
                    sha.update(text[at:s])
                    at = e
                sha.update(text[at:])
                removed.append(sum(gone[1::2]) - sum(gone[::2]))
                spans.append(gone)
                digests.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )


def listed(rows: DataFrame) -> DataFrame:
    """(doc_id, at, size) rows as sorted arrays of each document."""
    runs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("runs"))
    return runs.select("doc_id", F.col("runs.at").alias("at"), F.col("runs.size").alias("size"))


def later_ones(rows: DataFrame) -> DataFrame:
    """The (doc_id, at, size) rows whose content has an earlier occurrence."""
    firsts = rows.groupBy("h", "c").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "c", "first")
    # Written, so that both sides of the join are plain exchanges and Spark can split the rows of one content.
    firsts = materialize(firsts)
    later = rows.join(firsts, ["h", "c"]).where(F.struct("doc_id", "at") > F.col("first"))
    return listed(later.select("doc_id", "at", "size"))


def joined_runs(runs: DataFrame, name: str) -> DataFrame:
    """Neighbouring runs of each document as intervals start, end, start, end ..."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = batch.column(1), batch.column(2)
            out = []
            for i in range(batch.num_rows):
                a = np.asarray(at[i].values.to_numpy(), dtype=np.int64)
                out.append(merged(a, a + size[i].values.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", name])

    return materialize(runs.mapInArrow(join, f"doc_id long, {name} array<int>"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` of every document."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    named = materialize(texts.select("doc_id", F.xxhash64("text").alias("_text"), F.octet_length("text").cast("long").alias("_size")))
    n_bytes = named.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    named = named.select("doc_id", "_text")
    shared = named.groupBy("doc_id").agg(F.min("_text").alias("a"), F.max("_text").alias("z")).where("a < z")
    if shared.isEmpty():
        out = of_distinct_ids(texts, n_bytes)
    else:
        ranks = materialize(global_rank(named.distinct(), "doc_id", "_text"))
        numbered = texts.withColumn("_text", F.xxhash64("text")).join(ranks, ["doc_id", "_text"]).select(F.col("rank").alias("doc_id"), "text")
        out = of_distinct_ids(numbered, n_bytes).withColumnRenamed("doc_id", "rank").join(ranks.select("rank", "doc_id"), "rank").drop("rank")
        out = out.select("doc_id", *[c for c in out.columns if c != "doc_id"])
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def of_distinct_ids(texts: DataFrame, n_bytes: int) -> DataFrame:
    """``remove_repeats`` of rows whose id names one text."""
    texts = bucketed(texts, "doc_id", n_bytes)
    unit_rows = materialize(texts.mapInArrow(emit_units, "h long, c int, doc_id long, at int, size int"))
    units = joined_runs(later_ones(unit_rows), "units")
    discard(unit_rows)

    with_units = by_bucket(texts, units, "doc_id", "left").select("doc_id", "text", "units")
    anchor_rows = materialize(with_units.mapInArrow(emit_anchors, "h long, doc_id long, at int"))
    repeated = anchor_rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    repeated = materialize(repeated)
    anchors = materialize(anchor_rows.join(repeated, "h").groupBy("doc_id").agg(F.collect_list("at").alias("anchors")))
    discard(anchor_rows, repeated)

    known = materialize(anchors.join(units, "doc_id", "left").select("doc_id", "units", "anchors"))
    discard(anchors)
    some = by_bucket(texts, known, "doc_id", "inner").select("doc_id", "text", "units", "anchors")
    block_rows = materialize(some.mapInArrow(emit_blocks, "k long, kc int, h long, c int, doc_id long, at int, size int"))
    blocks = joined_runs(later_ones(block_rows), "blocks")
    strings = materialize(block_rows.groupBy("k", "kc", "h", "c").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("size").alias("size")))
    shared = materialize(strings.groupBy("k", "kc").agg(F.count("*").alias("n")).where("n > 1").select("k", "kc"))
    look = joined_runs(listed(strings.join(shared, ["k", "kc"]).select("first.doc_id", "first.at", "size")), "look")
    discard(block_rows, strings, shared)

    some = by_bucket(texts, known.join(look, "doc_id"), "doc_id", "inner").select("doc_id", "text", "units", "anchors", "look")
    window_rows = materialize(some.mapInArrow(emit_windows, "h long, c int, doc_id long, at int, size int"))
    windows = joined_runs(later_ones(window_rows), "windows")
    discard(window_rows, known, look)

    every = materialize(units.join(blocks, "doc_id", "full_outer").join(windows, "doc_id", "full_outer").select("doc_id", "units", "blocks", "windows"))
    discard(units, blocks, windows)
    return by_bucket(texts, every, "doc_id", "left").select("doc_id", "text", "units", "blocks", "windows").mapInArrow(emit_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")

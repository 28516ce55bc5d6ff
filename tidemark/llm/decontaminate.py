"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased and their white space is collapsed. Two
strings of length L within e edits share at least ``L - Q + 1 - Q * e`` q-grams, and
these lie in diagonals (text position minus item position) at most e apart. So the
shared q-grams of a document and an item are counted in diagonal bands of width
``2 e`` that overlap by e, and only bands that meet the least bound of a stretch are
looked at again: there a banded local alignment decides exactly.

A document is contaminated by an item if a stretch of at least ``share`` of the item
(and at least ``least`` characters, or the whole item where it is shorter) occurs in
it with at most ``edits`` edits a character, wherever the stretch begins and ends.

The items are the stated query set. They are written once to the shared folder in blocks
of about ``block_chars`` characters, dealt by a hash. One pass over the documents meets
them all: a worker searches each batch of texts for one block after the other and keeps
the q-gram tables of at most ``HELD`` blocks, so memory is bounded whatever the size of
the benchmark, and nothing is broadcast. Shared q-grams are counted ``LIMIT`` at a time: where
texts and items share more (a template line of all items), texts and then items are
halved. Whole texts are searched, ``GROUP`` characters together, a longer one by itself.

Null and empty texts are clean. Items shorter than 2 Q characters are looked for
exactly, between word boundaries; empty items match nothing. Items that repeat an id are
found under it if any of them is. Repeated rows are searched alike; an empty table gives no
rows, an empty benchmark leaves every document clean; extra columns pass, but columns
named ``item_ids`` or ``contaminated`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from tidemark.llm.common import filesystem, owned, shared_dir

Q = 10
#: Bits of the table that most q-grams of a text fail in.
TABLE_BITS = 22
#: Characters that are searched at once.
GROUP = 1 << 20
#: Characters of an item that are aligned at once.
ROWS = 512
#: Pairs of equal q-grams that are counted at once.
LIMIT = 1 << 22
#: Blocks of items whose tables a worker keeps.
HELD = 4
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def byte_codes(text: str) -> bytes:
    """One byte a character: Latin-1, others folded. Equal characters have equal bytes."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return ((points ^ points >> 8 ^ points >> 16) & 0xFF).astype(np.uint8).tobytes()


def gram_hashes(codes: bytes) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    first = np.ndarray((n,), dtype="<u8", buffer=codes, strides=(1,))
    second = np.ndarray((n,), dtype="<u8", buffer=codes, offset=Q - 8, strides=(1,))
    mixed = first * MIX_A
    mixed ^= second * MIX_B
    mixed *= MIX_A
    return mixed


def alignment(stretch: str, segment: str, most: int) -> int:
    """Least edits that turn ``stretch`` into some substring of ``segment``; ``most + 1`` if more."""
    if stretch in segment:
        return 0
    a = np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    b = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for i, c in enumerate(a, 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != c))
        row = np.minimum.accumulate(step - steps) + steps  # insertions, left to right
        if row.min() > most:
            return most + 1
    return int(min(row.min(), most + 1))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def stretch_found(item: str, text: str, low: int, width: int, size: int, edits: float) -> bool:
    """Whether a stretch of ``size`` or more of ``item`` is in ``text``, within ``edits`` edits a character, on the ``width`` diagonals from ``low``.

    For each end of a stretch, diagonal and number of edits the earliest begin is
    kept; rows are worked on in blocks, so memory grows with edits times diagonals.
    """
    a, b = points(item), points(text)
    # Text position j + low + c; positions outside the text match nothing.
    padded = np.full(len(a) + width, 0xFFFFFFFF, dtype=np.uint32)
    at, to = max(0, low), min(len(b), low + len(padded))
    if at >= to:
        return False
    padded[at - low : to - low] = b[at:to]
    around = np.lib.stride_tricks.sliding_window_view(padded, width)
    most, far = int(edits * len(a) + 1e-9), len(a) + 1
    needs = [max(size, next(n for n in range(max(0, int(k / edits) - 1) if edits else 0, far + 2) if k <= edits * n + 1e-9)) for k in range(most + 1)]
    carried = np.zeros((most + 1, width), dtype=np.int64)
    for top in range(0, len(a), ROWS):
        rows = a[top : top + ROWS]
        runs = np.zeros((len(rows) + 1, width), dtype=np.int64)
        np.cumsum(around[top : top + len(rows)] != rows[:, None], axis=0, out=runs[1:])
        runs *= far
        ends = np.arange(top, top + len(rows) + 1)[:, None]
        before = None
        for k in range(most + 1):
            begin = np.repeat(ends, width, axis=1)
            begin[0] = carried[k]
            if before is not None:
                np.minimum(begin[1:], before[:-1], out=begin[1:])  # one character for another
                np.minimum(begin[1:, :-1], before[:-1, 1:], out=begin[1:, :-1])  # one of the item's left out
                np.minimum(begin[1:, 1:], before[1:, :-1], out=begin[1:, 1:])  # one of the text's put in
            begin -= runs
            np.minimum.accumulate(begin, axis=0, out=begin)  # on over equal characters
            begin += runs
            if (ends - begin >= needs[k]).any():
                return True
            carried[k], before = begin[-1], begin
    return False


@dataclass
class Item:
    item_id: int
    text: str
    size: int  # characters of the shortest stretch
    bound: int  # shared q-grams that any stretch needs
    width: int  # edits of the longest stretch


class Matcher:
    """The q-grams of a block of items, and the search for them."""

    def __init__(self, rows: list[tuple[int, str]], edits: float, share: float, least: int):
        self.rows, self.parameters = rows, (edits, share, least)
        self.edits, self.items, self.short = edits, [], []
        self._halves: tuple[Matcher, ...] = ()
        hashes, owners, places = [], [], []
        for item_id, raw in rows:
            text = normalise(raw)
            if len(text) < 2 * Q:
                if text:
                    self.short.append((item_id, f" {text} "))
                continue
            size = min(len(text), max(least, -(-int(len(text) * share * 1000) // 1000)))
            lengths = np.arange(size, len(text) + 1)
            bound = int((lengths - Q + 1 - Q * np.floor(edits * lengths + 1e-9)).min())
            got = gram_hashes(byte_codes(text))
            hashes.append(got)
            owners.append(np.full(len(got), len(self.items)))
            places.append(np.arange(len(got)))
            self.items.append(Item(item_id, text, size, max(1, bound), max(1, int(edits * len(text) + 1e-9))))
        if hashes:
            all_hashes, all_owners, all_places = map(np.concatenate, (hashes, owners, places))
            order = np.argsort(all_hashes, kind="stable")
            self.hashes, self.owners, self.places = all_hashes[order], all_owners[order], all_places[order]
            self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
            self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def halves(self) -> tuple[Matcher, ...]:
        """Matchers of the long items, half of them each."""
        if not self._halves:
            long = [(i.item_id, i.text) for i in self.items]
            self._halves = tuple(Matcher(part, *self.parameters) for part in (long[: len(long) // 2], long[len(long) // 2 :]))
        return self._halves

    def search(self, texts: list[str]) -> list[list[int]]:
        """For each normalised text the ids of the items that contaminate it."""
        found: list[set[int]] = [set() for _ in texts]
        for item_id, padded in self.short:
            for k, t in enumerate(texts):
                if padded in f" {t} ":
                    found[k].add(item_id)
        at = 0
        while self.items and at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < GROUP):
                size += len(texts[to])
                to += 1
            self.search_group(texts[at:to], found[at:to])
            at = to
        return [sorted(f) for f in found]

    def search_group(self, texts: list[str], found: list[set[int]]) -> None:
        codes = b"\0".join(map(byte_codes, texts))
        grams = gram_hashes(codes)
        place = np.flatnonzero(self.table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        got = grams[place]
        lo = np.searchsorted(self.hashes, got, "left")
        n = np.searchsorted(self.hashes, got, "right") - lo
        place, lo, n = place[n > 0], lo[n > 0], n[n > 0]
        if not len(place):
            return
        if n.sum() > LIMIT:
            half = len(texts) // 2
            if half:
                self.search_group(texts[:half], found[:half])
                self.search_group(texts[half:], found[half:])
            elif len(self.items) > 1:
                for matcher in self.halves():
                    matcher.search_group(texts, found)
            else:
                self.search_all_bands(texts[0], found[0])
            return
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(place, n)
        owner, diagonal = self.owners[entry], place - self.places[entry]
        text = np.searchsorted(starts, place, "right") - 1
        order = np.lexsort((place, diagonal, owner, text))
        text, owner, diagonal, place = text[order], owner[order], diagonal[order], place[order]
        edges = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]), True])
        bounds = np.array([i.bound for i in self.items])
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if z - a < bounds[owner[a]] or (item := self.items[owner[a]]).item_id in found[text[a]]:
                continue
            d, p = diagonal[a:z], place[a:z]
            for band in np.unique(np.r_[d // item.width, d // item.width - 1]):
                inside = (d >= band * item.width) & (d < (band + 2) * item.width)
                if len(np.unique(p[inside])) < item.bound:
                    continue
                low = int(band * item.width - starts[text[a]])
                if stretch_found(item.text, texts[text[a]], low, 2 * item.width, item.size, self.edits):
                    found[text[a]].add(item.item_id)
                    break


    def search_all_bands(self, text: str, found: set[int]) -> None:
        """Align the only item on every band of a text, uncounted."""
        item = self.items[0]
        for low in range(-len(item.text), len(text), item.width):
            if item.item_id not in found and stretch_found(item.text, text, low, 2 * item.width, item.size, self.edits):
                found.add(item.item_id)


def written_blocks(benchmark: DataFrame, block_chars: int) -> tuple[str, list[int]]:
    """Write the items in blocks by a hash of their id; the folder and the numbers of the blocks that have items."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_chars))
    folder = shared_dir(benchmark.sparkSession)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(folder)
    owned(dealt, folder)
    # A number for each block: their count is that of the benchmark's megabytes.
    return folder, [r[0] for r in dealt.select("block").distinct().orderBy("block").collect()]


_MATCHERS: dict[tuple, Matcher] = {}


def matcher(folder: str, block: int, parameters: tuple[float, float, int]) -> Matcher:
    """The matcher of a written block; the last few are kept."""
    import pyarrow.parquet as pq

    key = (folder, block, parameters)
    if key not in _MATCHERS:
        while len(_MATCHERS) >= HELD:
            del _MATCHERS[next(iter(_MATCHERS))]
        store, path = filesystem(folder)
        items = pq.ParquetDataset(f"{path}/block={block}", filesystem=store, partitioning=None).read(columns=["item_id", "text"])
        rows = sorted(zip(items.column(0).to_pylist(), items.column(1).to_pylist(), strict=True))
        _MATCHERS[key] = Matcher(rows, *parameters)
    return _MATCHERS[key]


def found_items(spark: SparkSession, text: Column, benchmark: DataFrame, edits: float = 0.06, share: float = 0.5, least: int = 50, block_chars: int = 1 << 20) -> Column:
    """The ids of the items found in a text, ascending."""
    folder, blocks = written_blocks(benchmark, block_chars)

    @pandas_udf(ArrayType(LongType()))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            texts = [normalise(t) for t in raw]
            found: list[set[int]] = [set() for _ in texts]
            for block in blocks:
                for ids, more in zip(found, matcher(folder, block, (edits, share, least)).search(texts), strict=True):
                    ids.update(more)
            yield pd.Series([sorted(ids) for ids in found], dtype="object")

    return find(text)


def find_contamination(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` with ``item_ids`` (the items found, ascending) and ``contaminated``."""
    found = docs.withColumn("item_ids", found_items(docs.sparkSession, F.col("text"), benchmark, **parameters))
    return found.withColumn("contaminated", F.size("item_ids") > 0)

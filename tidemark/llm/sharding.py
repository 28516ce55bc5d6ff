"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by a key of fixed digits: digits of a hash of the text, then of a hash
of the document id, then of a hash of the row's place in a written table. Copies of a
text therefore stand together, and a text that a third of all rows share is still
divided, by the digits of its ids, and rows that share text and id by their places.

The splitters between shards are found from exact byte counts. Pass ``i`` counts the
bytes below every candidate boundary of ``RADIX`` probes inside the cells that still
hold a splitter, partition by partition (a partial aggregate), and keeps, for each
splitter, the one cell that contains its target. Passes go on until every open cell
holds at most ``tolerance`` of a shard's bytes or the key has no more digits; each
pass reads only a slim table of key and size. Then every row knows its shard, and rows
are exchanged once, each to a partition of that shard, where they are sorted and
numbered from the counts of the partitions. A shard of many rows has several
partitions, so no task grows with the table.

Law ``bytes``: the shards' sizes are near equal (within ``tolerance`` of a shard and the
largest row at each splitter); counts of rows may differ. Groups: copies of one text
stay in one shard unless that costs more balance than the largest row: a splitter moves to
the nearer edge of a group, by half of it at most, so groups of at most twice the bytes of
the largest row, or of ``tolerance`` of a shard, are whole. A larger one is divided between
the shards on both sides where it meets a splitter, as the law asks. A null text has no bytes, a null ``doc_id`` is a key
like any other, rows that repeat another whole row stand beside it or are divided like
other copies, a very long text is one row of its size, an empty table has no rows. Extra
columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, text_or_empty

#: Bits of one digit, and the parts of the key with their digits.
BITS = 10
PARTS = (("kh", 4), ("kd", 4), ("kt", 2))
RADIX = 1 << BITS
DIGITS = sum(n for _, n in PARTS)
#: The digits of the text alone.
TEXT_DIGITS = PARTS[0][1]
#: Rows of one partition of a shard, about.
PARTITION_ROWS = 2_000_000


def digit(level: int) -> Column:
    """Digit ``level`` of the key."""
    for name, n in PARTS:
        if level < n:
            return F.shiftright(F.col(name), BITS * (n - 1 - level)).bitwiseAND(RADIX - 1)
        level -= n
    raise IndexError(level)


def number(digits: tuple[int, ...]) -> int:
    value = 0
    for d in digits:
        value = (value << BITS) + d
    return value


def prefix_equals(prefix: tuple[int, ...]) -> Column:
    """Whether a row's key starts with these digits."""
    test = F.lit(True)
    for name, n in PARTS:
        part, prefix = prefix[:n], prefix[n:]
        if part:
            test = test & (F.shiftright(F.col(name), BITS * (n - len(part))) == F.lit(number(part)))
    return test


def keyed(docs: DataFrame, overhead: int) -> DataFrame:
    """Slim rows: doc_id, size, text_crc32 and the parts of the key. Write them before use: ``kt`` is the row's place."""
    text = text_or_empty("text")
    bits = {name: (1 << BITS * n) - 1 for name, n in PARTS}
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(bits["kh"]).alias("kh"),
        F.xxhash64("doc_id", F.lit(1)).bitwiseAND(bits["kd"]).alias("kd"),
        F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(bits["kt"]).alias("kt"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, ...]], int]:
    """The key at which each of shards 1.. begins, and the number of passes.

    The driver sees at most ``shards`` cells of ``RADIX`` sums a pass.
    """
    passes = 0
    done: dict[int, tuple[int, ...]] = {}
    open_cells: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(1, shards)))}
    total, largest = None, 0
    for level in range(DIGITS):
        cells = sorted(open_cells)
        if not cells:
            break
        passes += 1
        cell = F.lit(None).cast("int")
        for i, prefix in reversed(list(enumerate(cells))):
            cell = F.when(prefix_equals(prefix), F.lit(i)).otherwise(cell)
        sums = (
            rows.select(cell.alias("cell"), digit(level).cast("int").alias("digit"), "size")
            .where("cell IS NOT NULL")
            .groupBy("cell", "digit")
            .agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"))
            .collect()
        )
        table: dict[int, dict[int, int]] = {}
        for r in sums:
            table.setdefault(r["cell"], {})[r["digit"]] = r["bytes"]
        if total is None:
            total, largest = sum(table.get(0, {}).values()), max((r["largest"] for r in sums), default=0)
        target = [total * s // shards for s in range(shards)]
        narrower: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for i, prefix in enumerate(cells):
            below, wanted = open_cells[prefix]
            for d in sorted(table.get(i, {})):
                here = table[i][d]
                inside = [s for s in wanted if below <= target[s] < below + here]
                whole = here * shards <= tolerance * total or level == DIGITS - 1 or (level == TEXT_DIGITS - 1 and here <= 2 * largest)
                for s in inside:
                    if whole:
                        # Begin the shard at the nearer of its two edges.
                        nearer = d if target[s] - below <= below + here - target[s] else d + 1
                        done[s] = (*prefix, nearer)
                    else:
                        narrower.setdefault((*prefix, d), (below, []))[1].append(s)
                below += here
        open_cells = narrower
    keys = []
    for s in range(1, shards):
        digits = done.get(s, (RADIX,))
        value = number(digits) << BITS * (DIGITS - len(digits))
        parts = []
        for _, n in reversed(PARTS):
            parts.append(value & ((1 << BITS * n) - 1))
            value >>= BITS * n
        # A boundary above the last digit carries into the first part.
        parts[-1] += value << BITS * PARTS[0][1]
        keys.append(tuple(reversed(parts)))
    return keys, passes


def shard_of(keys: list[tuple[int, ...]]) -> Column:
    """The number of splitters at or below a row's key."""
    row = F.struct(*[F.col(name) for name, _ in PARTS])
    shard = F.lit(0)
    for key in keys:
        shard = shard + (row >= F.struct(*[F.lit(k).cast("long") for k in key])).cast("int")
    return shard.cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    rows = materialize(keyed(docs, overhead))
    keys, _ = splitters(rows, shards, tolerance)
    order = [name for name, _ in PARTS]
    # Equal keys of a shard share a partition, so the order of slots is that of the key within each.
    ways = 1 + rows.count() // (shards * PARTITION_ROWS)
    partition = F.col("shard") * ways + F.pmod(F.xxhash64(*order), F.lit(ways)).cast("int")
    placed = materialize(
        rows.withColumn("shard", shard_of(keys))
        .repartitionById(shards * ways, partition.cast("int"))
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .select("doc_id", "size", "text_crc32", "shard", "_at")
    )
    discard(rows)
    part = F.shiftright("_at", 33)
    # At most one row for each partition and each shard that ends in it.
    runs = placed.groupBy(part.alias("_part"), "shard").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).collect()
    starts, filled = [], dict.fromkeys(range(shards), 0)
    for r in sorted(runs, key=lambda r: r["_first"]):
        starts.append((r["_part"], r["shard"], r["_first"] - filled[r["shard"]]))
        filled[r["shard"]] += r["_n"]
    values = ",".join(f"({p}L, {s}, {b}L)" for p, s, b in starts) or "(0L, 0, 0L)"
    offsets = spark.sql(f"SELECT * FROM VALUES {values} AS t(_part, shard, _base)")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), ["_part", "shard"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )

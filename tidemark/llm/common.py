"""Helpers shared by the corpus operators: tables, the shared folder, text basics."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where nothing
    is set (tests on one machine) a folder of our own is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder given as a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Tables that the ``finished`` run of this thread has written and not yet deleted, in order.
_WRITTEN: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def owned(df: DataFrame, path: str) -> DataFrame:
    """``df``, which reads what we wrote to ``path``, known to ``discard`` and to the ``finished`` run that wrote it."""
    df.written_to = path
    held = _WRITTEN.get()
    if held is not None:
        held.append(df)
    return df


@contextmanager
def emptied_on_failure(spark: SparkSession, path: str, table_name: str | None = None) -> Iterator[None]:
    """What a failed write has left is deleted."""
    try:
        yield
    except BaseException:
        if table_name:
            spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        delete_folder(spark, path)
        raise


#: Spark's setting by which a query's shuffle files go as soon as it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By session: writes under way, and the setting as it was before them.
_CLEANING: dict[int, list] = {}
_LOCK = Lock()


@contextmanager
def shuffles_end_with_write(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write within go when it is over: later steps read what is written.

    Otherwise they stay on the executors' disks until the driver happens to collect its
    garbage. The session's own setting comes back with the last of the writes at one time.
    """
    with _LOCK:
        held = _CLEANING.setdefault(id(spark), [0, spark.conf.get(CLEANUP)])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(CLEANUP, held[1])
                del _CLEANING[id(spark)]


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage in a way that survives lost executors and gives later passes a
    columnar table to prune.
    """
    path = shared_dir(df.sparkSession)
    with emptied_on_failure(df.sparkSession, path), shuffles_end_with_write(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return owned(df.sparkSession.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, key: str, n_bytes: int, bucket_bytes: int = 64 << 20, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once, dealt into buckets by a hash of ``key``, as a table in the shared folder.

    Joins by ``key`` then read it where it lies: only the other, slim side is exchanged,
    however large it is. ``n_bytes``: the size of the rows, about.
    """
    spark, path, name = df.sparkSession, shared_dir(df.sparkSession), f"tidemark_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // bucket_bytes))
    with emptied_on_failure(spark, path, name), shuffles_end_with_write(spark):
        df.repartition(n, key).write.format("parquet").option("compression", codec).option("path", path).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    # The frame knows files and buckets; the catalogue needs no entry that a run cut short would leave.
    spark.sql(f"DROP TABLE {name}")
    return owned(out, path)


def by_bucket(big: DataFrame, slim: DataFrame, key: str, how: str) -> DataFrame:
    """A join of a bucketed table with a slim one: the slim side goes to the buckets and is hashed there, bucket by bucket."""
    return big.join(slim.hint("shuffle_hash"), key, how)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` or ``bucketed`` wrote and that nothing reads any more."""
    for df in tables:
        delete_folder(df.sparkSession, df.written_to)
        held = _WRITTEN.get()
        if held is not None:
            held[:] = [other for other in held if other.written_to != df.written_to]


def discard(*tables: DataFrame) -> None:
    """``forget`` tables and collect the driver's garbage, upon which Spark's cleaner drops the
    shuffle files of the steps that are over and were no writes of ours."""
    forget(*tables)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``make``, and nothing else of what it wrote on the way, even where it fails.

    Each run knows its own tables only, so queries of several threads don't meet.
    """
    outer = _WRITTEN.set([])
    out = None
    try:
        out = materialize(make())
    finally:
        discard(*[df for df in _WRITTEN.get() if df is not out])
        _WRITTEN.reset(outer)
    return owned(out, out.written_to)


def only_result(step: Callable) -> Callable:
    """A step that leaves no written tables but those it returns; what it returns must read no others of its own."""

    @wraps(step)
    def run(*args, **named):
        outer = _WRITTEN.get()
        held = _WRITTEN.set([])
        kept: set[str] = set()
        try:
            out = step(*args, **named)
            kept = {df.written_to for df in (out if isinstance(out, tuple) else (out,))}
            return out
        finally:
            forget(*[df for df in _WRITTEN.get() if df.written_to not in kept])
            left = _WRITTEN.get()
            _WRITTEN.reset(held)
            if outer is not None:
                outer.extend(left)

    return run


def text_or_empty(column: str | Column = "text") -> Column:
    """The text, a null read as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """The text with A to Z in lower case and every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_between(text: Column, separators: str) -> Column:
    """The maximal runs of characters outside a class, in order.

    A split, because the regexp function that extracts all matches copies the text for each of them.
    """
    return F.array_remove(F.split(text, f"[{separators}]+"), "")


def global_rank(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` (slim rows) with ``rank``: its place from 0 in the order of ``keys``.

    One range exchange; the offsets of the partitions are summed from one row a
    partition, so no task sees more than its own range. The ranked rows are
    written once, so that every reader sees the same ranks.
    """
    spark = df.sparkSession
    placed = materialize(
        df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # A row a partition: their number is a setting, not a size of the data.
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    starts, total = [], 0
    for pid, n in counts:
        starts.append((pid, total))
        total += n
    if not starts:
        return placed.withColumn("rank", row).drop("_at")
    offsets = spark.sql("SELECT * FROM VALUES " + ",".join(f"({p}L, {s}L)" for p, s in starts) + " AS t(_part, _start)")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("rank", row + F.col("_start"))
        .drop("_at", "_part", "_start")
    )

"""The long metric store as versioned folders behind a manifest.

    data/metric_key=<key>/bucket=<users' hash>/version=<number-id>/part-*.parquet
    manifests/<number>.json

A manifest names the version of every (metric, bucket). A write goes to new version
folders of the (metric, bucket) pairs that its batch changes and becomes visible when the
next manifest is renamed into place, which fails if another writer was first: the write
is then done again on the newer manifest. Readers hold on to the manifest they read;
versions that the last manifests don't name are removed by ``vacuum``.

Rows keep the sequence number that wrote them. A row of a batch replaces a stored one
with a smaller number only, so a batch that comes again, or comes late, changes nothing.
The manifest has an entry a metric and bucket, whatever the number of rows; it is all
that the driver holds.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import finite

KEYS = ["user_id", "date", "metric_key", "source"]
COLUMNS = [*KEYS, "value", "seq"]
LAYOUT = "user_id long, date date, source string, value double, seq long, metric_key string, bucket int, version string"


class Conflict(Exception):
    """Another writer has put the next manifest in place."""


class Folder:
    """Small files and folders of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.files = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Write a file that must not be there yet: whole, then renamed; ``Conflict`` if it is."""
        held = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.files.create(held)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = SparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf).rename(self.files.makeQualified(held), self.files.makeQualified(self.path(name)), how)
        except Exception as error:
            self.files.delete(held, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(name) from error
            raise

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)


class VersionedStore:
    """(user_id, date, metric_key, source, value, seq), one row a key."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.folder = Folder(spark, root)

    def manifests(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json")]

    def manifest(self, number: int | None = None) -> tuple[int, dict[tuple[str, int], str]]:
        """(number, version of each (metric, bucket)) of a manifest, or of the newest; number 0 is the empty store."""
        number = max(self.manifests(), default=0) if number is None else number
        if not number:
            return 0, {}
        held = json.loads(self.folder.read(f"manifests/{number:012d}.json"))
        return number, {(key, bucket): version for key, bucket, version in held}

    def place(self, key: str, bucket: int, version: str) -> str:
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key)
        return f"data/metric_key={name}/bucket={bucket}/version={version}"

    def _rows(self, entries: dict[tuple[str, int], str]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], LAYOUT)
        paths = [f"{self.root}/{self.place(k, b, v)}" for (k, b), v in sorted(entries.items())]
        return self.spark.read.schema(LAYOUT).option("basePath", f"{self.root}/data").parquet(*paths)

    def read(self, keys: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The rows of a manifest (the newest), only the folders of the named metrics."""
        _, entries = self.manifest(number)
        return self._rows({e: v for e, v in entries.items() if keys is None or e[0] in keys}).select(*COLUMNS)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int"))

    def upsert(self, batch: DataFrame, order: str = "seq", tries: int = 5) -> DataFrame:
        """Write a batch over the store; (user_id, metric_key, first_day) of what changed.

        Rows without user, day, metric or source, or without a finite value, are dropped;
        of rows of one key the one with the largest number counts (of those the largest value).
        """
        named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*KEYS, order]])
        newest = F.max(F.struct(F.col(order).cast("long").alias("seq"), F.col("value").cast("double").alias("value"))).alias("w")
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        self._bucketed(batch.where(named & finite("value")).groupBy(*KEYS).agg(newest).select(*KEYS, "w.value", "w.seq")).write.parquet(staged)
        new = self.spark.read.parquet(staged)
        for _ in range(tries):
            try:
                changed = self._merge(new, staged)
                break
            except Conflict:
                continue
        else:
            raise Conflict(f"{tries} writers were first")
        return changed.groupBy("user_id", "metric_key").agg(F.min("date").alias("first_day"))

    def _merge(self, new: DataFrame, staged: str) -> DataFrame:
        number, entries = self.manifest()
        touched = {(r[0], r[1]) for r in new.select("metric_key", "bucket").distinct().collect()}
        old = self._rows({e: v for e, v in entries.items() if e in touched})
        changes = f"{staged}-changes-{number}"
        known = old.select(*KEYS, F.col("seq").alias("_seq"))
        new.join(known, KEYS, "left").where("_seq IS NULL OR seq > _seq").drop("_seq").write.mode("overwrite").parquet(changes)
        changed = self.spark.read.schema(new.schema).parquet(changes)
        pairs = {(r[0], r[1]) for r in changed.select("metric_key", "bucket").distinct().collect()}
        if not pairs:
            return changed
        version = f"{number + 1}-{uuid.uuid4().hex[:8]}"
        held = self._rows({e: v for e, v in entries.items() if e in pairs}).select(*COLUMNS, "bucket")
        both = held.unionByName(changed.select(*COLUMNS, "bucket")).groupBy(*KEYS, "bucket").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        both.withColumn("version", F.lit(version)).repartition("metric_key", "bucket").write.mode("append").partitionBy("metric_key", "bucket", "version").parquet(f"{self.root}/data")
        entries |= dict.fromkeys(pairs, version)
        self.folder.write_new(f"manifests/{number + 1:012d}.json", json.dumps([[k, b, v] for (k, b), v in sorted(entries.items())]))
        return changed

    def vacuum(self, keep: int = 2) -> int:
        """Remove the versions that none of the last ``keep`` manifests names, and older manifests; how many versions went."""
        numbers = sorted(self.manifests())
        kept = numbers[-keep:]
        named = {self.place(k, b, v) for n in kept for (k, b), v in self.manifest(n)[1].items()}
        gone = 0
        for metric in self.folder.names("data"):
            for bucket in self.folder.names(f"data/{metric}") if metric.startswith("metric_key=") else []:
                for version in self.folder.names(f"data/{metric}/{bucket}"):
                    place = f"data/{metric}/{bucket}/{version}"
                    # A number beyond the newest manifest's belongs to a writer that is at work.
                    if place not in named and int(version.removeprefix("version=").split("-")[0]) <= max(numbers, default=0):
                        self.folder.delete(place)
                        gone += 1
        for n in numbers[:-keep]:
            self.folder.delete(f"manifests/{n:012d}.json")
        return gone

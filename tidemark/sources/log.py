"""An append-only log as a Spark data source whose batches are written once, however often they are tried.

    df.write.format("tidemark_log").options(path=..., batch="2024-01-05T10:00").mode("append").save()

A task writes its rows to a file of its own, under a name that no other attempt has, and
reports the name. The driver commits a batch by one small file that lists the names, put
in place by a move; readers see only what such a file lists. A task that was killed and
run again, or ran twice, leaves a file that no commit lists; a batch that is committed
already is not committed again, and what its repetition wrote is deleted. The commit
lists as many names as the batch had tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


class Store:
    """The log's folders: files/ and commits/."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def text(self, name: str) -> str | None:
        try:
            with self.files.open_input_stream(f"{self.root}/{name}") as f:
                return f.readall().decode()
        except FileNotFoundError:
            return None

    def put(self, name: str, text: str) -> None:
        """A whole file or none."""
        folder = f"{self.root}/{name}".rpartition("/")[0]
        self.files.create_dir(folder, recursive=True)
        held = f"{folder}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(held) as f:
            f.write(text.encode())
        self.files.move(held, f"{self.root}/{name}")

    def delete(self, names: list[str]) -> None:
        for name in names:
            try:
                self.files.delete_file(f"{self.root}/{name}")
            except FileNotFoundError:
                continue

    def commits(self) -> list[list[str]]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
        return [json.loads(self.text(f"commits/{n}")) for n in names]


@dataclass
class Written(WriterCommitMessage):
    """The file of a task; none if it had no rows."""

    name: str | None


class LogWriter(DataSourceArrowWriter):
    """Writes the tasks' files and commits the batch."""

    def __init__(self, options: dict) -> None:
        self.path, self.batch = options["path"], options["batch"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        store, writer, name = Store(self.path), None, f"files/{uuid.uuid4().hex}.parquet"
        try:
            for batch in iterator:
                if batch.num_rows:
                    if writer is None:
                        store.files.create_dir(f"{store.root}/files", recursive=True)
                        writer = pq.ParquetWriter(f"{store.root}/{name}", batch.schema, filesystem=store.files)
                    writer.write_batch(batch)
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, mine = Store(self.path), [m.name for m in messages if m is not None and m.name]
        name = f"commits/{quote(self.batch, safe='')}.json"
        if store.text(name) is None:
            store.put(name, json.dumps(mine))
        else:
            store.delete(mine)

    def abort(self, messages: list[Written | None]) -> None:
        Store(self.path).delete([m.name for m in messages if m is not None and m.name])


@dataclass
class LogFile(InputPartition):
    """A file that a commit lists."""

    name: str


class LogReader(DataSourceReader):
    """Reads what the commits list, a task a file."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[LogFile]:
        return [LogFile(n) for names in Store(self.path).commits() for n in names]

    def read(self, partition: LogFile | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store = Store(self.path)
        if partition is not None:  # a read without partitions is one of None
            yield from pq.ParquetFile(store.files.open_input_file(f"{store.root}/{partition.name}")).iter_batches()


class LogSource(DataSource):
    """``tidemark_log``: options path, to write also batch; a read needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter(dict(self.options))

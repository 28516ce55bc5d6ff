"""WARC archives as a chunked record table.

A payload is never one value on its way into or out of an archive: it is rows of
(record, chunk number, at most ``chunk_bytes`` bytes).

Writing: built-in expressions cut every payload into chunk rows; these are exchanged,
sorted and streamed by tasks into archive files of about ``archive_bytes`` below a
shared folder, one gzip member a record, with a running SHA-1 that must end in the
digest of the header. Files are written through a file system client, so the folder
may be in any store that client reaches, under a name of the task attempt, and then
renamed to one of partition, number and content: a task that runs twice leaves the same
archive, and equal archives of two tasks stay two. The manifest of files is a table.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the
largest key is a ``response``; the others are ``revisit`` records that carry the
payload's digest, its length (in the stored HTTP header) and the key they refer to.

Reading: as many tasks as there are archives stream them; a record's payload comes out
as chunk rows, each with the running length and SHA-1 of the payload so far. The last
chunk of a record has the digest of all of it.

Every row gives a record. Null texts are empty payloads; an empty payload is one chunk
of 0 bytes. A row with a null key is a response without key, whatever its payload. Rows
with equal keys and payloads give equal records (the largest key is then shared; all of
them are responses); rows with equal keys and different payloads are different records.
Very long payloads are more chunks. Empty tables give no archive and no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import delete_folder, discard, filesystem, materialize, shared_dir, text_or_empty

CRLF = b"\r\n"
MANIFEST = "archive string, n_records long, n_bytes long"
CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, declared_digest string, declared_bytes long, "
    "chunk_no int, chunk binary, bytes_so_far long, sha1_so_far string, is_last boolean"
)


def record_types(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that a record of the same payload replaces, from slim rows only.

    The winners of repeated payloads come from a pre-aggregated group; the join back
    moves a digest and a key a row, and Spark may split a digest that many rows share.
    """
    html = text_or_empty("html")
    slim = pages.select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("n_bytes"))
    slim = materialize(slim.where((F.col("n_bytes") >= revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest"))
    winners = materialize(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).where("_least < refers_to").select("digest", "refers_to"))
    types = materialize(slim.join(winners, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct())
    discard(slim, winners)
    return types


def chunk_table(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """(page_id, url, digest, n_bytes, record, chunk_no, chunk) of every page; ``record`` numbers the rows."""
    payload = F.encode(text_or_empty("html"), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("record"))
    size = F.octet_length("payload")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / chunk_bytes), F.lit(0)).cast("int"))
    return rows.select(
        "page_id", "url", F.sha1("payload").alias("digest"), size.cast("long").alias("n_bytes"), "record",
        F.posexplode(F.transform(starts, lambda i: F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))).alias("chunk_no", "chunk"),
    )


def record_head(page_id: int | None, url: str, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """The WARC header and the HTTP header of one record, up to its payload."""
    http = CRLF.join(
        [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % n_bytes, b"", b""]
    )
    url = "".join(c for c in url if c > " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (n_bytes if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return "\r\n".join(lines).encode() + CRLF + CRLF + http


class Counted(io.RawIOBase):
    """A writable stream that counts and hashes what it passes on."""

    def __init__(self, out):
        self.out, self.n, self.sha = out, 0, hashlib.sha1()

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.out.write(b)
        self.sha.update(b)
        self.n += len(b)
        return len(b)


class Archive:
    """One archive file while it is written."""

    def __init__(self, store, base: str, chunk_bytes: int):
        import uuid

        self.store, self.base = store, base
        self.part = f"{base}/_part-{uuid.uuid4().hex}"
        self.raw = store.open_output_stream(self.part)
        self.out, self.n, self.member, self.digest, self.sha = Counted(self.raw), 0, None, "", None

    def begin(self, head: bytes, digest: str | None) -> None:
        """A record; ``digest``: what its chunks must have together, None for a revisit."""
        self.member = gzip.GzipFile(fileobj=self.out, mode="wb", compresslevel=1, mtime=0)
        self.member.write(head)
        self.digest, self.sha, self.n = digest, hashlib.sha1(), self.n + 1

    def chunk(self, data: memoryview) -> None:
        self.sha.update(data)
        self.member.write(data)

    def end(self) -> None:
        if self.digest is not None and self.sha.hexdigest() != self.digest:
            raise ValueError("the chunks of a record do not have its digest")
        self.member.write(CRLF + CRLF)
        self.member.close()

    def close(self, place: str) -> tuple[str, int, int]:
        """(name, records, bytes) of the file under its lasting name."""
        self.raw.close()
        name = f"{self.base}/{place}-{self.out.sha.hexdigest()}.warc.gz"
        self.store.move(self.part, name)
        return name, self.n, self.out.n


def write_warc(pages: DataFrame, folder: str, revisit_bytes: int = 1000, archive_bytes: int = 128 << 20, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; their manifest.

    Chunks move once, dealt by key and digest, so groups of equal payloads are spread.
    Rows without key are written where they lie.
    """
    types = record_types(pages, revisit_bytes)
    chunks = chunk_table(pages, chunk_bytes)
    keyed = chunks.where("page_id IS NOT NULL").join(types.hint("merge"), ["page_id", "digest"], "left").sortWithinPartitions("page_id", "digest", "record", "chunk_no")
    columns = ["page_id", "url", "digest", "n_bytes", "refers_to", "record", "chunk_no", F.when(F.col("refers_to").isNull(), F.col("chunk")).alias("chunk")]
    unkeyed = chunks.where("page_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        task, done, archive = TaskContext.get().partitionId(), [], None
        for batch in batches:
            ids, urls, digests, sizes, refs, _, numbers = (batch.column(i).to_pylist() for i in range(7))
            payloads = batch.column(7)
            for i, number in enumerate(numbers):
                if number == 0:
                    if archive is not None:
                        archive.end()
                        if archive.out.n >= archive_bytes:
                            done.append(archive.close(f"{task:06d}-{len(done):04d}"))
                            archive = None
                    if archive is None:
                        archive = Archive(store, base, chunk_bytes)
                    archive.begin(record_head(ids[i], urls[i], digests[i], sizes[i], refs[i]), digests[i] if refs[i] is None else None)
                if refs[i] is None and (body := payloads[i].as_buffer()).size:
                    archive.chunk(memoryview(body))
        if archive is not None:
            archive.end()
            done.append(archive.close(f"{task:06d}-{len(done):04d}"))
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["archive", "n_records", "n_bytes"])

    # One row an archive; names are made of the partition, so both parts of a union differ.
    return materialize(keyed.select(*columns).union(unkeyed.select(*columns)).mapInArrow(write, MANIFEST))


class Inflated:
    """The bytes of a stream of gzip members (or of a plain file), a piece at a time."""

    def __init__(self, raw, piece: int = 1 << 18):
        self.raw, self.piece, self.held = raw, piece, b""
        self.pending = raw.read(piece)
        self.packed = self.pending[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        """Read on; False at the end."""
        while True:
            if not self.pending:
                self.pending = self.raw.read(self.piece)
            if not self.pending:
                return False
            if not self.packed:
                self.held, self.pending = self.held + self.pending, b""
                return True
            got = self.inflate.decompress(self.pending, self.piece)
            self.pending = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.pending = self.inflate.unused_data or self.pending
                self.inflate = zlib.decompressobj(31)
            if got:
                self.held += got
                return True

    def head(self) -> bytes | None:
        """Up to and without the next empty line; None at the end."""
        while (at := self.held.find(CRLF + CRLF)) < 0:
            if not self.more():
                return None
        got, self.held = self.held[:at], self.held[at + 4 :]
        return got

    def take(self, n: int) -> bytes:
        """At most ``n`` bytes, fewer as they come."""
        if not self.held and not self.more():
            raise EOFError("an archive ends inside a record")
        got, self.held = self.held[:n], self.held[n:]
        return got

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.take(n))


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a header block, names in lower case."""
    pairs = (line.split(b":", 1) for line in head.split(CRLF)[1:] if b":" in line)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in pairs}


def chunk_rows(raw, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """The chunk rows of one archive, in order; memory is one chunk."""
    stream = Inflated(raw)
    while (head := stream.head()) is not None:
        warc = fields(head.lstrip(CRLF))
        block = int(warc["content-length"])
        http_head = stream.head() or b""
        http, left = fields(http_head), block - len(http_head) - 4
        ref = warc.get("warc-refers-to")
        named = warc["warc-record-id"].rpartition(":")[2].rstrip(">")
        key = (int(named) if named else None, warc.get("warc-target-uri"), warc["warc-type"], int(ref.rpartition(":")[2].rstrip(">")) if ref else None, warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]))
        sha, so_far, number = hashlib.sha1(), 0, 0
        while True:
            want, got = min(chunk_bytes, left), []
            while want:
                piece = stream.take(want)
                sha.update(piece)
                want, so_far = want - len(piece), so_far + len(piece)
                if with_data:
                    got.append(piece)
            left = left - min(chunk_bytes, left)
            yield (*key, number, b"".join(got) if with_data else None, so_far, sha.hexdigest(), not left)
            number += 1
            if not left:
                break
        stream.skip(4)


def read_warc(spark: SparkSession, manifest: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """The chunk rows of all archives of a manifest, by as many tasks as there are archives."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("is_last", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = filesystem(path)
                rows, held = [], 0
                with store.open_input_stream(inner, compression=None) as raw:
                    for row in chunk_rows(raw, chunk_bytes, with_data):
                        rows.append(row)
                        held += 400 + len(row[7] or b"")
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # A number of its own keeps Spark from merging the tiny partitions of names.
    return manifest.select("archive").repartition(max(1, manifest.count()), "archive").mapInArrow(read, CHUNKS)


def warc_round_trip(pages: DataFrame, revisit_bytes: int = 1000, archive_bytes: int = 128 << 20, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Write archives of ``pages`` in the shared folder and describe every record from what is read back."""
    spark, folder = pages.sparkSession, shared_dir(pages.sparkSession)
    manifest = write_warc(pages, folder, revisit_bytes, archive_bytes, chunk_bytes)
    last = read_warc(spark, manifest, chunk_bytes, with_data=False).where("is_last")
    revisit = F.col("record_type") == "revisit"
    # Written, so that the archives can go.
    records = materialize(
        last.select(
            "page_id",
            F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
            F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )
    discard(manifest)
    delete_folder(spark, folder)
    return records

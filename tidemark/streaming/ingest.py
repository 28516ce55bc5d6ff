"""Incremental ingest: batches of a stream are written over the versioned store.

Rows keep their sequence numbers, so late rows need no watermark and a batch that is
delivered again changes nothing. The keys that a batch changes, and the first day of
each, go to a callback, which recomputes what is derived from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.versioned import VersionedStore


def upsert_batch(batch: DataFrame, store_path: str, order: str = "seq") -> DataFrame:
    """Write one batch over the store at ``store_path``; (user_id, metric_key, first_day) of what it changed."""
    return VersionedStore(batch.sparkSession, store_path).upsert(batch, order)


def start(stream: DataFrame, store_path: str, checkpoint: str, changed: Callable[[DataFrame], None] | None = None, order: str = "seq", keep: int = 2) -> StreamingQuery:
    """Run the ingest over what there is (call again, or give a trigger, to go on); ``keep`` manifests stay readable."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            keys = upsert_batch(batch, store_path, order)
            if changed:
                changed(keys)
            VersionedStore(batch.sparkSession, store_path).vacuum(keep)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

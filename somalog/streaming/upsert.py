"""Micro-batches of log records into the month store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from somalog.sources import store


def upsert(records: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """A stream of (raw, place) whose batches are merged into the store at root, each as `save`
    merges it. A batch that is run again changes nothing, as its rows are stored already."""

    def merge_batch(batch: DataFrame, _: int) -> None:
        store.save(batch.sparkSession, root, batch)

    return records.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)

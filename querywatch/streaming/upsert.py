"""Streams of observations into the store of executions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from querywatch.sources.store import write_executions


def upsert_stream(observations: DataFrame, path: str) -> DataStreamWriter:
    """A writer that folds each batch into the store at ``path`` (columns as ``store.write_executions`` takes them, with date_part).

    The store reads history again for every day that a batch touches, so a late observation is merged whenever it comes: there is no
    watermark here. A batch that is replayed after a restart changes nothing. Give the writer a checkpoint of its own and start it.
    """

    def fold(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_executions(batch, path, number)

    return observations.writeStream.foreachBatch(fold)

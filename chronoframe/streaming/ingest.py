"""Incremental ingest: new files or rows are taken in once, by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.media import accepted
from ..sources.store import VectorStore


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of accepted files with their contents."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).where(accepted("path"))


def into_store(rows: DataFrame, store: VectorStore, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends a stream's rows to the vector table. A batch that runs again adds nothing: the table knows the last one.

    The checkpoint's path names the stream.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.append(prepare(batch) if prepare else batch, batch=(checkpoint, number))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

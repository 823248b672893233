"""Structured Streaming ingest: files of texts become chunks of a collection, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, need_chunks: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """`stream`: (item_id, text[, metadata]). A batch that is run again replaces its own chunks, since chunk ids follow from items."""

    def add(batch: DataFrame, _: int) -> None:
        collection.add(batch, need_chunks=need_chunks)
        collection.save()

    return stream.withColumn("item_id", F.col("item_id").cast("string")).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

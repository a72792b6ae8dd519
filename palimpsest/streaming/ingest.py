"""Streams of mutations: into a store, and as a live view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.plans.store import Store


def into(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append each micro-batch to ``store``; a batch that is run again is recognised by its id, so each counts once."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: store.append(batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest(stream: DataFrame) -> DataFrame:
    """(key, seq, value, expiry_ms): the newest version per key as a streaming aggregate (update or complete mode).

    ``seq`` decides, not arrival, so late rows do no harm. Expiry is an absolute time and is judged on read, never by state timeouts.
    """
    return stream.groupBy("key").agg(F.max_by(F.struct("seq", "value", "expiry_ms"), "seq").alias("r")).select("key", "r.*")

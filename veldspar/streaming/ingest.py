"""Structured Streaming on top of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True):
    """Upsert each micro-batch: of repeated ids in a batch the highest revision counts. Replays of a batch change nothing."""

    def one(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "revision").alias("r")).select("r.*")
        store.refresh().ingest(newest)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, size: str, late: str, ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling window and key; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")

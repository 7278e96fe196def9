"""Streaming results into the upsert table, and windowed accuracy over late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.results import correct
from ..sources.sinks import upsert


def upsert_stream(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the runs (model, condition) that it holds."""
    write = lambda batch, _: upsert(batch.sparkSession, batch, path) if not batch.isEmpty() else None
    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_accuracy(results: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Accuracy per event-time window and model; rows later than the watermark are left out."""
    return results.withWatermark(time, late).groupBy(F.window(time, width), "model").agg(F.count_if(correct()).alias("k"), F.count("*").alias("n"))

"""Relation support of a stream of events, and metrics after each micro-batch. An extra: the batch engine does not need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean, is_placeholder
from ..plans.pipeline import relations_to_metrics


def cleaned(events: DataFrame) -> DataFrame:
    """The steps of cleaning that need one row at a time."""
    for c in ("activity", "object_type"):
        events = events.where(F.col(c).isNotNull() & ~is_placeholder(F.col(c))).withColumn(c, clean(F.col(c)))
    return events


def deduplicated(events: DataFrame, time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """One row per (model, activity, object_type, event_id) within the watermark; state older than it is dropped."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["model", "activity", "object_type", "event_id"])


def support(events: DataFrame) -> DataFrame:
    """Running (model, activity, object_type, support); the state holds a count per pair, not events."""
    return events.groupBy("model", "activity", "object_type").agg(F.count(F.lit(1)).alias("support"))


def windowed_support(events: DataFrame, width: str = "1 day", time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Support per window of event time; late rows beyond the watermark are dropped."""
    w = F.window(time, width).alias("window")
    return events.withWatermark(time, lateness).groupBy(w, "model", "activity", "object_type").agg(F.count(F.lit(1)).alias("support"))


def start_metrics(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, min_support: int = 1) -> StreamingQuery:
    """Calls ``sink(metrics, batch_id)`` with the metrics of all relations so far after each micro-batch (complete mode)."""

    def measure(batch: DataFrame, batch_id: int) -> None:
        sink(relations_to_metrics(batch.where(F.col("support") >= min_support)), batch_id)

    return support(cleaned(events)).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(measure).start()

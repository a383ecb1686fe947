"""Streaming aggregates that need no rebuild: running totals, minutes, approximate Gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gold import hourly_sketch
from ..operators.snapshot import live_snapshot
from ..sinks.writers import write_document


def running_breakdown(silver: DataFrame, keys: list[str]) -> DataFrame:
    """Packets and bytes per key since the start; use output mode update or complete."""
    return silver.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))


def minute_volumes(silver: DataFrame, key: str, history: str = "60 minutes") -> DataFrame:
    """Bytes per minute and key. The watermark lets minutes older than ``history`` leave the state."""
    return (
        silver.withWatermark("event_ts", history)
        .groupBy(F.window("event_ts", "1 minute"), key)
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))
        .select(F.col("window.start").alias("minute"), key, "packets", "bytes")
    )


def sketch_partials(silver: DataFrame) -> DataFrame:
    """Approximate hourly rows as mergeable sketches, for output mode update."""
    return hourly_sketch(silver)


def publish_snapshot(silver: DataFrame, path: str, **options) -> None:
    """Writes the live document from the stored tables; call it from a batch hook."""
    write_document(live_snapshot(silver, **options), path)

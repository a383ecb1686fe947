"""The live document from mergeable partial rows instead of all packets.

Every batch of Silver rows leaves counts of each breakdown, bytes per minute of each dimension, totals, and its last
packets. Counts add up, so the top lists of the merged rows are exact. Rows grow with distinct keys, not with packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions.timestamps import as_instant
from . import search, snapshot as snapshots, traffic, windows

PARTIAL = (
    "kind string, name string, protocol string, minute timestamp, packets long, bytes long, started_at timestamp"
)
RECENT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SILVER.fields)
_TOTAL, _WINDOW = "total", "window:"
_KEYS = ["kind", "name", "protocol", "minute"]


def partials(silver: DataFrame) -> DataFrame:
    """Partial rows of a batch. ``kind`` is a breakdown, ``window:`` and a dimension, or ``total``."""
    none = F.lit(None)
    counted = traffic.breakdown_counts(silver).select(
        F.col("breakdown").alias("kind"), "name", "protocol", none.cast("timestamp").alias("minute"), "packets", "bytes",
        none.cast("timestamp").alias("started_at"),
    )
    minutes = windows.minute_buckets(silver).select(
        F.concat(F.lit(_WINDOW), "dimension").alias("kind"), "name", none.cast("string").alias("protocol"), "minute",
        "packets", "bytes", none.cast("timestamp").alias("started_at"),
    )
    total = traffic.totals(silver).select(
        F.lit(_TOTAL).alias("kind"), none.cast("string").alias("name"), none.cast("string").alias("protocol"),
        none.cast("timestamp").alias("minute"), "packets", "bytes", "started_at",
    )
    return counted.unionByName(minutes).unionByName(total)


def merge(rows: DataFrame) -> DataFrame:
    """One row per key. Combined on the map side, so a key that all batches share is no hot one."""
    return rows.groupBy(*_KEYS).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("started_at").alias("started_at")
    )


def without_old_minutes(rows: DataFrame, as_of=None) -> DataFrame:
    """Drops the minutes that no window reaches any more, 60 minutes before ``as_of`` (default: the newest minute)."""
    span = max(C.WINDOW_MINUTES.values()) * 60_000_000
    newest = rows.agg(F.max("minute")).scalar() if as_of is None else as_instant(as_of)
    old = F.unix_micros(newest) - F.unix_micros("minute") > span
    return rows.where(F.col("minute").isNull() | ~F.coalesce(old, F.lit(False)))


def merge_recent(rows: DataFrame, arrival: str = "ingested_at") -> DataFrame:
    """The last packets of all batches."""
    return search.recent_packets(rows, arrival)


def snapshot(
    state: DataFrame,
    recent: DataFrame,
    gold: DataFrame | None = None,
    counters: DataFrame | None = None,
    as_of=None,
    arrival: str = "ingested_at",
    anonymize: bool = False,
) -> DataFrame:
    """The live document, field by field as ``snapshot.live_snapshot`` makes it from all packets."""
    merged = merge(state)
    minutes = windows.rank_windows(
        without_old_minutes(state.where(F.col("kind").startswith(_WINDOW)), as_of).withColumn(
            "dimension", F.substr("kind", F.lit(len(_WINDOW) + 1))
        ), as_of,
    )
    counts = merged.where(F.col("kind").isin(*traffic.BREAKDOWNS)).withColumnRenamed("kind", "breakdown")
    return snapshots.assemble(
        state.where(F.col("kind") == _TOTAL), traffic.rank_breakdowns(counts), minutes, merge_recent(recent, arrival),
        gold, counters, as_of, arrival, anonymize,
    )

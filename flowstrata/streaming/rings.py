"""Bounded rings of a stream: the last 60 minutes of volumes and the last samples of each latency stage.

A batch leaves partial rows which are cut to the ring's bound before they are written; ``fold`` cuts the rows of all
batches again, so what is stored stays within the bound per key however long the stream runs. No keyed operator state is
held in executors, so a hot protocol or stage is no hot task: a batch is combined on the map side first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators import metrics, windows
from .pipeline import _query_id
from .state import BatchState


@dataclass(frozen=True)
class Ring:
    """``state`` holds the rows; ``rows_of`` makes a batch's rows."""

    state: BatchState
    rows_of: Callable[[DataFrame], DataFrame]

    def write(self, batch: DataFrame, batch_id: int, query: str | None = None) -> None:
        """Replaces the rows of one batch, so that a retry changes nothing."""
        rows = self.state.merge(self.rows_of(batch))
        self.state.write(rows, query or _query_id(batch.sparkSession), batch_id)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.state.merge(self.state.read(spark))

    def start(self, stream: DataFrame, checkpoint: str, fold_every: int = 60, **trigger) -> StreamingQuery:
        """Starts the query (by default until the input is used up); every ``fold_every`` batches the rows are folded."""

        def hook(batch: DataFrame, batch_id: int) -> None:
            query = _query_id(batch.sparkSession)
            self.write(batch, batch_id, query)
            if batch_id and batch_id % fold_every == 0:
                # Batches before this one are done; this one may still be tried again.
                self.state.fold(batch.sparkSession, {query: batch_id - 1})

        return (
            stream.writeStream.foreachBatch(hook)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def _recent_minutes(rows: DataFrame) -> DataFrame:
    """One row per minute and name; minutes that no window of the newest event reaches are dropped."""
    span = max(C.WINDOW_MINUTES.values()) * 60_000_000
    newest = F.unix_micros(rows.agg(F.max("newest")).scalar())
    kept = rows.where(newest - F.unix_micros("minute") <= span)
    return kept.groupBy("minute", "dimension", "name").agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.max("newest").alias("newest")
    )


def minute_ring(path: str) -> Ring:
    """Volumes per minute, dimension and name of the 60 minutes before the newest event, from Silver rows.

    Every row has a protocol bucket, be it of null, so the buckets' newest event is the stream's.
    """
    schema = "minute timestamp, dimension string, name string, packets long, bytes long, newest timestamp"
    return Ring(BatchState(path, schema, _recent_minutes), lambda silver: windows.minute_buckets(silver, newest=True))


def trailing_windows(spark: SparkSession, ring: Ring, as_of=None, limit: int = C.TOP_N) -> DataFrame:
    """``windows.trailing_windows`` of all that the stream has seen, as of the newest event by default."""
    rows = ring.state.read(spark)
    moment = rows.agg(F.max("newest")).scalar() if as_of is None else as_of
    return windows.rank_windows(rows, moment, limit)


def latency_ring(path: str, keep: int = C.LATENCY_SAMPLES) -> Ring:
    """The last ``keep`` samples of each known stage, from ``stage, us, ts, seq``."""

    def newest(rows: DataFrame) -> DataFrame:
        return metrics.newest_samples(rows, keep, ["ts", "seq", "us"])

    def known(batch: DataFrame) -> DataFrame:
        return batch.where(F.col("stage").isin(C.LATENCY_STAGES)).select(
            "stage", F.col("us").cast("double").alias("us"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("seq").cast("bigint").alias("seq"),
        )

    return Ring(BatchState(path, "stage string, us double, ts timestamp, seq long", newest), known)


def latency_percentiles(spark: SparkSession, ring: Ring, keep: int = C.LATENCY_SAMPLES) -> DataFrame:
    """p50, p95 and p99 per stage over the last samples of the stream."""
    rows = ring.state.read(spark).withColumn("at", F.struct("ts", "seq", "us"))
    return metrics.latency_percentiles(rows, keep, order="at")

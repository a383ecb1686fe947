"""One streaming query that fills every layer: Bronze, quarantine, Silver, Gold, the live document and the metrics.

A batch is validated once and then written layer by layer. Each write replaces what the same batch of the same query
has written before, and the batch's clock is fixed in a note before its first write. So a batch that dies between two
layers is made good by its retry, whatever layer it had reached. Documents are made from partial rows (``state``), never
from stored packets; every ``fold_every`` batches the partial rows of all batches that are done are folded.
"""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators import gold as gold_ops
from ..operators import health_state, live_state, metrics
from ..operators.silver import to_silver
from ..operators.validation import accepted, quarantine_rows, validate_json
from ..sinks.writers import batch_clock, overwrite_partitions, write_bronze_batch, write_document
from . import pipeline
from .state import BATCH, QUERY, BatchState


@dataclass(frozen=True)
class Layers(pipeline.Layout):
    """Where all layers live. ``fold_every``: batches between two folds of the partial rows; ``publish_every``: batches
    between two versions of the documents. 0 is never."""

    fold_every: int = 50
    publish_every: int = 1
    agent_id: str = ""

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def snapshot(self) -> str:
        return f"{self.root}/live"

    @property
    def metrics(self) -> str:
        return f"{self.root}/metrics"

    @property
    def live_state(self) -> BatchState:
        merge = lambda rows: live_state.merge(live_state.without_old_minutes(rows))
        return BatchState(f"{self.root}/live_state", live_state.PARTIAL, merge)

    @property
    def recent_state(self) -> BatchState:
        return BatchState(f"{self.root}/recent_state", live_state.RECENT, live_state.merge_recent)

    @property
    def health_state(self) -> BatchState:
        return BatchState(f"{self.root}/health_state", health_state.ROWS, health_state.merge)

    @property
    def states(self) -> list[BatchState]:
        return [pipeline.gold_state(self), self.live_state, self.recent_state, self.health_state]


class _Batch:
    """One batch on its way through the layers; each method is a layer that can be written again."""

    def __init__(self, checked: DataFrame, raw: str, layout: Layers, query: str, batch: int, as_of: dt.datetime):
        self.spark, self.checked, self.raw, self.layout = checked.sparkSession, checked, raw, layout
        self.query, self.batch, self.as_of = query, batch, as_of
        # Six scans read them; clocks and networks are worked out in the first.
        self.silver_rows = to_silver(accepted(checked), as_of=as_of).persist(StorageLevel.MEMORY_AND_DISK)

    def bronze(self) -> None:
        records = accepted(self.checked)
        write_bronze_batch(records, self.layout.bronze, self.query, self.batch, self.as_of,
                           manifest_path=self.layout.manifest, agent_id=self.layout.agent_id)

    def quarantine(self) -> None:
        bad = quarantine_rows(self.checked, raw=F.col(self.raw), as_of=self.as_of)
        named = bad.withColumns({QUERY: F.lit(self.query), BATCH: F.lit(self.batch)})
        writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(QUERY, BATCH).json(self.layout.quarantine)

    def silver(self) -> None:
        stored = pipeline.with_partitions(self.silver_rows, self.layout)
        named = stored.withColumns({QUERY: F.lit(self.query), BATCH: F.lit(self.batch)})
        overwrite_partitions(named, self.layout.silver, [*self.layout.keys, QUERY, BATCH])

    def gold(self) -> None:
        pipeline.gold_state(self.layout).write(gold_ops.partials(self.silver_rows), self.query, self.batch)

    def live(self) -> None:
        self.layout.live_state.write(live_state.partials(self.silver_rows), self.query, self.batch)
        self.layout.recent_state.write(live_state.merge_recent(self.silver_rows), self.query, self.batch)

    def health(self, took: dict[str, float]) -> None:
        counts = metrics.stage_counters(self.checked).withColumns({
            "parsed": F.col("captured"), "queued": F.col("captured"), "dropped": F.lit(0)})
        stages = {"queue_to_bronze": ("bronze",), "bronze_to_silver": ("silver",), "silver_to_gold": ("gold", "live")}
        samples = [(stage, sum(took[s] for s in steps) * 1e6, self.as_of) for stage, steps in stages.items()]
        bad = quarantine_rows(self.checked, raw=F.col(self.raw)).select(
            F.lit(self.as_of).alias("ts"), F.lit("validation").alias("component"), F.col("reason").alias("error"))
        newest = bad.orderBy("error").limit(C.RECENT_ERRORS)
        passed = accepted(self.checked).withColumn("ts", F.lit(self.as_of))
        rows = (
            health_state.counter_rows(counts)
            .unionByName(health_state.flush_rows(self.spark, ("silver", "gold", "snapshot")))
            .unionByName(health_state.latency_rows(self.spark.createDataFrame(samples, "stage string, us double, ts timestamp")))
            .unionByName(health_state.error_rows(newest))
            .unionByName(health_state.rate_rows(passed))
        )
        self.layout.health_state.write(rows, self.query, self.batch)

    def documents(self, counters: DataFrame | None) -> None:
        write_document(snapshot_row(self.spark, self.layout, self.as_of, counters), self.layout.snapshot)
        write_document(metrics_row(self.spark, self.layout, self.as_of), self.layout.metrics)


STEPS = ("bronze", "quarantine", "silver", "gold", "live")


def process_batch(lines: DataFrame, batch_id: int, layout: Layers, raw: str = "value", query_id: str | None = None,
                  counters: DataFrame | None = None) -> None:
    """One micro-batch through all layers."""
    spark = lines.sparkSession
    query = query_id or pipeline._query_id(spark)
    as_of = batch_clock(spark, f"{layout.root}/_batches/{query}", batch_id)
    checked = validate_json(lines, raw).drop("_rescued_data").persist(StorageLevel.MEMORY_AND_DISK)
    batch, took = _Batch(checked, raw, layout, query, batch_id, as_of), {}
    try:
        for step in STEPS:
            began = time.monotonic()
            getattr(batch, step)()
            took[step] = time.monotonic() - began
        batch.health(took)
        if layout.publish_every and batch_id % layout.publish_every == 0:
            batch.documents(counters)
    finally:
        batch.silver_rows.unpersist()
        checked.unpersist()
    if layout.fold_every and batch_id and batch_id % layout.fold_every == 0:
        # The checkpoint may not have this batch yet, so only those before it are done.
        fold(spark, layout, {query: batch_id - 1})


def fold(spark: SparkSession, layout: Layers, through: dict[str, int]) -> None:
    """Folds the partial rows of all states, up to the given batch of each query."""
    for state in layout.states:
        state.fold(spark, through)


def snapshot_row(spark: SparkSession, layout: Layers, as_of=None, counters: DataFrame | None = None,
                 anonymize: bool = False) -> DataFrame:
    """The live document as of all batches so far."""
    return live_state.snapshot(
        layout.live_state.read(spark), layout.recent_state.read(spark), pipeline.gold_table(spark, layout), counters, as_of,
        anonymize=anonymize,
    )


def metrics_row(spark: SparkSession, layout: Layers, as_of=None) -> DataFrame:
    """The metrics document as of all batches so far; the run starts with the first Silver row."""
    total = live_state.merge(layout.live_state.read(spark).where("kind = 'total'"))
    started = total.agg(F.min("started_at")).scalar()
    return health_state.document(layout.health_state.read(spark), as_of, started)


def start(lines: DataFrame, layout: Layers, raw: str = "value", counters: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Starts the query; by default it runs until the input is used up."""
    write = partial(process_batch, layout=layout, raw=raw, counters=counters)
    return (
        lines.writeStream.foreachBatch(lambda batch, batch_id: write(batch, batch_id))
        .option("checkpointLocation", layout.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

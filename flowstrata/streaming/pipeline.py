"""Bronze lines to Silver, quarantine and exact Gold as one streaming query.

Each micro-batch writes Silver, quarantined lines and partial Gold rows, all
below partitions named by the query's id and the batch's number. The writes
replace whole partitions, so a batch that is tried again changes nothing, and
another query on the same tables never overwrites them. Gold is the aggregate
of all partial rows: late rows add to an old hour however long Silver is kept,
and no batch reads what earlier ones have stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import files, schemas
from ..operators import gold as gold_ops
from ..operators import metrics
from ..operators.silver import to_silver
from ..operators.validation import accepted, quarantine_rows, validate_json
from ..sinks.writers import overwrite_partitions
from ..sources.tables import read_silver
from .state import BATCH, QUERY, BatchState

_BATCH = [QUERY, BATCH]


@dataclass(frozen=True)
class Layout:
    """Where the layers of one pipeline live, and how finely they are partitioned.

    By ``date`` there are fewer partitions, which suits thin data spread over many
    hours. ``stream`` names the checkpoint; several streams may fill one layout.
    """

    root: str
    grain: str = "hour"
    stream: str = "medallion"

    @property
    def keys(self) -> list[str]:
        return {"hour": ["event_date", "event_hr"], "date": ["event_date"]}[self.grain]

    @property
    def silver(self) -> str:
        return f"{self.root}/silver"

    @property
    def gold(self) -> str:
        return f"{self.root}/gold"

    @property
    def gold_state(self) -> str:
        return f"{self.root}/gold_state"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/_checkpoints/{self.stream}"


def with_partitions(df: DataFrame, layout: Layout) -> DataFrame:
    """Adds ``event_hr``, the UTC hour of ``event_hour``, where the layout has it.

    It follows from the Gold key, so every key lies in exactly one partition.
    """
    return df.withColumn("event_hr", F.hour("event_hour")) if "event_hr" in layout.keys else df


def gold_state(layout: Layout) -> BatchState:
    """Partial Gold rows of all batches."""
    return BatchState(layout.gold_state, gold_ops.PARTIAL, gold_ops.fold_partials, ("event_date",))


def fold_gold(spark: SparkSession, layout: Layout, through: dict[str, int]) -> None:
    """Folds the partial Gold rows of all batches up to the given one of each query (the id its checkpoint keeps).

    Afterwards there is one row per Gold key and one per distinct value, however many batches there were.
    """
    gold_state(layout).fold(spark, through)


def _query_id(spark: SparkSession) -> str:
    """The id of the running streaming query, which its checkpoint keeps; ``direct`` outside of one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def process_batch(
    lines: DataFrame, batch_id: int, layout: Layout, raw: str = "value", query_id: str | None = None
) -> None:
    """One micro-batch through all layers."""
    query = query_id or _query_id(lines.sparkSession)
    named = {QUERY: F.lit(query), BATCH: F.lit(batch_id)}
    checked = validate_json(lines, raw).drop("_rescued_data").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        silver = to_silver(accepted(checked))
        stored = with_partitions(silver, layout).withColumns(named)
        overwrite_partitions(stored, layout.silver, [*layout.keys, *_BATCH])
        # One directory per batch, whatever the date, so that a retry after midnight replaces it.
        bad = quarantine_rows(checked, raw=F.col(raw)).withColumns(named)
        (
            bad.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_BATCH)
            .json(layout.quarantine)
        )
        gold_state(layout).write(gold_ops.partials(silver), query, batch_id)
    finally:
        checked.unpersist()


def start(
    lines: DataFrame,
    layout: Layout,
    raw: str = "value",
    metric_name: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Starts the query; by default it runs until the input is used up.

    With ``metric_name`` the stage counts of every batch are reported under
    that name in the query progress.
    """
    source = lines
    if metric_name is not None:
        counted = metrics.observe_stages(validate_json(lines, raw), metric_name)
        source = counted.select(*lines.columns)
    return (
        source.writeStream.foreachBatch(lambda batch, batch_id: process_batch(batch, batch_id, layout, raw))
        .option("checkpointLocation", layout.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_available(lines: DataFrame, layout: Layout, **options) -> None:
    """Processes everything that is there, then stops."""
    start(lines, layout, **options).awaitTermination()


def silver_table(spark: SparkSession, layout: Layout) -> DataFrame:
    return read_silver(spark, layout.silver)


def gold_table(spark: SparkSession, layout: Layout) -> DataFrame:
    """Gold as of all batches so far."""
    return gold_ops.merge_partials(gold_state(layout).read(spark))


def publish_gold(spark: SparkSession, layout: Layout, since=None) -> None:
    """Stores Gold as a plain table, replacing its dates (from ``since`` on); for readers of many queries."""
    gold = gold_table(spark, layout)
    gold = gold if since is None else gold.where(F.col("event_date") >= F.lit(since).cast("date"))
    overwrite_partitions(with_partitions(gold, layout), layout.gold, layout.keys)


def quarantine_table(spark: SparkSession, layout: Layout) -> DataFrame:
    if not files.exists(spark, layout.quarantine):
        return spark.createDataFrame([], schemas.QUARANTINE)
    return spark.read.schema(schemas.QUARANTINE).json(layout.quarantine)

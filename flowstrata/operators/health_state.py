"""The metrics document from rows that every batch leaves: counters, latency samples, errors and rates.

All of them are rows of one shape, so that one table holds them and one aggregate folds them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.timestamps import as_instant, iso_text, seconds_between
from . import metrics

ROWS = "kind string, name string, text string, value double, ts timestamp, n long, seq long"
COUNTERS = [
    "captured", "parsed", "queued", "dropped", "processed", "validation_errors", "silver_records", "silver_flushes",
    "gold_flushes", "snapshot_flushes",
]
_SECOND = "processed"


def _shaped(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    types = dict(part.split(" ") for part in ROWS.split(", "))
    given = {"kind": F.lit(kind)} | columns
    return rows.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def counter_rows(counts: DataFrame) -> DataFrame:
    """One row per counter from a one-row table of counts; unknown columns are left out, null counts are 0."""
    known = [F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias("n"))
             for c in counts.columns if c in COUNTERS]
    return _shaped(counts.select(F.inline(F.array(*known))), "counter", name=F.col("name"), n=F.col("n"))


def flush_rows(spark: SparkSession, layers: Iterable[str]) -> DataFrame:
    """One finished write of each layer (``silver``, ``gold``, ``snapshot``)."""
    names = spark.createDataFrame([(f"{layer}_flushes",) for layer in layers], "name string")
    return _shaped(names, "counter", name=F.col("name"), n=F.lit(1))


def latency_rows(samples: DataFrame, ts: str = "ts", seq: str | None = None) -> DataFrame:
    """From ``stage, us`` and the time; ``seq`` settles the order of samples of the same time."""
    known = samples.where(F.col("stage").isin(C.LATENCY_STAGES))
    return _shaped(known, "latency", name=F.col("stage"), value=F.col("us"), ts=F.col(ts), seq=F.lit(0) if seq is None else F.col(seq))


def error_rows(errors: DataFrame, seq: str | None = None) -> DataFrame:
    """From ``ts, component, error``."""
    return _shaped(errors, "error", name=F.col("component"), text=F.col("error"), ts=F.col("ts"),
                   seq=F.lit(0) if seq is None else F.col(seq))


def rate_rows(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Processed packets per millisecond: few rows however many packets, fine enough for a window of seconds."""
    moment = F.date_trunc("millisecond", ts)
    counted = events.where(F.col(ts).isNotNull()).groupBy(moment.alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return _shaped(counted, "rate", name=F.lit(_SECOND), ts=F.col("ts"), n=F.col("n"))


def gauge_rows(samples: DataFrame, ts: str = "ts", seq: str | None = None) -> DataFrame:
    """From ``gauge, value`` and the time; null readings are none."""
    read = samples.where(F.col("value").isNotNull())
    return _shaped(read, "gauge", name=F.col("gauge"), n=F.col("value"), ts=F.col(ts), seq=F.lit(0) if seq is None else F.col(seq))


def _newest(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("seq"), F.desc("value"), F.desc("n"), F.asc("name"), F.asc("text"))
    # The rank is cut before the shuffle too: ``keep`` rows of each group leave a task.
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def merge(rows: DataFrame) -> DataFrame:
    """Folds rows: sums of counters, the newest samples, errors and readings, and the rates of the last seconds."""
    kind = F.col("kind")
    sums = rows.where(kind == "counter").groupBy("name").agg(F.sum("n").alias("n"))
    rates = rows.where(kind == "rate")
    last = F.unix_micros(rates.agg(F.max("ts")).scalar()) - C.RATE_WINDOW_SECONDS * 1_000_000
    recent = rates.where(F.unix_micros("ts") >= last).groupBy("name", "ts").agg(F.sum("n").alias("n"))
    return (
        _shaped(sums, "counter", name=F.col("name"), n=F.col("n"))
        .unionByName(_newest(rows.where(kind == "latency"), ["name"], C.LATENCY_SAMPLES))
        .unionByName(_newest(rows.where(kind == "error"), ["kind"], C.RECENT_ERRORS))
        .unionByName(_newest(rows.where(kind == "gauge"), ["name"], 1))
        .unionByName(_shaped(recent, "rate", name=F.col("name"), ts=F.col("ts"), n=F.col("n")))
    )


def document(rows: DataFrame, as_of=None, started_at=None) -> DataFrame:
    """The metrics document as one typed row, from any number of batches' rows.

    Counters that nobody counted are 0, the queue depth without a reading too; a stage without samples has no
    latencies. ``started_at`` is the start of the run (null: no uptime).
    """
    spark, kind = rows.sparkSession, F.col("kind")
    moment = as_instant(as_of)
    counters = rows.where(kind == "counter").agg(F.struct(*[
        F.coalesce(F.sum(F.when(F.col("name") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS
    ])).scalar()
    cutoff = F.timestamp_micros(F.unix_micros(moment) - C.RATE_WINDOW_SECONDS * 1_000_000)
    rate = rows.where((kind == "rate") & (F.col("ts") >= F.date_trunc("millisecond", cutoff)) & (F.col("ts") <= moment)).agg(
        F.struct(F.round(F.coalesce(F.sum("n"), F.lit(0)) / C.RATE_WINDOW_SECONDS, 1).alias("packets_per_sec"))
    ).scalar()
    depth = rows.where((kind == "gauge") & (F.col("name") == "queue_depth")).agg(
        F.coalesce(F.max_by("n", F.struct("ts", "seq")), F.lit(0)).cast("bigint")
    ).scalar()
    samples = rows.where(kind == "latency").select(F.col("name").alias("stage"), F.col("value").alias("us"), F.struct("ts", "seq").alias("at"))
    stages = metrics.latency_percentiles(samples, order="at")
    latency = stages.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("stage", F.struct("p50", "p95", "p99")))))).scalar()
    last = _newest(rows.where(kind == "error"), ["kind"], C.RECENT_ERRORS)
    entry = F.struct("ts", "seq", F.struct(iso_text(F.col("ts")).alias("ts"), F.col("name").alias("component"), F.col("text").alias("error")).alias("e"))
    errors = last.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda r: r["e"])).scalar()
    uptime = F.lit(None).cast("double") if started_at is None else F.round(seconds_between(moment, as_instant(started_at)), 1)
    return spark.range(1).select(
        iso_text(moment).alias("ts"), uptime.alias("uptime_sec"), counters.alias("counters"), rate.alias("rates"),
        depth.alias("queue_depth"), latency.alias("latency_us"), errors.alias("recent_errors"),
    )


DOCUMENT = (
    f"ts string, uptime_sec double, counters struct<{', '.join(f'{c}: bigint' for c in COUNTERS)}>, "
    "rates struct<packets_per_sec: double>, queue_depth bigint, "
    "latency_us map<string, struct<p50: double, p95: double, p99: double>>, "
    "recent_errors array<struct<ts: string, component: string, error: string>>"
)

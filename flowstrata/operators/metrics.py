"""Pipeline and capture health from counter, gauge, latency and error tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions.timestamps import as_instant, seconds_between, wall_micros


def _stage_measures() -> list[Column]:
    valid = F.col("errors") == ""
    readable = wall_micros(F.col("timestamp")).isNotNull()
    return [
        F.count(F.lit(1)).alias("captured"),
        F.count_if(valid).alias("processed"),
        F.count_if(~valid).alias("validation_errors"),
        F.count_if(valid & readable).alias("silver_records"),
    ]


def stage_counters(checked: DataFrame) -> DataFrame:
    """Counts per stage for validated records (one row, one pass)."""
    return checked.agg(*_stage_measures())


def observe_stages(checked: DataFrame, observation) -> DataFrame:
    """The same counts, collected while another action runs.

    ``observation`` is an ``Observation`` or, for streams, a metric name.
    """
    return checked.observe(observation, *_stage_measures())


_PARTS = 64


def newest_samples(samples: DataFrame, keep: int, order: list[str]) -> DataFrame:
    """The last ``keep`` rows of each stage.

    Spark cuts ranks before the shuffle only for small ``keep``. Each stage is therefore cut in parts first, dealt by
    hash of the ordering columns, so that no task sorts a whole stage and the last one gets ``64 * keep`` rows at most.
    """
    descending = [F.desc(c) for c in order]
    parted = samples.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(_PARTS)))
    for by in (["stage", "_part"], ["stage"]):
        ranked = parted.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*descending)))
        parted = ranked.where(F.col("_n") <= keep).drop("_n")
    return parted.drop("_part")


def latency_percentiles(samples: DataFrame, keep: int = C.LATENCY_SAMPLES, order: str = "ts") -> DataFrame:
    """p50/p95/p99 per stage over the last ``keep`` samples.

    The value at index ``min(floor(n * p / 100), n - 1)`` of the sorted
    samples. Only known stages count; a stage without samples has no row. One
    list never exceeds ``keep`` values.
    """
    kept = newest_samples(samples.where(F.col("stage").isin(C.LATENCY_STAGES)), keep, [order])
    ordered = kept.groupBy("stage").agg(F.sort_array(F.collect_list("us")).alias("_us"))
    size = F.size("_us")

    def at(p: int) -> Column:
        index = F.least(F.floor(size * p / 100.0).cast("int"), size - 1)
        return F.round(F.element_at("_us", index + 1), 1).alias(f"p{p}")

    return ordered.select("stage", size.cast("bigint").alias("samples"), at(50), at(95), at(99))


def throughput(events: DataFrame, as_of, ts: str = "ts", seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """Events per second over the last ``seconds``."""
    moment = as_instant(as_of)
    cutoff = F.timestamp_micros(F.unix_micros(moment) - seconds * 1_000_000)
    recent = events.where((F.col(ts) >= cutoff) & (F.col(ts) <= moment))
    return recent.agg(F.round(F.count(F.lit(1)) / seconds, 1).alias("packets_per_sec"))


def gauges(samples: DataFrame, order: str = "ts") -> DataFrame:
    """Last non-null value per gauge."""
    return samples.where(F.col("value").isNotNull()).groupBy("gauge").agg(F.max_by("value", order).alias("value"))


def drop_rate(received: Column, dropped: Column) -> Column:
    seen = received + dropped
    return F.round(F.when(seen > 0, dropped * F.lit(100.0) / seen).otherwise(0.0), 4)


def health_status(rate: Column) -> Column:
    return (
        F.when(rate <= C.HEALTH_GREEN_MAX, "green").when(rate <= C.HEALTH_YELLOW_MAX, "yellow").otherwise("red")
    )


def capture_health(counters: DataFrame) -> DataFrame:
    """Counters with drop rate and status; missing counters count as 0."""
    filled = counters.withColumns({name: F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))
                                   for name in schemas.CAPTURE_COUNTERS.fieldNames()})
    return filled.withColumn("drop_rate_pct", drop_rate(F.col("os_recv"), F.col("os_drop"))).withColumn(
        "status", health_status(F.col("drop_rate_pct"))
    )


def latest_counters(history: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """Newest non-null reading of every counter, per ``by`` (for example agent)."""
    return history.groupBy(*by).agg(*[
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name)
        for name in schemas.CAPTURE_COUNTERS.fieldNames()
    ])


def recent_errors(errors: DataFrame, limit: int = C.RECENT_ERRORS, tie_break: str = "component") -> DataFrame:
    return errors.orderBy(F.desc("ts"), F.asc(tie_break)).limit(limit)


def data_age(silver: DataFrame, as_of=None, ts: str = "ingested_at") -> DataFrame:
    """Age of the newest row in seconds, not below 0, and whether it is fresh enough.

    An empty table has no age and is not healthy.
    """
    age = F.greatest(F.lit(0.0), seconds_between(as_instant(as_of), F.max(ts)))
    return silver.agg(F.when(F.max(ts).isNotNull(), age).alias("age_sec")).withColumn(
        "healthy", F.coalesce(F.col("age_sec") <= C.SNAPSHOT_HEALTHY_SECONDS, F.lit(False))
    )


def store_stats(manifest_current: DataFrame) -> DataFrame:
    """Files, bytes and records per manifest state."""
    return manifest_current.groupBy("state").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("bytes"),
        F.sum("record_count").alias("records"),
    )

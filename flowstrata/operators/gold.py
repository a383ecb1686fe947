"""Hourly aggregates.

``hourly`` is exact. Its three distinct counts make Spark expand each row, but
every branch is combined on the map side and shuffled by (key, value), so one
hot key is spread over as many tasks as it has values. ``partials`` /
``merge_partials`` keep exact mergeable rows for tables that grow by batches,
``hourly_sketch`` / ``merge_sketches`` small ones with estimated distincts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.timestamps import as_instant


def hourly(silver: DataFrame, as_of=None) -> DataFrame:
    """One exact row per (hour, date, protocol, network, agent)."""
    total = F.sum("length")
    packets = F.count(F.lit(1))
    return (
        silver.groupBy(*schemas.GOLD_KEYS)
        .agg(
            packets.alias("packet_count"),
            total.alias("total_bytes"),
            (total.cast("double") / packets).alias("avg_packet_size"),
            F.min("event_ts").alias("first_seen"),
            F.max("event_ts").alias("last_seen"),
            F.count_distinct("src_ip").alias("unique_src_ips"),
            F.count_distinct("dst_ip").alias("unique_dst_ips"),
            F.count_distinct("dst_port").alias("unique_dst_ports"),
        )
        .withColumn("computed_at", as_instant(as_of))
        .select(*schemas.GOLD.fieldNames())
    )


_DISTINCT = {"src_ip": "src_ips", "dst_ip": "dst_ips", "dst_port": "dst_ports"}
PARTIAL = (
    "event_hour timestamp, event_date date, protocol string, src_network string, agent_id string, field string, "
    "value string, packet_count long, total_bytes long, first_seen timestamp, last_seen timestamp"
)


def partials(silver: DataFrame) -> DataFrame:
    """Exact rows that merge by plain aggregation: per Gold key one row of sums and bounds (``field`` null), and one row
    per distinct value of each counted column. Packets are combined before they are expanded."""
    combined = silver.groupBy(*schemas.GOLD_KEYS, *_DISTINCT).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("length").alias("total_bytes"),
        F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"),
    )
    fields = [F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))]
    fields += [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in _DISTINCT]
    expanded = combined.select("*", F.inline(F.array(*fields))).where("field IS NULL OR value IS NOT NULL")
    return fold_partials(expanded)


def fold_partials(rows: DataFrame) -> DataFrame:
    """Partial rows of several batches as one row per key and one per distinct value."""
    measured = F.col("field").isNull()
    return rows.groupBy(*schemas.GOLD_KEYS, "field", "value").agg(
        F.sum(F.when(measured, F.col("packet_count"))).alias("packet_count"),
        F.sum(F.when(measured, F.col("total_bytes"))).alias("total_bytes"),
        F.min(F.when(measured, F.col("first_seen"))).alias("first_seen"),
        F.max(F.when(measured, F.col("last_seen"))).alias("last_seen"),
    )


def merge_partials(state: DataFrame, as_of=None) -> DataFrame:
    """Gold rows from the partial rows of any number of batches; exact."""
    packets, total = F.sum("packet_count"), F.sum("total_bytes")
    return (
        fold_partials(state).groupBy(*schemas.GOLD_KEYS)
        .agg(
            packets.alias("packet_count"),
            total.alias("total_bytes"),
            (total.cast("double") / packets).alias("avg_packet_size"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            *[F.count_if(F.col("field") == column).alias(f"unique_{name}") for column, name in _DISTINCT.items()],
        )
        .withColumn("computed_at", as_instant(as_of))
        .select(*schemas.GOLD.fieldNames())
    )


def hourly_sketch(silver: DataFrame) -> DataFrame:
    """Mergeable partial rows: sums, bounds and one distinct sketch per column."""
    return silver.groupBy(*schemas.GOLD_KEYS).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("length").alias("total_bytes"),
        F.min("event_ts").alias("first_seen"),
        F.max("event_ts").alias("last_seen"),
        *[F.hll_sketch_agg(column).alias(f"{name}_sketch") for column, name in _DISTINCT.items()],
    )


def merge_sketches(partials: DataFrame, as_of=None) -> DataFrame:
    """Partial rows of the same key folded into Gold rows with estimated distincts."""
    total, packets = F.sum("total_bytes"), F.sum("packet_count")
    return (
        partials.groupBy(*schemas.GOLD_KEYS)
        .agg(
            packets.alias("packet_count"),
            total.alias("total_bytes"),
            (total.cast("double") / packets).alias("avg_packet_size"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            *[
                F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{name}_sketch")), F.lit(0)).alias(f"unique_{name}")
                for name in _DISTINCT.values()
            ],
        )
        .withColumn("computed_at", as_instant(as_of))
        .select(*schemas.GOLD.fieldNames())
    )


def by_protocol(gold: DataFrame) -> DataFrame:
    """Summary per protocol: sums of the measures, largest distinct counts of any row."""
    return gold.groupBy("protocol").agg(
        F.sum("packet_count").alias("packets"),
        F.sum("total_bytes").alias("bytes"),
        F.max("unique_src_ips").alias("src"),
        F.max("unique_dst_ips").alias("dst"),
        F.max("unique_dst_ports").alias("ports"),
    )


def busiest(gold: DataFrame, limit: int | None = None) -> DataFrame:
    """Per-protocol summary by packets, descending."""
    ordered = by_protocol(gold).orderBy(F.desc("packets"), "protocol")
    return ordered if limit is None else ordered.limit(limit)

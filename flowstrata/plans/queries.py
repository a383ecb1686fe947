"""Registered queries: every operator applied to inputs derived from the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import schemas
from ..files import listing
from ..functions import network as net
from ..maintenance.compaction import compact_bronze, compact_parquet
from ..maintenance.retention import enforce_bronze_retention, enforce_retention
from ..operators import (
    gold,
    health_state,
    live_state,
    manifest,
    metrics,
    reports,
    search,
    snapshot,
    traffic,
    validation,
    windows,
)
from ..operators.decode import decode_frames
from ..operators.silver import to_silver
from ..session import scratch_path
from ..sinks import writers
from ..sources import bronze, evolution, tables
from ..streaming import layers, live, pipeline, rings
from ..streaming.state import BatchState
from . import inputs
from .inputs import AS_OF, GOLD_COLUMNS, SILVER_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the checks compare them."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ])


def register(query: Query) -> Query:
    name = query.__name__
    REGISTRY[name] = inputs.in_utc(lambda spark, sf_dir: plain_times(query(spark, sf_dir)))
    return query


# ---- validation, Silver -------------------------------------------------


@register
def silver_packets(spark, sf_dir):
    return inputs.silver(spark, sf_dir).select(*SILVER_COLUMNS)


@register
def silver_ingested(spark, sf_dir):
    """When rows were taken in: one moment for all of them, here a fixed one."""
    rows = inputs.silver(spark, sf_dir)
    return rows.groupBy("event_date", "ingested_at").agg(F.count(F.lit(1)).alias("packets"))


@register
def silver_utc_buckets(spark, sf_dir):
    valid = validation.accepted(validation.validate_records(inputs.packets(spark, sf_dir)))
    return to_silver(valid, utc_buckets=True, keep=["seq"]).select("seq", "event_ts", "event_hour", "event_date")


@register
def quarantine_rows(spark, sf_dir):
    checked = validation.validate_records(inputs.packets(spark, sf_dir))
    rows = validation.rejected(checked)
    return rows.select("seq", F.col("errors").alias("reason"))


@register
def validated_json(spark, sf_dir):
    checked = validation.validate_json(inputs.messy_lines(spark, sf_dir))
    return validation.accepted(checked).select("seq", *schemas.BRONZE.fieldNames(), "_rescued_data")


@register
def rejected_json(spark, sf_dir):
    checked = validation.validate_json(inputs.messy_lines(spark, sf_dir))
    return validation.rejected(checked).select("seq", F.col("errors").alias("reason"), "_rescued_data")


@register
def bronze_roundtrip(spark, sf_dir):
    """NDJSON written below dt/hr and read back."""
    root = scratch_path(spark, "bronze")
    valid = validation.accepted(validation.validate_records(inputs.packets(spark, sf_dir)))
    writers.write_bronze(valid, root, as_of=AS_OF)
    return bronze.read_bronze(spark, root, dt_from="2024-01-30").select(
        *schemas.BRONZE.fieldNames(), F.col("dt"), F.col("hr")
    )


@register
def partition_filter(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir).where(F.col("event_date") == F.lit("2024-01-15").cast("date"))
    return rows.select("seq", "event_date", "length")


# ---- Gold ---------------------------------------------------------------


@register
def gold_hourly(spark, sf_dir):
    return gold.hourly(inputs.silver(spark, sf_dir)).select(*GOLD_COLUMNS)


@register
def gold_hourly_dense(spark, sf_dir):
    return gold.hourly(inputs.silver(spark, sf_dir, dense=True)).select(*GOLD_COLUMNS)


@register
def gold_partial_merge(spark, sf_dir):
    """Partial rows of two halves of the stream, merged. Distincts are estimates and left out here."""
    rows = inputs.silver(spark, sf_dir, dense=True)
    halves = [gold.hourly_sketch(rows.where(F.col("seq") % 2 == half)) for half in (0, 1)]
    merged = gold.merge_sketches(halves[0].unionByName(halves[1]))
    return merged.select(*[c for c in GOLD_COLUMNS if not c.startswith("unique_")])


@register
def gold_sketch_error(spark, sf_dir):
    """How many merged rows have a distinct estimate more than 5 % off the exact count."""
    rows = inputs.silver(spark, sf_dir, dense=True)
    estimate = gold.merge_sketches(gold.hourly_sketch(rows))
    exact = gold.hourly(rows)
    joined = estimate.alias("e").join(exact.alias("x"), schemas.GOLD_KEYS)
    off = F.lit(False)
    for name in ("unique_src_ips", "unique_dst_ips", "unique_dst_ports"):
        off = off | (F.abs(F.col(f"e.{name}") - F.col(f"x.{name}")) > F.greatest(F.lit(1), F.col(f"x.{name}") * 0.05))
    return joined.agg(F.count(F.lit(1)).alias("gold_rows"), F.count_if(off).alias("rows_off"))


@register
def gold_by_protocol(spark, sf_dir):
    return gold.by_protocol(gold.hourly(inputs.silver(spark, sf_dir, dense=True)))


@register
def gold_busiest(spark, sf_dir):
    return gold.busiest(gold.hourly(inputs.silver(spark, sf_dir, dense=True)), 2)


# ---- totals and breakdowns ----------------------------------------------


@register
def traffic_totals(spark, sf_dir):
    return traffic.totals(inputs.silver(spark, sf_dir)).select("packets", "bytes")


@register
def protocol_breakdown(spark, sf_dir):
    return traffic.protocol_view(inputs.silver(spark, sf_dir)).withColumn("size", net.human_bytes(F.col("bytes")))


@register
def top_src_ips(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir)
    return traffic.with_share(traffic.source_ips(rows), rows)


@register
def top_dst_ips(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir)
    return traffic.with_share(traffic.destination_ips(rows), rows)


@register
def top_subnets(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir)
    return traffic.with_share(traffic.subnets(rows), rows)


@register
def top_dst_ports(spark, sf_dir):
    return traffic.destination_ports(inputs.silver(spark, sf_dir))


@register
def port_stats(spark, sf_dir):
    return traffic.ports(inputs.silver(spark, sf_dir))


@register
def service_stats(spark, sf_dir):
    return traffic.services(inputs.silver(spark, sf_dir))


@register
def live_breakdowns(spark, sf_dir):
    return traffic.breakdowns(inputs.silver(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@register
def port_view_all(spark, sf_dir):
    return traffic.port_view(inputs.silver(spark, sf_dir), "all")


@register
def port_view_hide_os_noise(spark, sf_dir):
    return traffic.port_view(inputs.silver(spark, sf_dir), "hide_os_noise")


@register
def port_view_only_well_known(spark, sf_dir):
    return traffic.port_view(inputs.silver(spark, sf_dir), "only_well_known")


# ---- minutes and trailing windows ---------------------------------------


@register
def minute_buckets(spark, sf_dir):
    return windows.minute_buckets(inputs.silver(spark, sf_dir, dense=True))


@register
def protocol_windows(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir, dense=True)
    return windows.protocol_windows(rows, windows.latest(rows)).drop("rank")


@register
def subnet_windows(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir, dense=True)
    return windows.subnet_windows(rows, windows.latest(rows)).drop("rank")


@register
def service_windows(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir, dense=True)
    return windows.service_windows(rows, windows.latest(rows)).drop("rank")


@register
def trailing_windows_fixed(spark, sf_dir):
    return windows.trailing_windows(inputs.silver(spark, sf_dir), AS_OF).withColumn("rank", F.col("rank").cast("bigint"))


# ---- search, recent, masking --------------------------------------------

_FOUND = ["seq", "event_ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "port_category"]


@register
def recent_packets(spark, sf_dir):
    return search.recent_packets(inputs.silver(spark, sf_dir), arrival="seq").select(*_FOUND)


@register
def packet_search_proto(spark, sf_dir):
    return search.search_packets(inputs.silver(spark, sf_dir), proto=" tcp ", sort=None).select(*_FOUND)


@register
def packet_search_subnet(spark, sf_dir):
    return search.search_packets(inputs.silver(spark, sf_dir), src_subnet="192.168.1.0", sort=None).select(*_FOUND)


@register
def packet_search_subnet_octet(spark, sf_dir):
    return search.search_packets(inputs.silver(spark, sf_dir), src_subnet="10", sort=None).select(*_FOUND)


@register
def packet_search_ports(spark, sf_dir):
    return search.search_packets(
        inputs.silver(spark, sf_dir), dst_port_min="80", dst_port_max=5353, sort=None
    ).select(*_FOUND)


@register
def packet_search_category(spark, sf_dir):
    return search.search_packets(inputs.silver(spark, sf_dir), port_category="OS_Noise", sort=None).select(*_FOUND)


@register
def packet_search_text(spark, sf_dir):
    return search.search_packets(inputs.silver(spark, sf_dir), q="Example.com", sort=None).select(*_FOUND)


@register
def packet_search_combined(spark, sf_dir):
    return search.search_packets(
        inputs.silver(spark, sf_dir), q="203.0", proto="udp", dst_port_min=50, dst_port_max="none",
        port_category="well_known", tie_break="seq",
    ).select(*_FOUND)


@register
def packet_search_largest(spark, sf_dir):
    return search.search_packets(
        inputs.silver(spark, sf_dir), proto="UDP", sort="len_desc", tie_break="seq", limit=25
    ).select(*_FOUND)


@register
def packet_search_newest(spark, sf_dir):
    return search.search_packets(inputs.silver(spark, sf_dir), tie_break="seq", limit=25).select(*_FOUND)


@register
def packet_search_predicate(spark, sf_dir):
    return search.search_packets(
        inputs.silver(spark, sf_dir), where="protocol = 'TCP' AND 80 IN (src_port, dst_port)", sort=None
    ).select(*_FOUND)


@register
def anonymized_packets(spark, sf_dir):
    masked = search.anonymize_packets(inputs.silver(spark, sf_dir))
    return masked.select("seq", "src_ip", "dst_ip", "src_port", "dst_port", "src_network")


@register
def private_addresses(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir)
    return rows.groupBy(net.is_private_ipv4(F.col("src_ip")).alias("is_private")).agg(
        F.count(F.lit(1)).alias("packets"), F.count_distinct("src_ip").alias("addresses")
    )


@register
def live_rows(spark, sf_dir):
    return search.live_rows(inputs.silver(spark, sf_dir)).select("seq", "time", "source", "destination")


@register
def live_rows_in_zone(spark, sf_dir):
    return search.live_rows(inputs.silver(spark, sf_dir), "Europe/Paris").select("seq", "time")


# ---- metrics and health -------------------------------------------------


@register
def stage_counters(spark, sf_dir):
    return metrics.stage_counters(validation.validate_records(inputs.packets(spark, sf_dir)))


@register
def latency_percentiles(spark, sf_dir):
    return metrics.latency_percentiles(inputs.latency_samples(spark, sf_dir), order="seq")


@register
def metrics_document(spark, sf_dir):
    """Every field of the metrics document, from counters, samples, errors, readings and the dense packets' rate."""
    checked = validation.validate_records(inputs.packets(spark, sf_dir))
    dense = inputs.silver(spark, sf_dir, dense=True)
    capture = metrics.latest_counters(inputs.counter_history(spark, sf_dir), [], order="seq")
    readings = inputs.gauge_samples(spark, sf_dir).withColumn("gauge", F.regexp_replace("gauge", "gauge_0", "queue_depth"))
    moment = dense.agg(F.max("event_ts").alias("at")).scalar()
    rows = [
        health_state.counter_rows(metrics.stage_counters(checked)),
        health_state.counter_rows(capture.select(F.col("app_queued").alias("queued"), F.col("app_dropped").alias("dropped"))),
        health_state.counter_rows(inputs.events(spark, sf_dir).agg(
            F.count_if(F.col("event_type") == "click").alias("silver_flushes"),
            F.count_if(F.col("event_type") == "view").alias("gold_flushes"),
        )),
        health_state.latency_rows(inputs.latency_samples(spark, sf_dir), seq="seq"),
        health_state.error_rows(inputs.error_log(spark, sf_dir), seq="seq"),
        health_state.gauge_rows(readings.withColumn("ts", F.timestamp_micros("seq")), seq="seq"),
        health_state.rate_rows(dense, ts="event_ts"),
    ]
    state = BatchState(scratch_path(spark, "health"), health_state.ROWS, health_state.merge)
    for batch, part in enumerate(rows):
        state.write(part, "direct", batch)
    state.fold(spark, {"direct": len(rows) - 3})
    document = health_state.document(state.read(spark), moment, "2024-01-01T00:00:00+00:00")
    latency = F.array_join(F.transform(F.array_sort(F.map_entries("latency_us")), lambda e: F.concat_ws(
        ":", e["key"], *[F.format_string("%.1f", e["value"][p]) for p in ("p50", "p95", "p99")])), ",")
    errors = F.array_join(F.transform("recent_errors", lambda e: F.concat_ws("|", e["ts"], e["component"], e["error"])), "\n")
    return document.select(
        "uptime_sec", *[f"counters.{c}" for c in health_state.COUNTERS], "rates.packets_per_sec", "queue_depth",
        latency.alias("latency_us"), errors.alias("recent_errors"),
    )


@register
def throughput_rate(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir, dense=True)
    return metrics.throughput(rows, windows.latest(rows), ts="event_ts")


@register
def gauge_values(spark, sf_dir):
    return metrics.gauges(inputs.gauge_samples(spark, sf_dir), order="seq")


@register
def capture_health(spark, sf_dir):
    latest = metrics.latest_counters(inputs.counter_history(spark, sf_dir), ["agent_id"], order="seq")
    return metrics.capture_health(latest)


@register
def drop_rate_alerts(spark, sf_dir):
    latest = metrics.latest_counters(inputs.counter_history(spark, sf_dir), ["agent_id"], order="seq")
    return reports.drop_rate_alerts(metrics.capture_health(latest)).select("agent_id", "drop_rate_pct", "status")


@register
def recent_errors(spark, sf_dir):
    return metrics.recent_errors(inputs.error_log(spark, sf_dir), tie_break="seq").drop("seq")


@register
def data_age(spark, sf_dir):
    return metrics.data_age(inputs.silver(spark, sf_dir), "2024-01-31T12:00:00+00:00", ts="event_ts")


# ---- manifest -----------------------------------------------------------


@register
def manifest_current(spark, sf_dir):
    return manifest.current_state(inputs.manifest_log(spark, sf_dir))


@register
def pending_transfer(spark, sf_dir):
    return manifest.pending_transfer(inputs.manifest_log(spark, sf_dir)).select("file_path", "size_bytes", "record_count")


@register
def store_stats(spark, sf_dir):
    return metrics.store_stats(manifest.current_state(inputs.manifest_log(spark, sf_dir)))


@register
def compaction_candidates(spark, sf_dir):
    return manifest.compaction_candidates(inputs.manifest_log(spark, sf_dir), small_bytes=100 * 1024 * 1024)


@register
def retention_candidates(spark, sf_dir):
    return manifest.retention_candidates(inputs.manifest_log(spark, sf_dir), AS_OF).select("file_path", "transferred_at")


@register
def manifest_transitions(spark, sf_dir):
    """Seals every active file, transfers the sealed ones, and ignores files nobody knows."""
    log = inputs.manifest_log(spark, sf_dir)
    active = manifest.in_state(log, manifest.ACTIVE).select(
        "file_path", F.lit(7).cast("bigint").alias("size_bytes"), F.lit(3).cast("bigint").alias("record_count")
    )
    unknown = active.withColumn("file_path", F.concat("file_path", F.lit(".unknown")))
    sealed = manifest.seal(log, active.unionByName(unknown), AS_OF)
    moved = manifest.mark_transferred(log, manifest.pending_transfer(log), AS_OF)
    after = log.unionByName(sealed).unionByName(moved)
    return manifest.current_state(after).select("seq", "file_path", "state", "size_bytes", "record_count")


# ---- snapshot -----------------------------------------------------------


def _listed(column: str, *fields: str):
    return F.array_join(
        F.transform(column, lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields])), ","
    ).alias(column)


def _snapshot(spark, sf_dir, **options):
    rows = inputs.silver(spark, sf_dir)
    counters = metrics.latest_counters(inputs.counter_history(spark, sf_dir), [], order="seq")
    return snapshot.live_snapshot(rows, gold.hourly(rows), counters, AS_OF, arrival="seq", **options)


@register
def live_snapshot(spark, sf_dir):
    document = _snapshot(spark, sf_dir)
    return document.select(
        "total_packets", "total_bytes",
        _listed("protocols", "name", "packets", "bytes"),
        _listed("top_src_ips", "ip", "packets"),
        _listed("top_dst_ips", "ip", "packets"),
        _listed("top_subnets", "subnet", "packets"),
        _listed("top_dst_ports", "port", "packets"),
        _listed("port_stats", "port", "protocol", "packets", "bytes"),
        _listed("services", "name", "packets", "bytes"),
        F.size("recent_packets").cast("bigint").alias("recent"),
        F.size("gold").cast("bigint").alias("gold_protocols"),
        F.col("capture_health.drop_rate_pct").alias("drop_rate_pct"),
        F.array_join(F.transform(
            F.col("protocol_windows")["60m"], lambda e: F.concat_ws(":", e["name"], e["bytes"].cast("string"))
        ), ",").alias("protocol_60m"),
    )


_PACKET_FIELDS = (
    "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "flags", "ttl", "service_info", "port_category",
    "src_network",
)


def _whole_document(document: DataFrame) -> DataFrame:
    """Every field of the live document as plain columns."""
    trailing = [
        F.array_join(F.transform(
            F.col(f"{dimension}_windows")[label], lambda e: F.concat_ws(":", e["name"], e["bytes"].cast("string"))
        ), ",").alias(f"{dimension}_{label}")
        for dimension in windows.DIMENSIONS for label in C.WINDOW_MINUTES
    ]
    entries = F.array_sort(F.map_entries("gold"))
    health = [F.col(f"capture_health.{n}") for n in ("os_recv", "os_drop", "os_ifdrop", "app_queued", "app_dropped", "drop_rate_pct")]
    return document.select(
        "snapshot_at", "started_at", "total_packets", "total_bytes",
        _listed("protocols", "name", "packets", "bytes"), _listed("top_src_ips", "ip", "packets"),
        _listed("top_dst_ips", "ip", "packets"), _listed("top_subnets", "subnet", "packets"),
        _listed("top_dst_ports", "port", "packets"), _listed("port_stats", "port", "protocol", "packets", "bytes"),
        _listed("services", "name", "packets", "bytes"), _listed("recent_packets", *_PACKET_FIELDS), *trailing,
        F.array_join(F.transform(entries, lambda e: F.concat_ws(
            ":", e["key"], *[e["value"][f].cast("string") for f in ("packets", "bytes", "src", "dst", "ports")])), ",").alias("gold"),
        *health,
    )


@register
def live_snapshot_from_state(spark, sf_dir):
    """Every field of the live document, from the partial rows of four batches, three of them folded."""
    root, rows = scratch_path(spark, "live-state"), inputs.silver(spark, sf_dir)
    recent = lambda df: live_state.merge_recent(df, "seq")
    states = [
        (BatchState(f"{root}/live", live_state.PARTIAL, live_state.merge), live_state.partials),
        (BatchState(f"{root}/recent", f"{live_state.RECENT}, seq bigint", recent), recent),
        (BatchState(f"{root}/gold", gold.PARTIAL, gold.fold_partials), gold.partials),
    ]
    for batch in range(4):
        part = rows.where(F.col("seq") % 4 == batch)
        for state, partials in states:
            state.write(partials(part), "direct", batch)
    for state, _ in states:
        state.fold(spark, {"direct": 2})
    (stored, _), (last, _), (hours, _) = states
    counters = metrics.latest_counters(inputs.counter_history(spark, sf_dir), [], order="seq")
    document = live_state.snapshot(
        stored.read(spark), last.read(spark), gold.merge_partials(hours.read(spark)), counters, AS_OF, arrival="seq"
    )
    return _whole_document(document)


@register
def live_snapshot_masked(spark, sf_dir):
    document = _snapshot(spark, sf_dir, anonymize=True)
    return document.select(
        _listed("top_src_ips", "ip", "packets"),
        _listed("top_subnets", "subnet", "packets"),
        _listed("recent_packets", "src_ip", "src_port", "dst_port"),
    )


@register
def snapshot_document_roundtrip(spark, sf_dir):
    """The document written as JSON and read back with its fixed schema."""
    path = scratch_path(spark, "snapshot")
    writers.write_document(_snapshot(spark, sf_dir), path)
    document = tables.read_document(spark, path)
    return document.select(
        "total_packets", "total_bytes", _listed("protocols", "name", "packets", "bytes"),
        F.size("recent_packets").cast("bigint").alias("recent"),
    )


@register
def health_status(spark, sf_dir):
    counts = metrics.stage_counters(validation.validate_records(inputs.packets(spark, sf_dir)))
    document = snapshot.health_document(_snapshot(spark, sf_dir), counts)
    return document.select("status", "drop_rate_pct", "os_recv", "os_drop", "counters.captured", "counters.silver_records")


# ---- stored tables: sinks, evolution, compaction, retention -------------


@register
def silver_table_scan(spark, sf_dir):
    """Silver written below event_date and scanned with a date filter."""
    root = scratch_path(spark, "silver")
    writers.write_partitioned(inputs.silver(spark, sf_dir).drop("seq"), root)
    stored = tables.read_silver(spark, root)
    return stored.where(F.col("event_date") >= F.lit("2024-01-20").cast("date")).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")
    )


@register
def stored_summary(spark, sf_dir):
    """Row counts of stored Silver and Gold."""
    root = scratch_path(spark, "summary")
    rows = inputs.silver(spark, sf_dir).drop("seq")
    writers.write_partitioned(rows, f"{root}/silver")
    writers.write_partitioned(gold.hourly(rows), f"{root}/gold")
    return tables.table_summary(spark, f"{root}/silver", f"{root}/gold")


@register
def stored_gold_preview(spark, sf_dir):
    """The first rows of stored Gold, in the order of its key."""
    root = scratch_path(spark, "preview")
    writers.write_partitioned(gold.hourly(inputs.silver(spark, sf_dir)), root)
    stored = tables.read_gold(spark, root).select(*GOLD_COLUMNS)
    return tables.preview(stored.orderBy(*schemas.GOLD_KEYS), 20)


@register
def table_append(spark, sf_dir):
    """A stream appended to a table that the DDL has made."""
    root = scratch_path(spark, "append")
    _land(spark, sf_dir, f"{root}/landing", range(3))
    checked = validation.accepted(validation.validate_json(bronze.stream_lines(spark, f"{root}/landing")))
    rows = to_silver(checked)
    name = f"append_{root.rsplit('-', 1)[1]}"
    writers.create_table(spark, name, location=f"{root}/table")
    writers.append_to_table(rows.select(*schemas.SILVER.fieldNames()), name, f"{root}/_checkpoint").awaitTermination()
    return spark.read.schema(schemas.SILVER).parquet(f"{root}/table").select(*[c for c in SILVER_COLUMNS if c != "seq"])


@register
def schema_evolution_read(spark, sf_dir):
    """Three generations of files: current, without a column and with an extra one, and with text lengths."""
    root = scratch_path(spark, "evolved")
    rows = inputs.silver(spark, sf_dir)
    writers.write_partitioned(rows.where("seq % 3 = 0").drop("seq"), root)
    writers.write_partitioned(
        rows.where("seq % 3 = 1").withColumn("obsolete", F.lit("x")).drop("seq", "service_info"), root
    )
    text = F.when(F.col("seq") % 2 == 0, F.lit("not-a-number")).otherwise(F.col("length").cast("string"))
    writers.write_partitioned(rows.where("seq % 3 = 2").withColumn("length", text).drop("seq"), root)
    table = evolution.read_with_evolution(spark, root, schemas.SILVER)
    return table.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count("length").alias("lengths"),
        F.sum("length").alias("bytes"),
        F.count("service_info").alias("services"),
    )


@register
def schema_evolution_strict(spark, sf_dir):
    """Texts for lengths in all files: a file with one that is no number has no lengths at all (every other day)."""
    root = scratch_path(spark, "strict")
    bad = (F.dayofmonth("event_date") % 2 == 1) & (F.col("seq") % 2 == 0)
    text = F.when(bad, F.lit("not-a-number")).otherwise(F.col("length").cast("string"))
    writers.write_partitioned(inputs.silver(spark, sf_dir).withColumn("length", text).drop("seq"), root)
    table = evolution.read_with_evolution(spark, root, schemas.SILVER, strict=True)
    return table.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("packets"), F.count("length").alias("lengths"), F.sum("length").alias("bytes")
    )


@register
def compacted_silver(spark, sf_dir):
    """Many small files merged; every row is still there."""
    root = scratch_path(spark, "compacted")
    rows = inputs.silver(spark, sf_dir)
    for part in range(3):
        writers.write_partitioned(rows.where(F.col("seq") % 3 == part).drop("seq"), root)
    compact_parquet(spark, root, schemas.SILVER)
    files_left = listing(spark, root).groupBy("directory").count().agg(F.max("count")).scalar()
    stored = tables.read_silver(spark, root)
    return stored.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")
    ).withColumn("most_files", files_left)


@register
def retained_silver(spark, sf_dir):
    root = scratch_path(spark, "retained")
    writers.write_partitioned(inputs.silver(spark, sf_dir).drop("seq"), root)
    enforce_retention(spark, root, layer="silver", as_of=AS_OF.date())
    return tables.read_silver(spark, root).groupBy("event_date").agg(F.count(F.lit(1)).alias("packets"))


@register
def compacted_bronze(spark, sf_dir):
    """NDJSON files registered in a manifest and merged per hour: states with their sums."""
    root = scratch_path(spark, "bronze-compacted")
    data, log_path = f"{root}/data", f"{root}/_manifest"
    valid = validation.accepted(validation.validate_records(inputs.packets(spark, sf_dir)))
    for part in range(2):
        writers.write_bronze(valid.where(F.col("seq") % 2 == part), data, as_of=AS_OF)
    writers.append_manifest(_registered(spark, data), log_path)
    compact_bronze(spark, data, log_path, as_of=AS_OF)
    sealed = manifest.pending_transfer(tables.read_manifest(spark, log_path))
    lines = bronze.read_lines(spark, data).agg(F.count(F.lit(1)).alias("lines"))
    return sealed.agg(
        F.sum("record_count").alias("records"), F.count_distinct("partition_dt", "partition_hr").alias("hours")
    ).withColumn("lines", lines.scalar())


def _registered(spark, data):
    """Manifest rows for the files found below ``data``."""
    held = bronze.read_lines(spark, data).groupBy(F.col("_metadata.file_path").alias("file_path"), "dt", "hr").agg(
        F.count(F.lit(1)).alias("record_count"), F.max("_metadata.file_size").alias("size_bytes")
    )
    text = F.lit(None).cast("string")
    return held.select(
        F.lit(1).cast("bigint").alias("seq"), "file_path", F.lit(manifest.SEALED).alias("state"),
        F.col("dt").cast("string").alias("partition_dt"), F.col("hr").alias("partition_hr"),
        F.lit("2024-01-30T23:00:00+00:00").alias("created_at"), F.lit("2024-01-30T23:00:00+00:00").alias("sealed_at"),
        text.alias("transferred_at"), "size_bytes", "record_count", F.lit("").alias("agent_id"),
    )


@register
def retained_bronze(spark, sf_dir):
    """Transferred files past their time are deleted and archived."""
    root = scratch_path(spark, "bronze-retained")
    data, log_path = f"{root}/data", f"{root}/_manifest"
    valid = validation.accepted(validation.validate_records(inputs.packets(spark, sf_dir)))
    writers.write_bronze(valid, data, as_of=AS_OF)
    sealed = _registered(spark, data)
    writers.append_manifest(sealed, log_path)
    log = tables.read_manifest(spark, log_path)
    writers.append_manifest(manifest.mark_transferred(log, log.select("file_path"), AS_OF), log_path)
    enforce_bronze_retention(spark, log_path, as_of="2024-02-03T00:00:00+00:00")
    after = manifest.current_state(tables.read_manifest(spark, log_path))
    left = bronze.read_lines(spark, data).agg(F.count(F.lit(1)).alias("lines"))
    return after.groupBy("state").agg(F.sum("record_count").alias("records")).withColumn("lines_left", left.scalar())


# ---- streaming ----------------------------------------------------------


def _land(spark, sf_dir, landing: str, parts) -> None:
    for part in parts:
        lines = inputs.messy_lines(spark, sf_dir).where(F.col("seq") % 3 == part)
        lines.select("value", F.lit("2024-01-30").alias("dt"), F.lit(part).alias("hr")).write.mode("append").partitionBy(
            "dt", "hr"
        ).text(landing)


def _run(spark, landing: str, layout: pipeline.Layout) -> None:
    # A landing part has at most one file per core, so this makes about a batch for each.
    batch_files = spark.sparkContext.defaultParallelism
    pipeline.run_available(bronze.stream_lines(spark, landing, max_files=batch_files), layout)


def _streamed(spark, sf_dir) -> pipeline.Layout:
    """Messy lines landed as several files and run through the streaming pipeline."""
    root = scratch_path(spark, "stream")
    _land(spark, sf_dir, f"{root}/landing", range(3))
    layout = pipeline.Layout(root, grain="date")
    _run(spark, f"{root}/landing", layout)
    return layout


@register
def stream_gold_late(spark, sf_dir):
    """A third of the lines arrives after Silver retention has removed all that was stored."""
    root = scratch_path(spark, "stream-late")
    layout = pipeline.Layout(root, grain="date")
    _land(spark, sf_dir, f"{root}/landing", range(2))
    _run(spark, f"{root}/landing", layout)
    enforce_retention(spark, layout.silver, as_of=dt.date(2030, 1, 1))
    _land(spark, sf_dir, f"{root}/landing", [2])
    _run(spark, f"{root}/landing", layout)
    return pipeline.gold_table(spark, layout).select(*GOLD_COLUMNS)


@register
def stream_gold(spark, sf_dir):
    return pipeline.gold_table(spark, _streamed(spark, sf_dir)).select(*GOLD_COLUMNS)


@register
def stream_silver(spark, sf_dir):
    table = pipeline.silver_table(spark, _streamed(spark, sf_dir))
    return table.select(*[c for c in SILVER_COLUMNS if c != "seq"])


@register
def stream_quarantine(spark, sf_dir):
    table = pipeline.quarantine_table(spark, _streamed(spark, sf_dir))
    return table.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@register
def gold_state_folded(spark, sf_dir):
    """Partial Gold rows of three batches after folding, and the Gold rows they still make."""
    layout = _streamed(spark, sf_dir)
    state = pipeline.gold_state(layout)
    (query,) = [r[0] for r in spark.read.parquet(layout.gold_state).select("ingest_query").distinct().limit(2).collect()]
    pipeline.fold_gold(spark, layout, {query: 10_000})
    rows = state.read(spark)
    sums = pipeline.gold_table(spark, layout).agg(
        F.count(F.lit(1)).alias("gold_rows"), F.sum("packet_count").alias("packets"), F.sum("total_bytes").alias("bytes"),
        F.sum("unique_src_ips").alias("src"), F.sum("unique_dst_ips").alias("dst"), F.sum("unique_dst_ports").alias("ports"),
    )
    return sums.withColumn("state_rows", rows.agg(F.count(F.lit(1))).scalar())


@register
def stream_all_layers(spark, sf_dir):
    """One stream to every layer: what each of them holds at the end."""
    root = scratch_path(spark, "layers")
    _land(spark, sf_dir, f"{root}/landing", range(3))
    layout = layers.Layers(f"{root}/tables", grain="date", publish_every=2, fold_every=2)
    batch_files = 2 * spark.sparkContext.defaultParallelism
    lines = bronze.stream_lines(spark, f"{root}/landing", max_files=batch_files)
    layers.start(lines, layout).awaitTermination()
    # The documents as of the end of the stream, whatever batch was published last.
    document, health = layers.snapshot_row(spark, layout), layers.metrics_row(spark, layout)

    def layer(name: str, rows: DataFrame, count, volume):
        return rows.agg(F.lit(name).alias("layer"), count.cast("bigint").alias("rows"), volume.cast("bigint").alias("bytes"))

    one, size = F.count(F.lit(1)), F.sum("length")
    log = manifest.current_state(tables.read_manifest(spark, layout.manifest))
    parts = [
        layer("bronze", bronze.read_bronze(spark, layout.bronze), one, size),
        layer("manifest", log.where("state = 'SEALED'"), F.sum("record_count"), F.lit(0)),
        layer("quarantine", pipeline.quarantine_table(spark, layout), one, F.lit(0)),
        layer("silver", pipeline.silver_table(spark, layout), one, size),
        layer("gold", pipeline.gold_table(spark, layout), one, F.sum("total_bytes")),
        layer("live", document, F.max("total_packets"), F.max("total_bytes")),
        layer("live_recent", document, F.max(F.size("recent_packets")), F.lit(0)),
        layer("processed", health, F.max("counters.processed"), F.lit(0)),
        layer("errors", health, F.max("counters.validation_errors"), F.lit(0)),
        layer("silver_records", health, F.max("counters.silver_records"), F.lit(0)),
        layer("published", tables.read_document(spark, layout.metrics, health_state.DOCUMENT), one, F.lit(0)),
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both


@register
def stream_minutes(spark, sf_dir):
    """Minute volumes per protocol of a stream with a watermark, in update mode."""
    root = scratch_path(spark, "minutes")
    stream = spark.readStream.schema(inputs.events(spark, sf_dir).schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf_dir)
    from_events = stream.selectExpr("event_id AS seq", *inputs._expressions("ts"))
    rows = to_silver(validation.accepted(validation.validate_records(from_events)))
    (
        live.minute_volumes(rows, "protocol").writeStream.outputMode("update")
        .foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{root}/minutes"))
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/minutes")


def _event_stream(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(inputs.events(spark, sf_dir).schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf_dir)


@register
def stream_windows(spark, sf_dir):
    """Trailing windows of a stream of several batches, from the ring of the last 60 minutes, folded on the way."""
    root = scratch_path(spark, "windows")
    dense = inputs.packets(spark, sf_dir, dense=True)
    dense.repartitionByRange(4, "seq").write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(dense.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
    ring = rings.minute_ring(f"{root}/ring")
    silver = to_silver(validation.accepted(validation.validate_records(stream)))
    ring.start(silver, f"{root}/_checkpoint", fold_every=2).awaitTermination()
    found = rings.trailing_windows(spark, ring)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@register
def stream_latency(spark, sf_dir):
    """Latency percentiles of a stream, from the ring of the last samples per stage."""
    root = scratch_path(spark, "latency")
    inputs.latency_samples(spark, sf_dir).repartitionByRange(4, "seq").write.parquet(f"{root}/landing")
    schema = spark.read.parquet(f"{root}/landing").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
    ring = rings.latency_ring(f"{root}/ring")
    # The newest sample is the one that came last, as in the batch query.
    ring.start(stream.withColumn("ts", F.timestamp_micros("seq")), f"{root}/_checkpoint", fold_every=2).awaitTermination()
    return rings.latency_percentiles(spark, ring)


@register
def stream_protocol_totals(spark, sf_dir):
    """Running totals of a stream in complete mode; the last table is the result."""
    root = scratch_path(spark, "running")
    stream = spark.readStream.schema(inputs.events(spark, sf_dir).schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf_dir)
    from_events = stream.selectExpr("event_id AS seq", *inputs._expressions("ts"))
    rows = to_silver(validation.accepted(validation.validate_records(from_events)))
    totals = live.running_breakdown(rows, ["protocol"])
    (
        totals.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/totals"))
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/totals")


# ---- frames -------------------------------------------------------------


@register
def frame_decode(spark, sf_dir):
    return decode_frames(inputs.frames(spark, sf_dir)).drop("agent_id")


@register
def frame_to_gold(spark, sf_dir):
    """Frames through decoding, validation and Silver to Gold."""
    records = decode_frames(inputs.frames(spark, sf_dir), agent_id="tap", detect_services=False)
    rows = to_silver(validation.accepted(validation.validate_records(records)))
    return gold.hourly(rows).select(*GOLD_COLUMNS)


# ---- reports ------------------------------------------------------------


@register
def volume_vs_previous_day(spark, sf_dir):
    return reports.volume_vs_previous_day(inputs.silver(spark, sf_dir))


@register
def new_top_talkers(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir)
    known = rows.where(F.col("event_date") < F.lit("2024-01-02").cast("date"))
    return reports.new_top_talkers(rows, known, limit=50)


@register
def new_top_destinations(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir)
    known = rows.where(F.col("event_date") < F.lit("2024-01-02").cast("date"))
    return reports.new_top_destinations(rows, known, limit=50)


@register
def profile_top_src_ips(spark, sf_dir):
    rows = reports.profile_top(inputs.silver(spark, sf_dir), "src_ip", 3)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@register
def profile_protocol_mix(spark, sf_dir):
    return reports.profile_protocol_mix(inputs.silver(spark, sf_dir))


@register
def hour_weekday_profile(spark, sf_dir):
    return reports.hour_weekday_profile(inputs.silver(spark, sf_dir))


@register
def profile_top_ports(spark, sf_dir):
    rows = reports.profile_top(inputs.silver(spark, sf_dir), "dst_port", 3)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@register
def profile_deviation(spark, sf_dir):
    return reports.profile_deviation(inputs.silver(spark, sf_dir))


@register
def flows(spark, sf_dir):
    return reports.flows(inputs.silver(spark, sf_dir))


@register
def flow_sessions(spark, sf_dir):
    """Sessions per pair of source network and agent-side port, with ports left out to form long flows."""
    rows = inputs.silver(spark, sf_dir, dense=True).withColumns({
        "dst_ip": F.lit("any"), "src_port": F.lit(0), "dst_port": F.lit(0), "src_ip": F.col("src_network"),
    })
    return reports.flow_sessions(rows, 120).select(
        "src_ip", "protocol", "packets", "bytes", "first_seen", "last_seen", "duration_sec"
    )


@register
def flow_sessions_by_tuple(spark, sf_dir):
    """Sessions of the full five-tuple."""
    return reports.flow_sessions(inputs.silver(spark, sf_dir, dense=True), 120).drop("session")


@register
def main_service(spark, sf_dir):
    return reports.main_service(inputs.silver(spark, sf_dir))


@register
def subnet_report(spark, sf_dir):
    return reports.subnet_report(inputs.silver(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@register
def last_hours(spark, sf_dir):
    return reports.last_hours(inputs.silver(spark, sf_dir), 24, AS_OF)


@register
def weekly_report(spark, sf_dir):
    return reports.periodic(inputs.silver(spark, sf_dir), "week").drop("approx_src_ips")


@register
def periodic_export(spark, sf_dir):
    """Daily and weekly top lists with exact distinct names, exported as CSV and read back."""
    root = scratch_path(spark, "export")
    report = reports.periodic_report(inputs.silver(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))
    writers.write_export(report, root, ("unit", "period"))
    return tables.read_export(spark, root, report.schema).select(*report.columns)


@register
def hours_export(spark, sf_dir):
    """The last day's volume by address, port and service, exported as CSV and read back."""
    root = scratch_path(spark, "hours")
    volume = reports.last_hours(inputs.silver(spark, sf_dir), 24, AS_OF)
    writers.write_export(volume, root)
    return tables.read_export(spark, root, volume.schema)


@register
def window_breakdown(spark, sf_dir):
    rows = reports.between(inputs.silver(spark, sf_dir), "2024-01-10T00:00:00", "2024-01-12T00:00:00")
    return traffic.protocols(rows)


@register
def volume_spikes(spark, sf_dir):
    rows = inputs.silver(spark, sf_dir, dense=True).withColumn("src_ip", F.col("src_network"))
    found = reports.volume_spikes(rows, minutes=10, history=6, sigmas=1.5)
    return found.select("src_ip", "dst_port", "window_start", "bytes")


@register
def volume_spikes_by_source(spark, sf_dir):
    """Spikes per source address and destination port."""
    rows = inputs.silver(spark, sf_dir, dense=True)
    found = reports.volume_spikes(rows, minutes=360, history=24, sigmas=1.0)
    return found.select("src_ip", "dst_port", "window_start", "bytes")


@register
def ephemeral_fanout(spark, sf_dir):
    return reports.ephemeral_fanout(inputs.silver(spark, sf_dir))


@register
def ttl_distribution(spark, sf_dir):
    return reports.ttl_distribution(inputs.silver(spark, sf_dir))


@register
def low_ttl_share(spark, sf_dir):
    return reports.low_ttl_share(inputs.silver(spark, sf_dir))


"""The live document: one row assembled from already reduced frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import as_instant, iso_text
from . import gold as gold_ops
from . import metrics, search, traffic, windows


def _entries(breakdown: str, fields: dict[str, Column]) -> Column:
    """The rows of one breakdown as an array in rank order (at most 30 entries)."""
    entry = F.struct(F.col("rank"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("entry"))
    rows = F.sort_array(F.collect_list(F.when(F.col("breakdown") == breakdown, entry)))
    return F.transform(rows, lambda r: r["entry"]).alias(breakdown)


def _breakdown_row(ranked: DataFrame) -> DataFrame:
    name, port = F.col("name"), F.col("name").cast("int")
    packets, size = F.col("packets"), F.col("bytes")
    return ranked.agg(
        _entries("protocols", {"name": name, "packets": packets, "bytes": size}),
        _entries("top_src_ips", {"ip": name, "packets": packets}),
        _entries("top_dst_ips", {"ip": name, "packets": packets}),
        _entries("top_subnets", {"subnet": name, "packets": packets}),
        _entries("top_dst_ports", {"port": port, "packets": packets}),
        _entries("port_stats", {"port": port, "protocol": F.col("protocol"), "packets": packets, "bytes": size}),
        _entries("services", {"name": name, "packets": packets, "bytes": size}),
    )


def _recent_row(rows: DataFrame, arrival: str, anonymize: bool) -> Column:
    # Ports are text in the document so that a masked port fits the same field.
    rows = search.anonymize_packets(rows) if anonymize else rows.withColumns({
        "src_port": F.col("src_port").cast("string"), "dst_port": F.col("dst_port").cast("string"),
    })
    packet = F.struct(
        iso_text(F.col("event_ts")).alias("ts"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length",
        "flags", "ttl", "service_info", "port_category", "src_network",
    )
    listed = F.sort_array(F.collect_list(F.struct(F.col(arrival).alias("at"), packet.alias("packet"))))
    return rows.agg(F.transform(listed, lambda r: r["packet"])).scalar()


def _windows_row(ranked: DataFrame) -> DataFrame:
    """One map per dimension: window label -> entries, largest first."""
    listed = ranked.groupBy("dimension", "window").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "name", "bytes"))),
            lambda r: F.struct(r["name"].alias("name"), r["bytes"].alias("bytes")),
        ).alias("entries")
    )

    def of(dimension: str) -> Column:
        pair = F.when(F.col("dimension") == dimension, F.struct("window", "entries"))
        return F.map_from_entries(F.array_sort(F.collect_list(pair))).alias(f"{dimension}_windows")

    return listed.agg(of("protocol"), of("subnet"), of("service"))


def _gold_row(gold: DataFrame) -> Column:
    """Protocol -> summary, one entry per protocol name."""
    pair = F.struct("protocol", F.struct("packets", "bytes", "src", "dst", "ports"))
    return gold_ops.by_protocol(gold).agg(F.map_from_entries(F.collect_list(pair))).scalar()


def _mask(parts: dict[str, Column]) -> dict[str, Column]:
    from ..functions import network as net

    def over(column: Column, key: str, rule) -> Column:
        return F.transform(column, lambda e: e.withField(key, rule(e[key])))

    masked = dict(parts)
    masked["top_src_ips"] = over(parts["top_src_ips"], "ip", net.mask_ip)
    masked["top_dst_ips"] = over(parts["top_dst_ips"], "ip", net.mask_ip)
    masked["top_subnets"] = over(parts["top_subnets"], "subnet", net.mask_subnet)
    masked["subnet_windows"] = F.transform_values(
        parts["subnet_windows"], lambda _, es: F.transform(es, lambda e: e.withField("name", net.mask_subnet(e["name"])))
    )
    return masked


def live_snapshot(
    silver: DataFrame,
    gold: DataFrame | None = None,
    counters: DataFrame | None = None,
    as_of=None,
    arrival: str = "ingested_at",
    anonymize: bool = False,
) -> DataFrame:
    """The snapshot as one typed row.

    Silver is scanned once for the breakdowns, once for the (pruned) windows,
    once for the recent packets and once for the totals. ``live_state.snapshot`` makes the
    same row from stored partial rows.
    """
    return assemble(
        traffic.totals(silver), traffic.breakdowns(silver), windows.trailing_windows(silver, as_of),
        search.recent_packets(silver, arrival), gold, counters, as_of, arrival, anonymize,
    )


def assemble(
    totals: DataFrame,
    ranked: DataFrame,
    trailing: DataFrame,
    recent: DataFrame,
    gold: DataFrame | None,
    counters: DataFrame | None,
    as_of,
    arrival: str,
    anonymize: bool,
) -> DataFrame:
    """The snapshot row from its reduced parts: totals, ranked breakdowns, trailing windows and recent packets."""
    spark = totals.sparkSession
    total = totals.agg(
        F.struct(F.sum("packets").alias("n"), F.sum("bytes").alias("b"), F.min("started_at").alias("s"))
    ).scalar()
    # Each part is a one-row frame of at most some hundred small entries.
    breakdown = _breakdown_row(ranked)
    breakdown = breakdown.select(F.struct(*breakdown.columns)).scalar()
    trailing = _windows_row(trailing)
    trailing = trailing.select(F.struct(*trailing.columns)).scalar()

    parts = spark.range(1).select(total.alias("t"), breakdown.alias("b"), trailing.alias("w"))
    b, w = F.col("b"), F.col("w")
    columns: dict[str, Column] = {
        "snapshot_at": iso_text(as_instant(as_of)),
        "started_at": iso_text(F.col("t.s")),
        "total_packets": F.col("t.n"),
        "total_bytes": F.col("t.b"),
        **{name: b[name] for name in traffic.BREAKDOWNS},
        **{f"{d}_windows": w[f"{d}_windows"] for d in windows.DIMENSIONS},
    }
    if anonymize:
        columns = _mask(columns)
    columns["recent_packets"] = _recent_row(recent, arrival, anonymize)
    if gold is not None:
        columns["gold"] = _gold_row(gold)
    if counters is not None:
        health = metrics.capture_health(counters)
        columns["capture_health"] = health.agg(F.first(F.struct(
            "os_recv", "os_drop", "os_ifdrop", "app_queued", "app_dropped", "drop_rate_pct"
        ))).scalar()
    return parts.select(*[column.alias(name) for name, column in columns.items()])


def snapshot_document(snapshot: DataFrame) -> DataFrame:
    """The one-row snapshot as a JSON text column ``document``."""
    return snapshot.select(F.to_json(F.struct(*snapshot.columns), {"ignoreNullFields": "false"}).alias("document"))


def health_document(snapshot: DataFrame, stage_counts: DataFrame | None = None) -> DataFrame:
    """Status payload for monitoring: status, drop rate, counters."""
    rate = F.coalesce(F.col("capture_health.drop_rate_pct"), F.lit(0.0))
    out = snapshot.select(
        metrics.health_status(rate).alias("status"),
        F.round(rate, 4).alias("drop_rate_pct"),
        "snapshot_at",
        F.coalesce("capture_health.os_recv", F.lit(0)).alias("os_recv"),
        F.coalesce("capture_health.os_drop", F.lit(0)).alias("os_drop"),
    )
    if stage_counts is not None:
        out = out.withColumn("counters", stage_counts.agg(F.first(F.struct(*stage_counts.columns))).scalar())
    return out

"""Table schemas. Names, order and types of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

BRONZE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("ttl", T.IntegerType()),
    T.StructField("flags", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("service_info", T.StringType()),
])

SILVER = T.StructType([
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("event_hour", T.TimestampType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("ttl", T.IntegerType()),
    T.StructField("flags", T.StringType()),
    T.StructField("service_info", T.StringType()),
    T.StructField("port_category", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("src_network", T.StringType()),
])

GOLD = T.StructType([
    T.StructField("event_hour", T.TimestampType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("src_network", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("packet_count", T.LongType()),
    T.StructField("total_bytes", T.LongType()),
    T.StructField("avg_packet_size", T.DoubleType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("unique_src_ips", T.LongType()),
    T.StructField("unique_dst_ips", T.LongType()),
    T.StructField("unique_dst_ports", T.LongType()),
    T.StructField("computed_at", T.TimestampType()),
])

GOLD_KEYS = ["event_hour", "event_date", "protocol", "src_network", "agent_id"]

QUARANTINE = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("ts", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("partition_dt", T.StringType()),
    T.StructField("partition_hr", T.IntegerType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("sealed_at", T.StringType()),
    T.StructField("transferred_at", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("record_count", T.LongType()),
    T.StructField("agent_id", T.StringType()),
])

FRAMES = T.StructType([
    T.StructField("frame_id", T.LongType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("frame", T.BinaryType()),
])

CAPTURE_COUNTERS = T.StructType([
    T.StructField("os_recv", T.LongType()),
    T.StructField("os_drop", T.LongType()),
    T.StructField("os_ifdrop", T.LongType()),
    T.StructField("app_queued", T.LongType()),
    T.StructField("app_dropped", T.LongType()),
])


def _entries(key: str, key_type: str, *measures: str) -> str:
    fields = ", ".join([f"{key}: {key_type}", *(f"{m}: bigint" for m in measures)])
    return f"array<struct<{fields}>>"


_WINDOW_MAP = f"map<string, {_entries('name', 'string', 'bytes')}>"

SNAPSHOT = ", ".join([
    "snapshot_at string",
    "started_at string",
    "total_packets bigint",
    "total_bytes bigint",
    f"protocols {_entries('name', 'string', 'packets', 'bytes')}",
    f"top_src_ips {_entries('ip', 'string', 'packets')}",
    f"top_dst_ips {_entries('ip', 'string', 'packets')}",
    f"top_subnets {_entries('subnet', 'string', 'packets')}",
    f"top_dst_ports {_entries('port', 'int', 'packets')}",
    "port_stats array<struct<port: int, protocol: string, packets: bigint, bytes: bigint>>",
    "recent_packets array<struct<ts: string, src_ip: string, dst_ip: string, src_port: string,"
    " dst_port: string, protocol: string, length: bigint, flags: string, ttl: int,"
    " service_info: string, port_category: string, src_network: string>>",
    f"services {_entries('name', 'string', 'packets', 'bytes')}",
    f"protocol_windows {_WINDOW_MAP}",
    f"subnet_windows {_WINDOW_MAP}",
    f"service_windows {_WINDOW_MAP}",
    "gold map<string, struct<packets: bigint, bytes: bigint, src: bigint, dst: bigint, ports: bigint>>",
    "capture_health struct<os_recv: bigint, os_drop: bigint, os_ifdrop: bigint, app_queued: bigint,"
    " app_dropped: bigint, drop_rate_pct: double>",
])

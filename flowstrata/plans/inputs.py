"""Packet-shaped inputs derived from the given ``events`` table.

The CASE texts are shared by the Spark queries and their SQL checks; everything
computed from these inputs is written twice, once per engine.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.silver import to_silver
from ..operators.validation import accepted, validate_records
from ..session import scratch_path
from ..sources.tables import read_frames

# Moment of the trailing windows and rates over the sparse view.
AS_OF = dt.datetime(2024, 1, 30, 23, 0, 0)

PACKET_SQL = """
  CASE WHEN event_id % 101 = 0 THEN 'not-a-date' WHEN event_id % 103 = 0 THEN ''
       ELSE {ts} || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+00:00'
                                      WHEN 3 THEN '+02:00' ELSE '+05:30' END END AS timestamp;
  CASE event_id % 6
    WHEN 0 THEN '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id AS STRING)
    WHEN 1 THEN '192.168.1.' || CAST(user_id AS STRING)
    WHEN 2 THEN '172.16.5.'  || CAST(user_id AS STRING)
    WHEN 3 THEN '172.64.5.'  || CAST(user_id AS STRING)
    WHEN 4 THEN '203.0.113.' || CAST(user_id AS STRING)
    ELSE 'fe80::' || CAST(user_id AS STRING) END AS src_ip;
  '198.51.100.' || CAST(event_id % 256 AS STRING) AS dst_ip;
  CASE WHEN event_type = 'error' THEN NULL
       ELSE CAST(1024 + (event_id * 7919) % 64000 AS INT) END AS src_port;
  CAST(CASE WHEN event_type = 'error' THEN NULL ELSE CASE event_id % 8
       WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 1900
       WHEN 5 THEN 5353 WHEN 6 THEN 51000 ELSE 9000 END END AS INT) AS dst_port;
  CASE event_type WHEN 'click' THEN 'tcp' WHEN 'view' THEN 'TCP' WHEN 'purchase' THEN 'udp'
       WHEN 'signup' THEN 'UDP' ELSE 'icmp' END AS protocol;
  CAST(CASE WHEN event_id % 107 = 0 THEN -1 ELSE floor(value * 10) END AS BIGINT) AS length;
  CAST(CASE event_id % 3 WHEN 0 THEN 64 WHEN 1 THEN 128 ELSE NULL END AS INT) AS ttl;
  CASE WHEN event_type IN ('click','view')
       THEN CASE event_id % 2 WHEN 0 THEN 'PA' ELSE 'S' END ELSE NULL END AS flags;
  'agent_' || CAST(user_id % 3 AS STRING) AS agent_id;
  CASE event_id % 8 WHEN 0 THEN 'HTTPS/TLS' WHEN 1 THEN 'HTTP GET /'
       WHEN 2 THEN 'DNS A example.com' ELSE NULL END AS service_info
"""
_SPARK_TEXT = "date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
# The dense view puts one packet every five seconds.
_DENSE_TS = "timestampadd(SECOND, CAST(event_id * 5 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"


def _expressions(ts: str) -> list[str]:
    return [part.strip() for part in PACKET_SQL.format(ts=_SPARK_TEXT.format(ts=ts)).split(";")]


def in_utc(query):
    """Runs a query function with the session in UTC."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events, split by row groups as the reader does."""
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets(spark: SparkSession, sf_dir: str, dense: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """``seq`` and the Bronze columns, one packet per event."""
    ts = _DENSE_TS if dense else "ts"
    return events(spark, sf_dir).selectExpr("event_id AS seq", *_expressions(ts), *extra)


def silver(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Silver rows with ``seq`` as arrival order."""
    return to_silver(accepted(validate_records(packets(spark, sf_dir, dense))), as_of=AS_OF, keep=["seq"])


def messy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: packets as JSON lines in many spellings, some unacceptable.

    By ``seq % 12``: 1 length as text, 2 length as whole float, 3 length with a
    fraction, 4 length missing, 5 port as text, 6 port out of range, 7 unknown
    field, 8 number for an address, 9 not JSON, 10 null protocol, 11 boolean ttl.
    """
    source = packets(spark, sf_dir)
    case = F.col("seq") % 12

    def quoted(name: str) -> Column:
        return F.coalesce(F.concat(F.lit('"'), F.col(name), F.lit('"')), F.lit("null"))

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))

    text_length = F.col("length").cast("string")
    length = (
        F.when(case == 1, F.concat(F.lit('"'), text_length, F.lit('"')))
        .when(case == 2, F.concat(text_length, F.lit(".0")))
        .when(case == 3, F.concat(F.abs("length").cast("string"), F.lit(".5")))
        .otherwise(text_length)
    )
    dst_port = F.when(case == 5, F.lit('"eighty"')).when(case == 6, F.lit("4294967296")).otherwise(plain("dst_port"))
    fields = {
        "timestamp": quoted("timestamp"),
        "src_ip": F.when(case == 8, F.lit("167772161")).otherwise(quoted("src_ip")),
        "dst_ip": quoted("dst_ip"),
        "src_port": plain("src_port"),
        "dst_port": dst_port,
        "protocol": F.when(case == 10, F.lit("null")).otherwise(quoted("protocol")),
        "length": F.when(case != 4, length),
        "ttl": F.when(case == 11, F.lit("true")).otherwise(plain("ttl")),
        "flags": quoted("flags"),
        "agent_id": quoted("agent_id"),
        "service_info": quoted("service_info"),
        "vlan": F.when(case == 7, plain("seq")),
    }
    members = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in fields.items()])
    value = F.when(case == 9, F.lit("{broken")).otherwise(F.concat(F.lit("{"), members, F.lit("}")))
    return source.select("seq", value.alias("value"))


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "element_at(array('capture_to_queue','queue_to_bronze','bronze_to_silver','silver_to_gold','other'),"
        " CAST(event_id % 5 + 1 AS INT)) AS stage",
        "value AS us",
        "event_id AS seq",
        "ts",
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'error'").selectExpr(
        "ts", "'component_' || CAST(user_id % 4 AS STRING) AS component", "'failed: ' || props AS error", "event_id AS seq"
    )


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "'gauge_' || CAST(user_id % 6 AS STRING) AS gauge",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 10 END AS value",
        "event_id AS seq",
    )


def counter_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter readings per agent; each reading may lack counters."""
    return events(spark, sf_dir).selectExpr(
        "'agent_' || CAST(user_id % 5 AS STRING) AS agent_id",
        "event_id AS seq",
        "CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id * 100 END AS os_recv",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * (user_id % 5) END AS os_drop",
        "CASE WHEN event_id % 7 = 0 THEN event_id END AS os_ifdrop",
        "event_id * 90 AS app_queued",
        "CAST(NULL AS BIGINT) AS app_dropped",
    )


def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four log rows per file at most: created, sealed, transferred, archived, as far as the file got."""
    shown = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || '+00:00'"
    return events(spark, sf_dir).selectExpr(
        "event_id AS seq",
        "'bronze/capture_' || CAST(event_id DIV 4 AS STRING) || '.ndjson' AS file_path",
        "element_at(array('ACTIVE','SEALED','TRANSFERRED','ARCHIVED'),"
        " CAST(LEAST(event_id % 4, (event_id DIV 4) % 4) + 1 AS INT)) AS state",
        "date_format(timestampadd(HOUR, CAST(event_id DIV 64 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00'), 'yyyy-MM-dd')"
        " AS partition_dt",
        "CAST((event_id DIV 64) % 24 AS INT) AS partition_hr",
        f"{shown} AS created_at",
        f"CASE WHEN LEAST(event_id % 4, (event_id DIV 4) % 4) >= 1 THEN {shown} END AS sealed_at",
        "CASE WHEN LEAST(event_id % 4, (event_id DIV 4) % 4) >= 2 THEN"
        f" CASE WHEN (event_id DIV 4) % 10 = 2 THEN 'unknown' ELSE {shown} END END AS transferred_at",
        "CAST(user_id * 1048576 AS BIGINT) AS size_bytes",
        "CAST(floor(value * 10) AS BIGINT) AS record_count",
        "'agent_' || CAST(user_id % 3 AS STRING) AS agent_id",
    )


def _text_hex(text: str) -> str:
    return text.encode("ascii").hex().upper()


def built_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Ethernet frame per event, put together field by field.

    Events with an IPv6 source become IPv6 frames. By ``seq % 16``: 5 is ARP,
    7 is cut to 20 bytes, 9 has a VLAN tag, 11 is a later fragment, 13 has IP
    options, 15 carries protocol 47; the rest are plain. A third of the packets
    to port 9000 go to 25 instead, a third of those to 1900 to 8080. The
    payload follows the destination port; ``seq % 50`` names the host (always
    15 characters, so that all length fields are known).
    """
    moved = F.when(F.col("seq") % 3 != 0, F.col("dst_port")).when(F.col("dst_port") == 9000, 25).when(
        F.col("dst_port") == 1900, 8080
    ).otherwise(F.col("dst_port"))
    source = packets(spark, sf_dir, extra=("ts AS at", "event_type")).withColumn("dst_port", moved)
    # One file of events would give one file of frames, and decoding one task.
    source = source.repartition(spark.sparkContext.defaultParallelism)
    case = F.col("seq") % 16
    ipv6 = F.col("src_ip").startswith("fe80")

    def be(value: Column | int, size: int) -> Column:
        number = F.lit(value) if isinstance(value, int) else value
        return F.lpad(F.hex(number.cast("bigint")), size * 2, "0")

    def quad(name: str) -> Column:
        # Octets above 255 (large user ids) are wrapped to one byte.
        return F.concat(*[
            be(F.split_part(F.col(name), F.lit("."), F.lit(i)).try_cast("int") % 256, 1) for i in (1, 2, 3, 4)
        ])

    label = F.concat(F.lit("68"), F.hex(F.encode(F.lpad((F.col("seq") % 50).cast("string"), 2, "0"), "US-ASCII")))
    host = F.concat(label, F.lit(_text_hex(".example.com")))
    # Record, handshake, version and random, no session id, one cipher suite,
    # no compression, one server_name extension: 76 bytes.
    tls = F.concat(
        F.lit("1603010047" + "01000043" + "0303" + "AB" * 32 + "00" + "00021301" + "0100"),
        F.lit("0018" + "0000" + "0014" + "0012" + "00" + "000F"), host,
    )
    # 44 bytes.
    http = F.concat(
        F.lit(_text_hex("GET /p/")), F.hex(F.encode((F.col("seq") % 7).cast("string"), "US-ASCII")),
        F.lit(_text_hex(" HTTP/1.1\r\nHost: ")), host, F.lit(_text_hex("\r\n\r\n")),
    )
    # 33 bytes.
    dns = F.concat(
        F.lit("00010100" + "00010000" + "00000000" + "03"), label,
        F.lit("07" + _text_hex("example") + "03" + _text_hex("com") + "00"),
        F.when(F.col("seq") % 4 == 2, "0001").otherwise("001C"), F.lit("0001"),
    )
    payload = (
        F.when(F.col("dst_port") == 443, tls).when(F.col("dst_port") == 80, http).when(F.col("dst_port") == 53, dns)
        .when(F.col("dst_port") == 22, F.lit(_text_hex("SSH-2.0-Demo_1.0\r\n")))
        .when(F.col("dst_port") == 25, F.lit(_text_hex("220 mail.example.com ready\r\n")))
        .when(F.col("dst_port") == 8080, F.lit(_text_hex("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")))
        .otherwise(F.lit("00FF10"))
    )
    size = (
        F.when(F.col("dst_port") == 443, 76).when(F.col("dst_port") == 80, 44).when(F.col("dst_port") == 53, 33)
        .when(F.col("dst_port") == 22, 18).when(F.col("dst_port") == 25, 28).when(F.col("dst_port") == 8080, 44)
        .otherwise(3)
    )
    kind = F.upper("protocol")
    ports = F.concat(be(F.col("src_port"), 2), be(F.col("dst_port"), 2))
    header = F.when(kind == "TCP", F.concat(
        ports, F.lit("00000001" + "00000000" + "50"), F.when(F.col("flags") == "PA", "18").otherwise("02"),
        F.lit("2000" + "0000" + "0000"),
    )).when(kind == "UDP", F.concat(ports, be(size + 8, 2), F.lit("0000")))
    segment = F.coalesce(F.concat(header, payload), F.lit("0800" + "0000" + "00010001" + _text_hex("ping")))
    segment_size = F.when(kind == "TCP", size + 20).when(kind == "UDP", size + 8).otherwise(12)
    number = F.when(case == 15, 47).when(kind == "TCP", 6).when(kind == "UDP", 17).otherwise(1)
    ip = F.concat(
        F.when(case == 13, "46").otherwise("45"), F.lit("00"),
        be(segment_size + F.when(case == 13, 24).otherwise(20), 2),
        F.lit("0001"), F.when(case == 11, "0005").otherwise("0000"),
        be(F.coalesce("ttl", F.lit(255)), 1), be(number, 1), F.lit("0000"), quad("src_ip"), quad("dst_ip"),
        F.when(case == 13, F.lit("01010101")).otherwise(""), segment,
    )
    link = F.concat(
        F.lit("FF" * 6 + "00" * 6), F.when(case == 9, F.lit("81000005")).otherwise(""),
        F.when(case == 5, "0806").when(ipv6, "86DD").otherwise("0800"),
    )
    ip6 = F.concat(
        F.lit("60000000"), be(segment_size, 2), be(number, 1), F.lit("40" + "FE80" + "00" * 14 + "FE80" + "00" * 14), segment
    )
    body = F.when(case == 5, F.lit("00" * 28)).when(ipv6, ip6).otherwise(ip)
    whole = F.concat(link, body, F.lit("00" * 6))
    return source.select(
        F.col("seq").alias("frame_id"),
        F.col("at").cast("timestamp").alias("captured_at"),
        F.unhex(F.left(whole, F.when(case == 7, 40).otherwise(1 << 16))).alias("frame"),
    )


_FRAME_TABLES: dict[tuple[str, str], str] = {}


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as a stored table, scanned. It is written once per application and data folder."""
    table = spark.sparkContext.applicationId, sf_dir
    if table not in _FRAME_TABLES:
        path = scratch_path(spark, "frames")
        built_frames(spark, sf_dir).write.parquet(path)
        _FRAME_TABLES[table] = path
    return read_frames(spark, _FRAME_TABLES[table])


GOLD_COLUMNS = [n for n in schemas.GOLD.fieldNames() if n != "computed_at"]
SILVER_COLUMNS = ["seq", *[n for n in schemas.SILVER.fieldNames() if n != "ingested_at"]]

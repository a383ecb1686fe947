"""Raw Ethernet frames to Bronze packet records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import frames as fr
from ..functions import payloads
from ..functions.timestamps import iso_text

_MIN_FRAME = 34


def _service(payload: Column) -> Column:
    """Label for the payload of a well-known port, or null."""
    tcp, udp, port = F.col("_kind") == "TCP", F.col("_kind") == "UDP", F.col("_port")
    is_hello = (
        tcp & (port == 443) & (fr.cut(payload, 0, 1) == fr.raw(0x16)) & (fr.cut(payload, 5, 1) == fr.raw(0x01))
    )
    is_dns = udp & (port == 53)
    return (
        F.when(is_hello, payloads.tls_label(F.when(is_hello, payload)))
        .when(tcp & port.isin(C.HTTP_PORTS), F.col("_http"))
        .when(is_dns, payloads.dns_label(F.when(is_dns, payload)))
        .when(tcp & (port == 22), payloads.banner(payload, "SSH-", "SSH"))
        .when(tcp & port.isin(C.SMTP_PORTS), payloads.banner(payload, "220", "SMTP"))
    )


def decode_frames(frames: DataFrame, agent_id: str = "", detect_services: bool = True) -> DataFrame:
    """``frame_id`` and the Bronze columns of every IPv4 frame.

    Short, non-IPv4 and malformed frames give no row. VLAN tags are skipped.
    Ports are read only from the first fragment and only if the transport
    header is complete. The payload ends where the IP total length says, so
    link padding is not part of it.
    """
    frame = F.col("frame")
    ipv4 = fr.raw(0x08, 0x00)

    def type_at(position: int) -> Column:
        return fr.cut(frame, position, 2)

    def tag_at(position: int) -> Column:
        return type_at(position).isin(bytes([0x81, 0x00]), bytes([0x88, 0xA8]))

    start = (
        F.when(type_at(12) == ipv4, 14)
        .when(tag_at(12) & (type_at(16) == ipv4), 18)
        .when(tag_at(12) & tag_at(16) & (type_at(20) == ipv4), 22)
    )
    # The IP packet, then its transport segment: every later position is fixed.
    packet, segment = F.col("_packet"), F.col("_segment")
    packets = (
        frames.where(F.length("frame") >= _MIN_FRAME)
        .withColumn("_packet", fr.cut(frame, start))
        .where(fr.cut(packet, 0, 1).between(fr.raw(0x45), fr.raw(0x4F)) & (F.length(packet) >= 20))
    )
    header = fr.uint(packet, 0).bitwiseAND(F.lit(0x0F)) * 4
    total = fr.uint(packet, 2, 2)
    segments = packets.withColumns({
        "_number": fr.uint(packet, 9),
        "_first": fr.uint(packet, 6, 2).bitwiseAND(F.lit(0x1FFF)) == 0,
        "_segment": F.when(total == 0, fr.cut(packet, header)).otherwise(
            fr.cut(packet, header, F.greatest(total - header, F.lit(0)))
        ),
    })
    is_tcp = (
        F.col("_first") & (F.col("_number") == 6) & (F.length(segment) >= 20)
        & (fr.cut(segment, 12, 1) >= fr.raw(0x50))
    )
    is_udp = F.col("_first") & (F.col("_number") == 17) & (F.length(segment) >= 8)
    layered = segments.withColumn("_kind", F.when(is_tcp, "TCP").when(is_udp, "UDP")).withColumns({
        "src_port": F.when(F.col("_kind").isNotNull(), fr.uint(segment, 0, 2)),
        "dst_port": F.when(F.col("_kind").isNotNull(), fr.uint(segment, 2, 2)),
    })
    record = {
        "timestamp": iso_text(F.col("captured_at")),
        "src_ip": fr.ipv4_text(packet, 12),
        "dst_ip": fr.ipv4_text(packet, 16),
        "src_port": F.col("src_port"),
        "dst_port": F.col("dst_port"),
        "protocol": fr.ip_protocol_name(F.col("_number")),
        "length": F.length("frame").cast("bigint"),
        "ttl": fr.uint(packet, 8),
        "flags": F.when(F.col("_kind") == "TCP", fr.tcp_flags_text(fr.uint(segment, 13))),
        "agent_id": F.lit(agent_id),
    }
    known = [record[n].alias(n) for n in schemas.BRONZE.fieldNames() if n != "service_info"]
    if not detect_services:
        out = layered.select("frame_id", *known, F.lit(None).cast("string").alias("service_info"))
        return out.select("frame_id", *schemas.BRONZE.fieldNames())

    # The payload is cut only where a label is possible.
    port = F.when(F.col("dst_port") != 0, F.col("dst_port")).otherwise(F.col("src_port"))
    labelled = port.isin(22, 53, 443, *C.HTTP_PORTS, *C.SMTP_PORTS)
    tcp_payload = fr.cut(segment, F.shiftright(fr.uint(segment, 12), 4) * 4)
    payload = F.when(labelled, F.when(F.col("_kind") == "TCP", tcp_payload).when(
        F.col("_kind") == "UDP", fr.cut(segment, 8)
    ))
    decoded = layered.select("frame_id", *known, port.alias("_port"), "_kind", payload.alias("_payload"))
    is_http = (F.col("_kind") == "TCP") & F.col("_port").isin(C.HTTP_PORTS)
    decoded = payloads.with_http_label(decoded, F.when(is_http, F.col("_payload")), "_http")
    service = F.when(F.length("_payload") > 0, _service(F.col("_payload")))
    return decoded.withColumn("service_info", service).select("frame_id", *schemas.BRONZE.fieldNames())

"""Packet search, recent packets and the shareable (masked) view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import network as net


# Stored columns that settle ties, so that orders are total up to equal rows.
_TIES = [
    "event_ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "ttl", "flags", "service_info", "agent_id",
]


def _port_argument(value: int | str | None) -> int | None:
    """A port bound, or None where the argument is absent, no number or out of range."""
    if value is None or value == "":
        return None
    try:
        port = int(value)
    except ValueError:
        return None
    return port if 0 <= port <= 65535 else None


def search_packets(
    silver: DataFrame,
    q: str | None = None,
    proto: str | None = None,
    src_subnet: str | None = None,
    dst_port_min: int | str | None = None,
    dst_port_max: int | str | None = None,
    port_category: str | None = None,
    sort: str | None = "ts_desc",
    where: str | None = None,
    tie_break: str = "src_ip",
    limit: int | None = None,
) -> DataFrame:
    """Packets passing all given filters, newest (``ts_desc``) or largest (``len_desc``) first.

    ``where`` takes any Spark SQL predicate. ``sort=None`` leaves the rows
    unordered; with a ``limit`` the order costs a top-k, not a full sort.
    """
    rows = silver
    if proto and proto.strip():
        rows = rows.where(F.upper("protocol") == proto.strip().upper())
    if src_subnet and src_subnet.strip():
        rows = rows.where(net.in_subnet(F.col("src_ip"), src_subnet))
    low, high = _port_argument(dst_port_min), _port_argument(dst_port_max)
    if low is not None:
        rows = rows.where(F.col("dst_port") >= low)
    if high is not None:
        rows = rows.where(F.col("dst_port") <= high)
    if port_category and port_category.strip():
        rows = rows.where(F.lower("port_category") == port_category.strip().lower())
    if where:
        rows = rows.where(where)
    if q and q.strip():
        text = F.concat_ws(
            " ", "src_ip", "dst_ip", F.col("src_port").cast("string"), F.col("dst_port").cast("string"), "service_info"
        )
        rows = rows.where(F.contains(F.lower(text), F.lit(q.strip().lower())))
    if sort is not None:
        lead = "length" if sort.strip() == "len_desc" else "event_ts"
        ties = [tie_break, *(c for c in _TIES if c not in (lead, tie_break) and c in rows.columns)]
        rows = rows.orderBy(F.desc(lead), *map(F.asc, ties))
    return rows if limit is None else rows.limit(limit)


def recent_packets(silver: DataFrame, arrival: str = "ingested_at", limit: int = C.RECENT_PACKETS) -> DataFrame:
    """The last packets to arrive, oldest first. Ties follow the stored columns, so the result is determined."""
    order = [arrival, *(c for c in _TIES if c != arrival and c in silver.columns)]
    return silver.orderBy(*map(F.desc, order)).limit(limit).orderBy(*map(F.asc_nulls_last, order))


def anonymize_packets(packets: DataFrame) -> DataFrame:
    """Masks private addresses, their ports and private source networks.

    Ports become text. Apply after filtering.
    """
    masked = {
        "src_port": net.mask_port(F.col("src_ip"), F.col("src_port")),
        "dst_port": net.mask_port(F.col("dst_ip"), F.col("dst_port")),
        "src_ip": net.mask_ip(F.col("src_ip")),
        "dst_ip": net.mask_ip(F.col("dst_ip")),
        "src_network": net.mask_subnet(F.col("src_network")),
    }
    return packets.withColumns({name: column for name, column in masked.items() if name in packets.columns})


def live_rows(packets: DataFrame, zone: str | None = None) -> DataFrame:
    """Display columns of the live view."""
    return packets.withColumns({
        "time": net.clock_text(F.col("event_ts"), zone),
        "source": net.endpoint(F.col("src_ip"), F.col("src_port")),
        "destination": net.endpoint(F.col("dst_ip"), F.col("dst_port")),
    })

"""Bronze records to Silver packet events: one projection and one filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import network as net
from ..functions import timestamps as iso


def to_silver(
    bronze: DataFrame,
    as_of=None,
    utc_buckets: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The Silver columns, for batch and streaming frames alike.

    Rows whose timestamp cannot be read are dropped. Hour and date follow the
    record's own offset, or UTC with ``utc_buckets``. ``keep`` names further
    input columns to carry along.
    """
    present = set(bronze.columns)

    def field(name: str, default: str | int | None = None) -> Column:
        dtype = schemas.BRONZE[name].dataType
        value = F.col(name).cast(dtype) if name in present else F.lit(None).cast(dtype)
        return value if default is None else F.coalesce(value, F.lit(default).cast(dtype))

    wall, offset = F.col("_wall_us"), F.col("_offset_us")
    if utc_buckets:
        hour, date = iso.hour_of(wall - offset, F.lit(0)), iso.date_of(wall - offset)
    else:
        hour, date = iso.hour_of(wall, offset), iso.date_of(wall)
    src_ip = field("src_ip", "0.0.0.0")
    columns = {
        "event_ts": iso.instant(wall, offset),
        "event_hour": hour,
        "event_date": date,
        "src_ip": src_ip,
        "dst_ip": field("dst_ip", "0.0.0.0"),
        "src_port": field("src_port"),
        "dst_port": field("dst_port"),
        "protocol": net.normalise_protocol(field("protocol")),
        "length": field("length", 0),
        "ttl": field("ttl"),
        "flags": field("flags"),
        "service_info": field("service_info"),
        "port_category": net.port_category(field("src_port"), field("dst_port")),
        "agent_id": field("agent_id", ""),
        "ingested_at": iso.as_instant(as_of),
        "src_network": net.source_network(src_ip),
    }
    return (
        iso.with_clock(bronze)
        .where(F.col("_wall_us").isNotNull())
        .select(*keep, *[columns[name].alias(name) for name in schemas.SILVER.fieldNames()])
    )

"""Totals and top-n breakdowns over Silver.

Each breakdown is a map-side combined aggregate followed by a top-n, which
Spark runs as a per-partition heap. ``breakdowns`` answers all of them from one
pass over the packets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import network as net
from .measures import packets, volume



def totals(silver: DataFrame) -> DataFrame:
    return silver.agg(
        packets(),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.min("ingested_at").alias("started_at"),
    )


def top(df: DataFrame, keys: list[str], limit: int | None, *measures: Column) -> DataFrame:
    """Groups by packets, descending; ties by key, ascending."""
    ordered = df.groupBy(*keys).agg(*(measures or (packets(),))).orderBy(F.desc("packets"), *keys)
    return ordered if limit is None else ordered.limit(limit)


def protocols(silver: DataFrame, limit: int | None = C.TOP_N) -> DataFrame:
    return top(silver, ["protocol"], limit, packets(), volume())


def source_ips(silver: DataFrame, limit: int | None = C.TOP_N) -> DataFrame:
    return top(silver, ["src_ip"], limit)


def destination_ips(silver: DataFrame, limit: int | None = C.TOP_N) -> DataFrame:
    return top(silver, ["dst_ip"], limit)


def subnets(silver: DataFrame, limit: int | None = C.TOP_N) -> DataFrame:
    return top(silver, ["src_network"], limit)


def destination_ports(silver: DataFrame, limit: int | None = C.TOP_N) -> DataFrame:
    return top(silver.where(F.col("dst_port").isNotNull()), ["dst_port"], limit)


def ports(silver: DataFrame, limit: int | None = C.PORT_TOP_N) -> DataFrame:
    return top(silver.where(F.col("dst_port").isNotNull()), ["dst_port", "protocol"], limit, packets(), volume())


def services(silver: DataFrame, limit: int | None = C.TOP_N) -> DataFrame:
    return top(silver.where(F.col("service_info") != ""), ["service_info"], limit, packets(), volume())


def with_share(breakdown: DataFrame, silver: DataFrame) -> DataFrame:
    """Adds ``pct``: packets in percent of all packets (a scalar subquery)."""
    total = silver.agg(F.count(F.lit(1))).scalar()
    return breakdown.withColumn("pct", net.percent_of(F.col("packets"), total))


def protocol_view(silver: DataFrame, limit: int | None = C.TOP_N) -> DataFrame:
    """Protocols with share and mean packet size."""
    view = with_share(protocols(silver, limit), silver)
    return view.withColumn("avg_size", F.coalesce(F.try_divide(F.col("bytes"), F.col("packets")), F.lit(0.0)))


PORT_MODES = ("all", "hide_os_noise", "only_well_known")


def port_view(silver: DataFrame, mode: str = "all", limit: int | None = C.PORT_TOP_N) -> DataFrame:
    """Ports with service name, share of all packets and readable size.

    The mode filters the packets before the cut to ``limit`` rows.
    """
    if mode == "all":
        chosen = silver
    elif mode == "hide_os_noise":
        chosen = silver.where(~F.col("dst_port").isin(C.OS_NOISE_PORTS))
    elif mode == "only_well_known":
        chosen = silver.where(F.col("dst_port").isin(list(C.PORT_SERVICES)))
    else:
        raise ValueError(f"mode must be one of {PORT_MODES}")
    return with_share(ports(chosen, limit), silver).withColumns({
        "service": net.service_name(F.col("dst_port")),
        "size": net.human_bytes(F.col("bytes")),
    })


# Breakdown name -> (key columns, rows kept).
BREAKDOWNS = {
    "protocols": (["protocol"], C.TOP_N),
    "top_src_ips": (["src_ip"], C.TOP_N),
    "top_dst_ips": (["dst_ip"], C.TOP_N),
    "top_subnets": (["src_network"], C.TOP_N),
    "top_dst_ports": (["dst_port"], C.TOP_N),
    "port_stats": (["dst_port", "protocol"], C.PORT_TOP_N),
    "services": (["service_info"], C.TOP_N),
}


def breakdown_counts(silver: DataFrame) -> DataFrame:
    """All groups of all breakdowns from one scan: ``breakdown, name, protocol, packets, bytes``, in no order.

    Grouping sets combine on the map side. Counts of several tables add up.
    """
    columns = ["protocol", "src_ip", "dst_ip", "src_network", "dst_port", "service_info"]
    sets = [[F.col(k) for k in keys] for keys, _ in BREAKDOWNS.values()]

    # grouping_id has one bit per column, the first column highest, set if rolled up.
    def grouping_id(keys: list[str]) -> int:
        return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)

    label = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for breakdown, (keys, _) in BREAKDOWNS.items():
        here = F.col("_gid") == grouping_id(keys)
        label = F.when(here, F.lit(breakdown)).otherwise(label)
        name = F.when(here, F.col(keys[0]).cast("string")).otherwise(name)
    return (
        silver.groupingSets(sets, *columns)
        .agg(F.grouping_id().alias("_gid"), packets(), volume())
        .select(
            label.alias("breakdown"),
            name.alias("name"),
            F.when(F.col("_gid") == grouping_id(["dst_port", "protocol"]), F.col("protocol")).alias("protocol"),
            "packets",
            "bytes",
        )
        .where(~(F.col("breakdown").isin(*_BY_PORT) & F.col("name").isNull()))
        .where(~((F.col("breakdown") == "services") & (F.coalesce("name", F.lit("")) == "")))
    )


_BY_PORT = ("top_dst_ports", "port_stats")


def rank_breakdowns(counts: DataFrame) -> DataFrame:
    """The first groups of each breakdown: ``breakdown, rank, name, protocol, packets, bytes``.

    The rank filter is pushed below the window shuffle, so at most the kept rows of each breakdown leave a task.
    """
    port = F.when(F.col("breakdown").isin(*_BY_PORT), F.col("name").cast("int"))
    order = Window.partitionBy("breakdown").orderBy(F.desc("packets"), F.asc("_port"), F.asc("name"), F.asc("protocol"))
    keep = F.when(F.col("breakdown") == "port_stats", C.PORT_TOP_N).otherwise(C.TOP_N)
    return (
        counts.withColumn("_port", port)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= C.PORT_TOP_N)
        .where(F.col("rank") <= keep)
        .select("breakdown", "rank", "name", "protocol", "packets", "bytes")
    )


def breakdowns(silver: DataFrame) -> DataFrame:
    """All breakdowns from one scan: ``breakdown, rank, name, protocol, packets, bytes``."""
    return rank_breakdowns(breakdown_counts(silver))

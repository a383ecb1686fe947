"""Reports and alerts over Silver: further uses of the tables, built from plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.timestamps import as_instant, floor_to
from . import traffic
from .measures import packets, volume
from .windows import prune_to



def bucket(ts: Column, minutes: int) -> Column:
    return F.timestamp_micros(floor_to(F.unix_micros(ts), minutes * 60_000_000))


def drop_rate_alerts(health: DataFrame, threshold: float = C.HEALTH_YELLOW_MAX) -> DataFrame:
    return health.where(F.col("drop_rate_pct") > threshold)


def window_volumes(silver: DataFrame, minutes: int = 60) -> DataFrame:
    return silver.groupBy(bucket(F.col("event_ts"), minutes).alias("window_start")).agg(packets(), volume())


def volume_vs_previous_day(silver: DataFrame, minutes: int = 60) -> DataFrame:
    """Each window next to the same window a day earlier, with the change in percent."""
    now = window_volumes(silver, minutes)
    # Each window stands for itself and for the day after; the two meet in one aggregate over window totals.
    roles = F.array(
        F.struct(F.col("window_start").alias("at"), F.lit(False).alias("earlier")),
        F.struct((F.col("window_start") + F.expr("INTERVAL 24 HOURS")).alias("at"), F.lit(True).alias("earlier")),
    )
    met = now.select("packets", "bytes", F.inline(roles)).groupBy(F.col("at").alias("window_start")).agg(*[
        F.max(F.when(F.col("earlier") == role, F.col(name))).alias(name + suffix)
        for role, suffix in ((False, ""), (True, "_before")) for name in ("packets", "bytes")
    ])
    change = F.when(F.col("bytes_before") > 0, (F.col("bytes") - F.col("bytes_before")) * 100.0 / F.col("bytes_before"))
    return met.where(F.col("packets").isNotNull()).withColumn("change_pct", change)


def new_top_talkers(silver: DataFrame, known: DataFrame, limit: int = C.TOP_N) -> DataFrame:
    """Busiest source addresses that are not in ``known(src_ip)``."""
    return _new_talkers(silver, known, "src_ip", limit)


def new_top_destinations(silver: DataFrame, known: DataFrame, limit: int = C.TOP_N) -> DataFrame:
    """Busiest destination addresses that are not in ``known(dst_ip)``."""
    return _new_talkers(silver, known, "dst_ip", limit)


def _new_talkers(silver: DataFrame, known: DataFrame, key: str, limit: int) -> DataFrame:
    """Addresses are counted first and cut last, so known ones take no place in the list."""
    counted = traffic.top(silver, [key], None).join(known.select(key).distinct(), key, "left_anti")
    return counted.orderBy(F.desc("packets"), key).limit(limit)


def _top_names(grouped: DataFrame, by: list[str], key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("packets"), F.asc(key))
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


_HOUR_US = 3_600_000_000


def _utc_hour() -> dict[str, Column]:
    """Hour of the event in UTC, as its start, weekday (1 = Sunday) and hour of day; all three from one clock."""
    hours = F.call_function("div", floor_to(F.unix_micros("event_ts"), _HOUR_US), F.lit(_HOUR_US))
    days = F.floor(hours / 24).cast("bigint")
    return {
        "hour_start": F.timestamp_micros(hours * _HOUR_US),
        "weekday": (F.pmod(days + 4, F.lit(7)) + 1).cast("int"),  # 1970-01-01 was a Thursday
        "hour": F.pmod(hours, F.lit(24)).cast("int"),
    }


def _per_hour(silver: DataFrame) -> DataFrame:
    return silver.withColumns(_utc_hour()).groupBy("hour_start", "weekday", "hour").agg(packets(), volume())


def hour_weekday_profile(silver: DataFrame) -> DataFrame:
    """Mean packets and bytes per UTC hour for each weekday (1 = Sunday) and hour of day."""
    return _per_hour(silver).groupBy("weekday", "hour").agg(
        F.count(F.lit(1)).alias("hours_seen"),
        F.avg("packets").alias("mean_packets"),
        F.avg("bytes").alias("mean_bytes"),
    )


def profile_top(silver: DataFrame, key: str, limit: int = C.TOP_N) -> DataFrame:
    """Top values of one column for each weekday and hour of day, in UTC."""
    known = silver.where(F.col(key).isNotNull()).withColumns(_utc_hour())
    return _top_names(known.groupBy("weekday", "hour", key).agg(packets()), ["weekday", "hour"], key, limit)


def profile_protocol_mix(silver: DataFrame) -> DataFrame:
    """Share of each protocol in the packets of each weekday and hour of day."""
    counted = silver.withColumns(_utc_hour()).groupBy("weekday", "hour", "protocol").agg(packets())
    whole = F.sum("packets").over(Window.partitionBy("weekday", "hour"))
    return counted.withColumn("pct", F.col("packets") * 100.0 / whole)


def profile_deviation(silver: DataFrame) -> DataFrame:
    """Each hour's bytes relative to the mean of its weekday and hour; one aggregate, then a window over hours."""
    slot = Window.partitionBy("weekday", "hour")
    ratio = F.when(F.col("mean_bytes") > 0, F.col("bytes") / F.col("mean_bytes"))
    scored = _per_hour(silver).withColumn("mean_bytes", F.avg("bytes").over(slot))
    return scored.select("hour_start", "weekday", "hour", "packets", "bytes", "mean_bytes", ratio.alias("ratio"))


_FLOW = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def flows(silver: DataFrame) -> DataFrame:
    """Packets, bytes and duration per 5-tuple."""
    return (
        silver.groupBy(*_FLOW)
        .agg(packets(), volume(), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"))
        .withColumn("duration_sec", (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6)
    )


def flow_sessions(silver: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Flows cut where a 5-tuple is silent for ``gap_seconds`` or longer.

    Packets are first combined, on the map side, into slots as wide as the gap:
    two packets of one slot are always in the same session, so this is exact.
    The window then sees one row per key and slot, also for a 5-tuple that
    holds a large part of all packets.
    """
    gap_us = gap_seconds * 1_000_000
    slot = floor_to(F.unix_micros("event_ts"), gap_us).alias("slot")
    slots = silver.groupBy(*_FLOW, slot).agg(
        packets(), volume(), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen")
    )
    order = Window.partitionBy(*_FLOW).orderBy("slot")
    silence = F.unix_micros("first_seen") - F.unix_micros(F.lag("last_seen").over(order))
    starts = slots.withColumn("_starts", F.when(silence < gap_us, 0).otherwise(1))
    numbered = starts.withColumn("session", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(*_FLOW, "session")
        .agg(
            F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
        .withColumn("duration_sec", (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6)
    )


def main_service(silver: DataFrame) -> DataFrame:
    """The service seen most often per source address."""
    grouped = silver.where(F.col("service_info") != "").groupBy("src_ip", "service_info").agg(packets())
    return _top_names(grouped, ["src_ip"], "service_info", 1).drop("rank")


def subnet_report(silver: DataFrame, limit: int = 3) -> DataFrame:
    """Top destination ports per source network with the volume of the network; both from one grouped aggregate."""
    per_port = silver.groupBy("src_network", "dst_port").agg(packets(), volume())
    whole = per_port.groupBy("src_network").agg(
        F.sum("packets").alias("subnet_packets"), F.sum("bytes").alias("subnet_bytes")
    )
    best = _top_names(per_port.where(F.col("dst_port").isNotNull()), ["src_network"], "dst_port", limit)
    return whole.join(best.withColumnRenamed("src_network", "_network"), F.col("src_network").eqNullSafe(F.col("_network")), "left").drop("_network")


def last_hours(silver: DataFrame, hours: int, as_of=None) -> DataFrame:
    """Volume by address, port and service over the last hours (for export)."""
    moment = as_instant(as_of)
    since = F.timestamp_micros(F.unix_micros(moment) - F.lit(hours * 3_600_000_000))
    rows = prune_to(silver, as_of, hours * 60).where((F.col("event_ts") >= since) & (F.col("event_ts") <= moment))
    return rows.groupBy("src_ip", "dst_port", "service_info").agg(packets(), volume())


def periodic(silver: DataFrame, unit: str = "week") -> DataFrame:
    """Volume per day or week."""
    return silver.groupBy(F.date_trunc(unit, F.col("event_date").cast("timestamp")).cast("date").alias("period")).agg(
        packets(), volume(), F.approx_count_distinct("src_ip").alias("approx_src_ips")
    )


PERIODS = ("day", "week")
PERIODIC = {"protocol": "protocol", "src_ip": "src_ip", "dst_ip": "dst_ip", "subnet": "src_network", "dst_port": "dst_port"}


def periodic_report(silver: DataFrame, units: tuple[str, ...] = PERIODS, limit: int = C.TOP_N) -> DataFrame:
    """Top names of each breakdown per period, with the exact number of names and the period's volume.

    ``unit, period, breakdown, rank, name, packets, bytes, names, period_packets, period_bytes``. Names that are null are
    in the period's volume only. One scan counts per day and name by grouping sets; longer periods add up days. A name has
    one row per period then, so distinct names are a plain count, and ranks are cut before the shuffle.
    """
    columns = list(dict.fromkeys(PERIODIC.values()))
    daily = silver.select("event_date", *[F.col(c).cast("string").alias(c) for c in columns], "length").groupingSets(
        [[F.col("event_date"), F.col(c)] for c in columns], "event_date", *columns
    ).agg(F.grouping_id().alias("_gid"), packets(), volume())
    everything = (1 << len(columns)) - 1
    breakdown, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, column in PERIODIC.items():
        here = F.col("_gid") == everything - (1 << (len(columns) - 1 - columns.index(column)))
        breakdown, name = F.when(here, label).otherwise(breakdown), F.when(here, F.col(column)).otherwise(name)
    starts = [
        F.struct(F.lit(u).alias("unit"), F.date_trunc(u, F.col("event_date").cast("timestamp")).cast("date").alias("period"))
        for u in units
    ]
    named = daily.select(F.inline(F.array(*starts)), breakdown.alias("breakdown"), name.alias("name"), "packets", "bytes")
    by = ["unit", "period", "breakdown"]
    counted = named.groupBy(*by, "name").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    whole = counted.groupBy(*by).agg(
        F.count("name").alias("names"), F.sum("packets").alias("period_packets"), F.sum("bytes").alias("period_bytes")
    )
    best = _top_names(counted.where(F.col("name").isNotNull()), by, "name", limit)
    return best.join(whole, by)


def between(silver: DataFrame, start, end) -> DataFrame:
    """Rows of an arbitrary window; feed it to any breakdown. Dates are bounded too, a day wider for other offsets."""
    first, last = as_instant(start), as_instant(end)
    return silver.where(
        (F.col("event_ts") >= first) & (F.col("event_ts") < last)
        & F.col("event_date").between(F.date_sub(first.cast("date"), 1), F.date_add(last.cast("date"), 1))
    )


def volume_spikes(silver: DataFrame, minutes: int = 60, history: int = 24, sigmas: float = 3.0) -> DataFrame:
    """Windows whose bytes per (source, port) exceed mean + n * stddev of earlier windows.

    The frame runs over window totals, not packets: one row per key and window.
    """
    per = (
        silver.where(F.col("dst_port").isNotNull())
        .groupBy("src_ip", "dst_port", bucket(F.col("event_ts"), minutes).alias("window_start"))
        .agg(volume())
    )
    past = Window.partitionBy("src_ip", "dst_port").orderBy("window_start").rowsBetween(-history, -1)
    scored = per.withColumns({
        "mean_bytes": F.avg("bytes").over(past),
        "stddev_bytes": F.stddev_samp("bytes").over(past),
    })
    return scored.where(F.col("bytes") > F.col("mean_bytes") + sigmas * F.col("stddev_bytes"))


def ephemeral_fanout(silver: DataFrame, floor: int = 32768, targets=(80, 443), min_packets: int = 1) -> DataFrame:
    """Sources with many packets from high ports to web ports."""
    return (
        silver.where((F.col("src_port") > floor) & F.col("dst_port").isin(list(targets)))
        .groupBy("src_ip")
        .agg(packets(), F.count_distinct("dst_ip").alias("targets"), F.count_distinct("src_port").alias("src_ports"))
        .where(F.col("packets") >= min_packets)
    )


def ttl_distribution(silver: DataFrame) -> DataFrame:
    return silver.where(F.col("ttl").isNotNull()).groupBy("ttl").agg(packets())


def low_ttl_share(silver: DataFrame, below: int = 65) -> DataFrame:
    known = F.count("ttl")
    low = F.count_if(F.col("ttl") < below)
    return silver.agg(
        known.alias("packets"), low.alias("low"),
        F.when(known > 0, low * 100.0 / known).otherwise(0.0).alias("low_pct"),
    )

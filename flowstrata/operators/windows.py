"""Minute buckets and trailing windows of bytes per protocol, subnet and service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.timestamps import as_instant, minute_of

DIMENSIONS = {"protocol": "protocol", "subnet": "src_network", "service": "service_info"}


def minute_buckets(silver: DataFrame, dimensions=tuple(DIMENSIONS), newest: bool = False) -> DataFrame:
    """``minute, dimension, name, packets, bytes``, one scan for all dimensions; with ``newest`` also the last event time.

    Null and empty services form no bucket.
    """
    last = [F.max("event_ts").alias("newest")] if newest else []
    columns = [DIMENSIONS[d] for d in dimensions]
    keyed = silver.select(minute_of(F.col("event_ts")).alias("minute"), *columns, "length", "event_ts")
    if len(columns) == 1:
        grouped = keyed.groupBy("minute", *columns).agg(
            F.lit(0).alias("_gid"), F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), *last
        )
    else:
        sets = [[F.col("minute"), F.col(c)] for c in columns]
        grouped = keyed.groupingSets(sets, "minute", *columns).agg(
            F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), *last
        )
    everything = (1 << len(columns)) - 1
    dimension: Column = F.lit(None).cast("string")
    name: Column = F.lit(None).cast("string")
    for i, (label, column) in enumerate(zip(dimensions, columns)):
        here = F.col("_gid") == everything - (1 << (len(columns) - 1 - i))
        dimension = F.when(here, F.lit(label)).otherwise(dimension)
        name = F.when(here, F.col(column)).otherwise(name)
    return (
        grouped.select("minute", dimension.alias("dimension"), name.alias("name"), "packets", "bytes", *(["newest"] if newest else []))
        .where(~((F.col("dimension") == "service") & (F.coalesce("name", F.lit("")) == "")))
    )


def latest(silver: DataFrame) -> Column:
    """The newest event time of the table, as a scalar subquery."""
    return silver.agg(F.max("event_ts")).scalar()


def prune_to(silver: DataFrame, as_of, minutes: int) -> DataFrame:
    """Rows that can lie in a trailing window.

    ``event_date`` is bounded as well (own-offset dates differ from UTC by less than a day), so that partitions are
    pruned: by a literal for a fixed ``as_of``, by the subquery's result at run time for a column.
    """
    moment = as_instant(as_of)
    micros = F.unix_micros(moment) - F.lit(minutes * 60_000_000)
    # The bucket start counts, so the whole first minute may be outside.
    first = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int") - 1)
    return silver.where((F.col("event_ts") >= F.timestamp_micros(micros)) & (F.col("event_date") >= first))


def trailing_windows(
    silver: DataFrame,
    as_of,
    dimensions=tuple(DIMENSIONS),
    limit: int = C.TOP_N,
) -> DataFrame:
    """``dimension, window, name, bytes, rank, bar_pct`` for the 5/10/30/60 minute windows.

    A minute is inside a window if ``as_of - minute start <= span``. Each
    bucket is read once and added to every window it belongs to; ``bar_pct`` is
    the size relative to the largest entry of its window.
    """
    span = max(C.WINDOW_MINUTES.values())
    return rank_windows(minute_buckets(prune_to(silver, as_of, span), dimensions), as_of, limit)


def rank_windows(buckets: DataFrame, as_of, limit: int = C.TOP_N) -> DataFrame:
    """The same from minute buckets, which may come in several rows per minute, dimension and name."""
    moment = as_instant(as_of)
    age = F.unix_micros(moment) - F.unix_micros("minute")

    measures = []
    for label, minutes in C.WINDOW_MINUTES.items():
        inside = age <= minutes * 60_000_000
        measures.append(F.count_if(inside).alias(f"n_{label}"))
        measures.append(F.coalesce(F.sum(F.when(inside, F.col("bytes"))), F.lit(0)).alias(f"b_{label}"))
    wide = buckets.groupBy("dimension", "name").agg(*measures)
    entries = F.array(*[
        F.struct(F.lit(label).alias("window"), F.col(f"n_{label}").alias("n"), F.col(f"b_{label}").alias("bytes"))
        for label in C.WINDOW_MINUTES
    ])
    long = (
        wide.select("dimension", "name", F.inline(entries))
        .where(F.col("n") > 0)
        .select("dimension", "window", "name", "bytes")
    )
    order = Window.partitionBy("dimension", "window").orderBy(F.desc("bytes"), "name")
    # The rank filter is applied before the shuffle too: a task sends at most
    # ``limit`` rows per window, however many names there are.
    ranked = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    largest = F.max("bytes").over(Window.partitionBy("dimension", "window"))
    bar = F.when(largest > 0, F.col("bytes") * F.lit(100.0) / largest).otherwise(F.lit(0.0))
    return ranked.withColumn("bar_pct", bar)


def protocol_windows(silver: DataFrame, as_of, limit: int = C.TOP_N) -> DataFrame:
    return trailing_windows(silver, as_of, ("protocol",), limit).drop("dimension")


def subnet_windows(silver: DataFrame, as_of, limit: int = C.TOP_N) -> DataFrame:
    return trailing_windows(silver, as_of, ("subnet",), limit).drop("dimension")


def service_windows(silver: DataFrame, as_of, limit: int = C.TOP_N) -> DataFrame:
    return trailing_windows(silver, as_of, ("service",), limit).drop("dimension")

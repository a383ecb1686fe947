"""Helpers shared by the training-data operators.

Column names that begin with ``__llm_`` are the operators' own: a column so named is replaced and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# A word is a run of anything but ASCII white space (fixed by the data contract).
# On UTF-8 bytes ``bytes.split()`` finds the same words.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Copies of one row that a single output row may stand for before it is split.
_CHUNK = 65_536


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small: at most 16 MB or 2,000 rows each."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def hashable(df: DataFrame) -> list[str]:
    """The columns that Spark can hash: those without maps."""
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes a table below ``spark.checkpoint.dir`` and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path, cleanup = scratch_path(spark, label), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")  # the table replaces the shuffle files
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Null-safe equality of equally named columns."""
    matched = F.lit(True)
    for name in columns:
        matched = matched & left[name].eqNullSafe(right[name])
    return matched


def null_safe_join(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Joins on equally named columns, nulls matching nulls; the left columns stay."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in columns})
    matched = F.lit(True)
    for name in columns:
        matched = matched & left[name].eqNullSafe(renamed[f"_right_{name}"])
    return left.join(renamed, matched, how).drop(*(f"_right_{c}" for c in columns))


def numbered(rows: DataFrame, group: list[str], order: list[str], buckets: int) -> DataFrame:
    """Gives all rows of a group gapless positions without bringing the group together.

    Equal rows are counted before the shuffle. Each distinct row comes back with ``copies`` (65,536 at most; more
    copies come as several rows) and ``start``, the 0-based position of its first copy in the group. Positions
    follow a hash bucket of the ``order`` columns and then the row's values, so they depend on the rows alone.
    A task holds the rows of one bucket: a group's rows divided by ``buckets``.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    counted = (
        counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {_CHUNK}"))))
        .withColumn("copies", F.least(F.lit(_CHUNK).cast("bigint"), F.col("_n") - F.col("_chunk") * _CHUNK))
        .withColumn("_bucket", F.pmod(F.xxhash64(*order, "_chunk"), F.lit(buckets)))
        .drop("_n")
    )
    counted = save(counted, "numbered")
    key = [*group, "_bucket"]
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy(*key).agg(F.sum("copies").alias("_all")).select(
        *key, F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*key).orderBy(*columns, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = null_safe_join(ranked, offsets, key)
    return placed.select(*columns, "copies", (F.col("_offset") + F.col("_before")).alias("start"))


def expanded(rows: DataFrame, name: str) -> DataFrame:
    """One row per copy of what ``numbered`` returns, its position in column ``name``."""
    positions = F.sequence(F.col("start"), F.col("start") + F.col("copies") - 1)
    return rows.withColumn(name, F.explode(positions)).drop("start", "copies")

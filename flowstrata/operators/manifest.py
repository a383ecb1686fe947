"""Bronze file manifest: an append-only log whose last row per file is its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions.timestamps import as_instant, iso_text, parse_instant

ACTIVE, SEALED, TRANSFERRED, ARCHIVED = "ACTIVE", "SEALED", "TRANSFERRED", "ARCHIVED"
_COLUMNS = schemas.MANIFEST.fieldNames()


def current_state(log: DataFrame) -> DataFrame:
    """The last row per file; earlier rows are dropped before the shuffle too."""
    last = Window.partitionBy("file_path").orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n")


def in_state(log: DataFrame, state: str) -> DataFrame:
    return current_state(log).where(F.col("state") == state)


def pending_transfer(log: DataFrame) -> DataFrame:
    return in_state(log, SEALED)


def _next_seq(log: DataFrame) -> Column:
    return F.coalesce(log.agg(F.max("seq")).scalar(), F.lit(0)) + 1


def _advance(log: DataFrame, files: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """New log rows for known files; requests for unknown files give none."""
    wanted = files.dropDuplicates(["file_path"]).select(
        "file_path", *[F.col(c).alias(f"_new_{c}") for c in files.columns if c != "file_path"]
    )
    joined = current_state(log).join(wanted, "file_path")
    return joined.withColumns({"seq": _next_seq(log), **changes}).select(*_COLUMNS)


def seal(log: DataFrame, files: DataFrame, as_of=None) -> DataFrame:
    """Rows that seal ``files(file_path, size_bytes, record_count)``."""
    return _advance(log, files, {
        "state": F.lit(SEALED),
        "sealed_at": iso_text(as_instant(as_of)),
        "size_bytes": F.col("_new_size_bytes"),
        "record_count": F.col("_new_record_count"),
    })


def mark_transferred(log: DataFrame, files: DataFrame, as_of=None) -> DataFrame:
    return _advance(log, files.select("file_path"), {
        "state": F.lit(TRANSFERRED),
        "transferred_at": iso_text(as_instant(as_of)),
    })


def mark_archived(log: DataFrame, files: DataFrame) -> DataFrame:
    return _advance(log, files.select("file_path"), {"state": F.lit(ARCHIVED)})


def compaction_candidates(log: DataFrame, small_bytes: int = C.NDJSON_SMALL_BYTES) -> DataFrame:
    """Hour partitions with at least two small sealed files, with their totals."""
    return (
        pending_transfer(log)
        .where(F.col("size_bytes") < small_bytes)
        .groupBy("partition_dt", "partition_hr")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size_bytes").alias("size_bytes"),
            F.sum("record_count").alias("record_count"),
        )
        .where(F.col("files") >= 2)
    )


def compaction_files(log: DataFrame, small_bytes: int = C.NDJSON_SMALL_BYTES) -> DataFrame:
    """The small sealed files of those partitions."""
    small = pending_transfer(log).where(F.col("size_bytes") < small_bytes)
    return small.join(
        compaction_candidates(log, small_bytes).select("partition_dt", "partition_hr"),
        ["partition_dt", "partition_hr"],
        "left_semi",
    ).select(*_COLUMNS)


def retention_candidates(log: DataFrame, as_of=None, hours: int = C.BRONZE_RETENTION_HOURS) -> DataFrame:
    """Transferred files older than ``hours``; unreadable times are never old."""
    cutoff = F.timestamp_micros(F.unix_micros(as_instant(as_of)) - F.lit(hours * 3_600_000_000))
    return in_state(log, TRANSFERRED).where(parse_instant(F.col("transferred_at")) < cutoff)

"""Removing data that is past its retention time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from .. import constants as C
from .. import files
from ..operators import manifest as manifest_ops
from ..sinks.writers import append_manifest
from ..sources.tables import read_manifest

_DAYS = {"silver": C.SILVER_RETENTION_DAYS, "gold": C.GOLD_RETENTION_DAYS}
_PREFIX = "event_date="
_SLICE = 10_000


def expired_partitions(spark: SparkSession, root: str, cutoff: dt.date) -> list[str]:
    """Names of date partitions before the cut-off; other names are left alone."""
    out = []
    for name, is_directory in files.children(spark, root):
        if not is_directory or not name.startswith(_PREFIX):
            continue
        try:
            day = dt.date.fromisoformat(name[len(_PREFIX):])
        except ValueError:
            continue
        if day < cutoff:
            out.append(name)
    return sorted(out)


def enforce_retention(
    spark: SparkSession, root: str, days: int | None = None, layer: str = "silver", as_of: dt.date | None = None
) -> int:
    """Deletes date partitions older than ``days``; returns how many."""
    keep = days if days is not None else _DAYS.get(layer, C.GOLD_RETENTION_DAYS)
    today = as_of or dt.datetime.now(dt.timezone.utc).date()
    return sum(
        files.delete(spark, f"{root}/{name}")
        for name in expired_partitions(spark, root, today - dt.timedelta(days=keep))
    )


def enforce_bronze_retention(
    spark: SparkSession, manifest_path: str, hours: int = C.BRONZE_RETENTION_HOURS, as_of=None
) -> int:
    """Deletes transferred Bronze files older than ``hours`` and archives them in the manifest.

    Returns how many files were deleted (a file already gone is only archived).
    """
    log = read_manifest(spark, manifest_path)
    # The names are read in slices: the log grows only after all are known.
    names = [r["file_path"] for r in
             manifest_ops.retention_candidates(log, as_of, hours).select("file_path").toLocalIterator()]
    removed = 0
    for start in range(0, len(names), _SLICE):
        part = names[start : start + _SLICE]
        removed += sum(files.delete(spark, p) for p in part if files.exists(spark, p))
        gone = spark.createDataFrame([(p,) for p in part], "file_path string")
        append_manifest(manifest_ops.mark_archived(log, gone), manifest_path)
    return removed

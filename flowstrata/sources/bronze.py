"""Bronze NDJSON: one JSON record per line below ``dt=YYYY-MM-DD/hr=HH``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..operators.validation import accepted, validate_json

_LINE = "value string, dt date, hr int"


def read_lines(spark: SparkSession, root: str, dt_from: str | None = None, dt_to: str | None = None) -> DataFrame:
    """Raw lines with their ``dt`` and ``hr``; the bounds prune partitions."""
    if not files.exists(spark, root):
        return spark.createDataFrame([], _LINE)
    lines = spark.read.text(root)
    if "dt" not in lines.columns:  # no file left below the root
        return spark.createDataFrame([], _LINE)
    if dt_from is not None:
        lines = lines.where(F.col("dt") >= F.lit(dt_from).cast("date"))
    if dt_to is not None:
        lines = lines.where(F.col("dt") <= F.lit(dt_to).cast("date"))
    return lines.where(F.trim("value") != "")


def read_bronze(spark: SparkSession, root: str, **bounds: str) -> DataFrame:
    """Valid records with typed columns and ``_rescued_data``."""
    return accepted(validate_json(read_lines(spark, root, **bounds)))


def stream_lines(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """New files as a stream of lines; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(_LINE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(root).where(F.trim("value") != "")

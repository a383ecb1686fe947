"""Scans of the stored tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files, schemas


def _partitioned(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Hive-partitioned Parquet with ``event_date`` typed as a date.

    Other partition levels (hour, ingest batch) exist for pruning and
    rewriting; they are not part of the table's columns.
    """
    if not files.exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root).select(*schema.fieldNames())


def read_silver(spark: SparkSession, root: str) -> DataFrame:
    return _partitioned(spark, root, schemas.SILVER)


def read_gold(spark: SparkSession, root: str) -> DataFrame:
    return _partitioned(spark, root, schemas.GOLD)


def preview(table: DataFrame, limit: int = 20) -> DataFrame:
    return table.limit(limit)


def table_summary(spark: SparkSession, silver_root: str, gold_root: str) -> DataFrame:
    """Row counts of both layers: ``layer, rows``."""
    counts = [
        _partitioned(spark, root, schema).agg(F.count(F.lit(1)).alias("rows")).withColumn("layer", F.lit(layer))
        for layer, root, schema in (("silver", silver_root, schemas.SILVER), ("gold", gold_root, schemas.GOLD))
    ]
    return counts[0].unionByName(counts[1]).select("layer", "rows")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest log; blank and corrupt lines are skipped."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schemas.MANIFEST)
    # Stream batches have folders of their own below the log.
    reader = spark.read.schema(schemas.MANIFEST).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true")
    log = reader.json(path)
    return log.where(F.col("file_path").isNotNull() & F.col("state").isNotNull())


def read_document(spark: SparkSession, path: str, schema: str | T.StructType = schemas.SNAPSHOT) -> DataFrame:
    """A JSON document as one typed row; no row if missing or corrupt.

    Follows the pointer that ``write_document`` leaves; a path without one is read as it is.
    """
    typed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not files.exists(spark, path):
        return spark.createDataFrame([], typed)
    pointer = f"{path}/{files.POINTER}"
    if files.exists(spark, pointer):
        path = f"{path}/{files.read_note(spark, pointer)}"
    return spark.read.schema(typed).option("mode", "DROPMALFORMED").json(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FRAMES).parquet(path)


def stream_frames(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.FRAMES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_export(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The current version of a CSV export; without one, no rows.

    Texts may hold line breaks, commas and quotes. CSV doesn't tell empty texts from missing ones: both are null.
    """
    pointer = f"{path}/{files.POINTER}"
    if not files.exists(spark, pointer):
        return spark.createDataFrame([], schema)
    version = f"{path}/{files.read_note(spark, pointer)}"
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True, enforceSchema=False).csv(version)

"""Reading Parquet whose files were written under different schemas.

Footers are read in a distributed pass. Files that share a physical schema are
read together with exactly that schema, coerced to the target and united.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files

# The footer reader travels to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FOOTER = "path string, directory string, spark_schema string, row_count long"
# Stores whose footers are read by range; files of any other one are read whole, by Spark.
_RANGED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _spark_type(arrow_type) -> T.DataType | None:
    """The type under which Spark reads a Parquet column; None if it cannot."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_type

    unsigned = {pa.uint8(): T.IntegerType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType()}
    try:
        return unsigned.get(arrow_type) or from_arrow_type(arrow_type, prefer_timestamp_ntz=True)
    except Exception:
        return None


def _parsed(tail: bytes) -> tuple[str | None, int | None]:
    """Spark schema as JSON and row count from bytes that end like a Parquet file; nulls if they don't."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    try:
        meta = pq.read_metadata(pa.BufferReader(tail))
        fields = [(f.name, _spark_type(f.type)) for f in meta.schema.to_arrow_schema()]
    except Exception:  # no Parquet, or a footer that is broken
        return None, None
    schema = T.StructType([T.StructField(n, t) for n, t in fields if t is not None])
    return schema.json(), meta.num_rows


def footers(listed: DataFrame) -> DataFrame:
    """``path, directory, spark_schema, row_count`` per file; null schema if its footer is broken.

    Only what the file holds can make it unreadable: a store that cannot be opened, or a read that fails, fails the
    job. Stores that only Spark knows are read through Spark.
    """

    def by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs

        for batch in batches:
            rows = []
            for path, directory in zip(batch["path"], batch["directory"]):
                system, name = arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                with system.open_input_file(name) as handle:
                    size = handle.size()
                    end = handle.read_at(min(8, size), max(0, size - 8))
                    length = int.from_bytes(end[:4], "little") + 8 if end[4:] == b"PAR1" else 0
                    tail = handle.read_at(length, size - length) if 8 < length <= size else b""
                rows.append((path, directory, *_parsed(b"PAR1" + tail if tail else end)))
            yield pd.DataFrame(rows, columns=["path", "directory", "spark_schema", "row_count"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, d, *_parsed(c)) for p, d, c in zip(batch["path"], batch["directory"], batch["content"])]
            yield pd.DataFrame(rows, columns=["path", "directory", "spark_schema", "row_count"])

    names = listed.select("path", "directory")
    if "content" in listed.columns:
        return listed.select("path", "directory", "content").mapInPandas(whole, _FOOTER)
    return names.mapInPandas(by_range, _FOOTER)


def _listed(spark: SparkSession, where: str) -> DataFrame:
    """The table's files; with their content where only Spark can open the store."""
    if files.qualify(spark, where).split(":", 1)[0] in _RANGED:
        return files.listing(spark, where).repartition(F.col("path"))
    return files.contents(spark, where)


def safe_cast(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that gives null instead of an error or a changed value."""
    cast = value.try_cast(target)
    if isinstance(source, T.NumericType) and isinstance(target, T.IntegralType):
        return F.when(cast.cast("double") == value.cast("double"), cast)
    if isinstance(source, T.StringType) and isinstance(target, T.IntegralType):
        return F.when(value.rlike(r"^[+-]?\d+$"), cast)
    return cast


def coerce(df: DataFrame, target: T.StructType, strict: bool = False) -> DataFrame:
    """Target columns only: missing ones as typed nulls, others cast where safe.

    With ``strict`` a column in which any value of a file cannot be cast is
    null for that whole file (``df`` must then be a direct file scan).
    """
    source = {f.name: f.dataType for f in df.schema.fields}
    differing = [
        f for f in target.fields
        if f.name in source and source[f.name].simpleString() != f.dataType.simpleString()
    ]
    columns = {}
    for field in target.fields:
        if field.name not in source:
            columns[field.name] = F.lit(None).cast(field.dataType)
        elif field in differing:
            columns[field.name] = safe_cast(F.col(field.name), source[field.name], field.dataType)
        else:
            columns[field.name] = F.col(field.name)
    if not strict or not differing:
        return df.select(*[c.alias(n) for n, c in columns.items()])

    # One row per file says which columns had a value that could not be cast.
    keyed = df.withColumn("_file", F.col("_metadata.file_path"))
    failed = keyed.groupBy("_file").agg(*[
        F.bool_or(F.col(f.name).isNotNull() & columns[f.name].isNull()).alias(f"_bad_{f.name}") for f in differing
    ])
    # Only files with such a value are kept on this side: few, so that the rows need not be dealt out by file.
    wrong = failed.where(F.greatest(*[F.col(f"_bad_{f.name}") for f in differing], F.lit(False)))
    joined = keyed.join(wrong, "_file", "left")
    for field in differing:
        columns[field.name] = F.when(~F.coalesce(F.col(f"_bad_{field.name}"), F.lit(False)), columns[field.name])
    return joined.select(*[c.alias(n) for n, c in columns.items()])


def read_groups(
    spark: SparkSession, root: str, groups: Sequence[tuple[str, list[str]]], target: T.StructType, strict: bool
) -> DataFrame:
    """Union of ``(physical schema as JSON, paths)`` groups, each coerced to the target."""
    import json

    out = None
    for schema_json, paths in groups:
        schema = T.StructType.fromJson(json.loads(schema_json))
        reader = spark.read.option("basePath", root).option("ignoreCorruptFiles", "true")
        part = coerce(reader.schema(schema).parquet(*paths), target, strict)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], target) if out is None else out


def read_with_evolution(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    partition_filter: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """A Hive-partitioned Parquet table under the given schema.

    ``partition_filter`` names one partition directory (``event_date=...``).
    Files with a broken footer are skipped, see ``unreadable_files``; a missing or empty root gives an empty frame.
    A directory whose files share one schema is passed to the reader as a
    whole; only mixed directories are listed file by file.
    """
    where = f"{root}/{partition_filter}" if partition_filter else root
    if not files.exists(spark, where):
        return spark.createDataFrame([], schema)
    listed = _listed(spark, where).where(F.col("directory").rlike(r"/event_date=[^/]+(/|$)"))
    # One row per file, used twice below; names and schemas only.
    info = footers(listed).persist()
    try:
        per_dir = info.groupBy("directory").agg(
            F.count_distinct("spark_schema").alias("schemas"),
            F.count_if(F.col("spark_schema").isNull()).alias("unreadable"),
            F.min("spark_schema").alias("spark_schema"),
        )
        uniform = per_dir.where((F.col("schemas") == 1) & (F.col("unreadable") == 0))
        mixed = info.where(F.col("spark_schema").isNotNull()).join(uniform.select("directory"), "directory", "left_anti")
        names = uniform.select("spark_schema", F.col("directory").alias("name")).unionByName(
            mixed.select("spark_schema", F.col("path").alias("name"))
        )
        groups: dict[str, list[str]] = {}
        for row in names.orderBy("spark_schema", "name").toLocalIterator():
            groups.setdefault(row["spark_schema"], []).append(row["name"])
    finally:
        info.unpersist()
    return read_groups(spark, root, list(groups.items()), schema, strict)


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, directory`` of the files that ``read_with_evolution`` skips."""
    if not files.exists(spark, root):
        return spark.createDataFrame([], "path string, directory string")
    return footers(_listed(spark, root)).where(F.col("spark_schema").isNull()).select("path", "directory")

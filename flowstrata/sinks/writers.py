"""Writers of the stored tables.

``rebalance`` lets adaptive execution merge small and split large shuffle
partitions, so a date that holds most rows is still written by many tasks.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files, schemas
from ..functions.timestamps import as_instant, iso_text

_MAX_RECORDS = 1_000_000


def write_partitioned(df: DataFrame, root: str, mode: str = "append") -> None:
    """Appends Silver or Gold rows below ``event_date=...``; no rows, no files."""
    (
        df.hint("rebalance", "event_date")
        .write.mode(mode)
        .partitionBy("event_date")
        .option("compression", "snappy")
        .parquet(root)
    )


def overwrite_partitions(df: DataFrame, root: str, partitions: list[str]) -> None:
    """Replaces exactly the partitions present in ``df``; a repeat gives the same table."""
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*partitions)
        .parquet(root)
    )


def bronze_lines(records: DataFrame, as_of=None) -> DataFrame:
    """``value, dt, hr``: the record as JSON and the write date and hour in UTC."""
    moment = F.convert_timezone(F.current_timezone(), F.lit("UTC"), as_instant(as_of).cast("timestamp_ntz"))
    present = [F.col(n) for n in schemas.BRONZE.fieldNames() if n in records.columns]
    return records.select(
        F.to_json(F.struct(*present), {"ignoreNullFields": "false"}).alias("value"),
        F.date_format(moment, "yyyy-MM-dd").alias("dt"),
        F.date_format(moment, "HH").alias("hr"),
    )


def write_bronze(records: DataFrame, root: str, as_of=None, max_records: int = _MAX_RECORDS) -> None:
    """Appends records as NDJSON below ``dt=/hr=``; ``max_records`` bounds one file."""
    (
        bronze_lines(records, as_of)
        .write.mode("append")
        .partitionBy("dt", "hr")
        .option("maxRecordsPerFile", max_records)
        .text(root)
    )


def stream_bronze(
    records: DataFrame,
    root: str,
    checkpoint: str,
    max_records: int = _MAX_RECORDS,
    manifest_path: str | None = None,
    agent_id: str = "",
    **trigger,
):
    """The same as a streaming append; the trigger sets the cadence.

    The table is an ordinary folder that compaction and retention may change. With ``manifest_path`` the files enter
    the manifest as sealed in the same batch (``write_bronze_batch``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        write_bronze_batch(batch, root, query, batch_id, batch_clock(batch.sparkSession, checkpoint, batch_id), max_records,
                           manifest_path, agent_id)

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_clock(spark: SparkSession, folder: str, batch: int) -> dt.datetime:
    """The time at which a batch was first tried, kept in a note below ``folder``, the same in every later try."""
    note = f"{folder}/_clocks/{batch}.txt"
    if not files.exists(spark, note):
        files.make_dirs(spark, f"{folder}/_clocks")
        files.write_note(spark, note, dt.datetime.now(dt.timezone.utc).isoformat())
        files.delete(spark, f"{folder}/_clocks/{batch - 2}.txt")  # of a batch that is done for good
    return dt.datetime.fromisoformat(files.read_note(spark, note))


_PART = re.compile(r"part-(\d+)-.*?(?:-c(\d+))?\.txt")


def write_bronze_batch(records: DataFrame, root: str, query: str, batch: int, as_of: dt.datetime,
                       max_records: int = _MAX_RECORDS, manifest_path: str | None = None, agent_id: str = "") -> None:
    """One batch as NDJSON files of a plain ``dt=/hr=`` folder, sealed in the manifest; a later try replaces an earlier one.

    Names hold query, batch, task and chunk. The batch's clock fixes its folder, so only that folder is listed, and the
    batch has a manifest file of its own, so no other entries are read: the cost doesn't grow with the table.
    """
    spark = records.sparkSession
    moment = as_of.astimezone(dt.timezone.utc)
    place, name = f"dt={moment:%Y-%m-%d}/hr={moment:%H}", f"stream-{query}-{batch}-"
    staging, target = f"{root}/_streaming/{query}-{batch}", f"{root}/{place}"
    lines = bronze_lines(records, as_of).select("value")
    lines.write.mode("overwrite").option("maxRecordsPerFile", max_records).text(staging)
    for file, _ in list(files.children(spark, target)):
        if file.startswith(name):  # of an earlier try
            files.delete(spark, f"{target}/{file}")
    moved = []
    for file, _ in list(files.children(spark, staging)):
        part = _PART.fullmatch(file)
        if part:
            fresh = f"{target}/{name}{part[1]}-{part[2] or '000'}.txt"
            files.move(spark, f"{staging}/{file}", fresh)
            moved.append(fresh)
    files.delete(spark, staging)
    if manifest_path:
        entries = f"{manifest_path}/{name[:-1]}"
        _sealed(spark, moved, batch, place, iso_text(as_instant(as_of)), agent_id).write.mode("overwrite").option(
            "ignoreNullFields", "false").json(entries)


def _sealed(spark: SparkSession, paths: list[str], batch: int, place: str, moment: Column, agent_id: str) -> DataFrame:
    """Manifest rows of a batch's files. They are the files' first, so the batch's number will do as ``seq``."""
    if not paths:
        return spark.createDataFrame([], schemas.MANIFEST)
    day, hour = (part.split("=")[1] for part in place.split("/"))
    held = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("record_count"), F.max("_metadata.file_size").alias("size_bytes")
    )
    return held.select(
        F.lit(batch).cast("bigint").alias("seq"), "file_path", F.lit("SEALED").alias("state"), F.lit(day).alias("partition_dt"),
        F.lit(int(hour)).alias("partition_hr"), moment.alias("created_at"), moment.alias("sealed_at"),
        F.lit(None).cast("string").alias("transferred_at"), "size_bytes", "record_count", F.lit(agent_id).alias("agent_id"),
    )


def write_quarantine(rows: DataFrame, root: str) -> None:
    """Appends ``raw, reason, ts`` rows below ``dt=``."""
    rows.withColumn("dt", F.left("ts", F.lit(10))).write.mode("append").partitionBy("dt").json(root)


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType = schemas.SILVER,
    location: str | None = None,
    table_format: str = "parquet",
    rescued: bool = False,
) -> None:
    """Creates a date-partitioned table unless it exists."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
    if rescued:
        columns.append("`_rescued_data` string")
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)}) USING {table_format} "
        f"PARTITIONED BY (event_date){place}"
    )


def append_to_table(stream: DataFrame, name: str, checkpoint: str, table_format: str = "parquet"):
    """Streaming append into a table until the input is used up."""
    return (
        stream.writeStream.format(table_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("mergeSchema", "true")
        .partitionBy("event_date")
        .trigger(availableNow=True)
        .toTable(name)
    )


def write_document(document: DataFrame, path: str) -> None:
    """Replaces a one-row JSON document.

    Each version has a folder of its own, and a pointer file names the current one; it is replaced by an overwriting
    rename, so at any moment a reader finds a whole document. The version before stays for readers that have begun.
    """
    spark = document.sparkSession
    pointer = f"{path}/{files.POINTER}"
    before = files.read_note(spark, pointer) if files.exists(spark, pointer) else None
    fresh = f"v-{uuid.uuid4().hex}"
    document.coalesce(1).write.option("ignoreNullFields", "false").json(f"{path}/{fresh}")
    files.write_note(spark, pointer, fresh)
    for name, is_directory in list(files.children(spark, path)):
        if is_directory and name.startswith("v-") and name not in (fresh, before):
            files.delete(spark, f"{path}/{name}")


def write_export(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Replaces an export of CSV files with headers, below one folder per value of ``by``.

    Like a document, a version is written aside and then named by the pointer file: a reader finds the old export or the
    new one, whole, and a writer that dies leaves the old one.
    """
    spark = rows.sparkSession
    pointer = f"{path}/{files.POINTER}"
    before = files.read_note(spark, pointer) if files.exists(spark, pointer) else None
    fresh = f"v-{uuid.uuid4().hex}"
    writer = rows.hint("rebalance", *by).write.options(header=True, escape='"')
    (writer.partitionBy(*by) if by else writer).csv(f"{path}/{fresh}")
    files.write_note(spark, pointer, fresh)
    for name, is_directory in list(files.children(spark, path)):
        if is_directory and name.startswith("v-") and name not in (fresh, before):
            files.delete(spark, f"{path}/{name}")


def append_manifest(rows: DataFrame, path: str) -> None:
    """Appends log rows; the rows may be derived from the same log."""
    rows.hint("rebalance").write.mode("append").option("ignoreNullFields", "false").json(path)

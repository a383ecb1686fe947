"""Merging small files of partitioned tables.

The merged files are written to a staging folder inside the table and checked
against the row counts of the originals. Only then a note is stored, the new
files are moved in and the originals deleted. A run that was cut off between
these steps is finished from its note at the next call. Do not run it on a
partition that is being written or read at the same time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import files
from ..functions.timestamps import as_instant, iso_text
from ..operators import manifest as manifest_ops
from ..sinks.writers import append_manifest
from ..sources.evolution import footers, read_groups
from ..sources.tables import read_manifest

# Files merged by one Spark job, give or take a partition; more candidates mean more jobs.
_SLICE = 10_000
_STAGING = "_compaction"


def small_files(
    spark: SparkSession, root: str, small_bytes: int, levels: int = 1, glob: str = "*.parquet"
) -> DataFrame:
    """``path, directory, partition`` of small files in partitions that hold at least two."""
    listed = files.listing(spark, root, glob).where(F.col("size") < small_bytes)
    # Only the part after the root: the root itself may have levels like ``env=prod``.
    inside = F.expr(f"substring(directory, {len(files.qualify(spark, root)) + 2})")
    below_root = F.concat_ws("/", F.slice(
        F.filter(F.split(inside, "/"), lambda part: part.contains("=")), 1, levels
    ))
    grouped = listed.withColumn("partition", below_root).where(F.col("partition") != "")
    several = grouped.groupBy("partition").count().where(F.col("count") >= 2).select("partition")
    return grouped.join(several, "partition", "left_semi").select("path", "directory", "partition")


def _slices(candidates: DataFrame, size: int) -> Iterator[list]:
    """Names in partition order, in lists of whole partitions that end once they reach ``size``."""
    pending: list = []
    for row in candidates.orderBy("partition", "path").toLocalIterator():
        if len(pending) >= size and row["partition"] != pending[-1]["partition"]:
            yield pending
            pending = []
        pending.append(row)
    if pending:
        yield pending


def _finish(spark: SparkSession, root: str, note: str) -> int:
    """Moves staged files in and deletes the originals; safe to repeat."""
    plan = json.loads(files.read_note(spark, note))
    for move in plan["moves"]:
        if files.exists(spark, move["from"]):
            files.move(spark, move["from"], move["to"])
    removed = sum(files.delete(spark, path) for path in plan["originals"] if files.exists(spark, path))
    files.delete(spark, plan["staging"])
    files.delete(spark, note)
    return removed


def finish_pending(spark: SparkSession, root: str) -> int:
    """Completes runs that were cut off after their check; drops unchecked staging."""
    removed = 0
    names = [name for name, _ in files.children(spark, f"{root}/{_STAGING}")]
    for name in names:
        if name.endswith(".json"):
            removed += _finish(spark, root, f"{root}/{_STAGING}/{name}")
    for name in names:
        if not name.endswith(".json"):
            files.delete(spark, f"{root}/{_STAGING}/{name}")
    return removed


def _swap(
    spark: SparkSession, root: str, run: str, staging: str, originals: list[str], suffix: str, also: list[dict] = ()
) -> int:
    moves = list(also)
    for row in files.listing(spark, staging, f"*{suffix}").toLocalIterator():
        relative = row["path"].split(f"/{_STAGING}/{run}/", 1)[1]
        folder, name = relative.rsplit("/", 1)
        moves.append({"from": row["path"], "to": f"{root}/{folder}/compacted-{run}-{name}"})
    note = f"{root}/{_STAGING}/{run}.json"
    files.write_note(spark, note, json.dumps({"staging": staging, "moves": moves, "originals": originals}))
    return _finish(spark, root, note)


def _readable_counts(spark: SparkSession, root: str, groups, target: T.StructType) -> dict[str, int]:
    """Rows per file that can be decoded in full (corrupt files give fewer)."""
    counts: dict[str, int] = {}
    for schema_json, paths in groups:
        schema = T.StructType.fromJson(json.loads(schema_json))
        scan = spark.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(*paths)
        # The hash makes the reader decode every column; a bare count reads none.
        per_file = scan.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*schema.fieldNames())).alias("decoded")
        )
        for row in per_file.collect():
            counts[files.qualify(spark, row["path"])] = row["n"]
    return counts


def compact_parquet(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    small_bytes: int = C.PARQUET_SMALL_BYTES,
    partitions: tuple[str, ...] = ("event_date",),
    merged_batch: int | None = None,
    before_batch: int | None = None,
) -> int:
    """Merges the small files of each partition; returns how many were merged.

    Old files are brought to ``schema`` on the way; unreadable files stay where
    they are. Tables written by the streaming pipeline have an ``ingest_batch``
    level: pass ``merged_batch`` (the level of the merged files, for example
    -1) and ``before_batch`` (only batches below it, so that a batch that may
    still be retried is left alone).
    """
    if not files.exists(spark, root):
        return 0
    merged = finish_pending(spark, root)
    candidates = small_files(spark, root, small_bytes, len(partitions))
    if before_batch is not None:
        batch = F.regexp_extract("path", r"/ingest_batch=(-?\d+)/", 1).try_cast("long")
        candidates = candidates.where(batch < before_batch)
    for chosen in _slices(candidates, _SLICE):
        merged += _merge_slice(spark, root, schema, chosen, partitions, merged_batch)
    return merged


def _merge_slice(spark, root, schema, chosen, partitions, merged_batch) -> int:
    names = spark.createDataFrame([(r["path"], r["directory"], r["partition"]) for r in chosen],
                                  "path string, directory string, partition string")
    info = footers(names).where(F.col("spark_schema").isNotNull()).collect()
    partition_of = {r["path"]: r["partition"] for r in chosen}
    expected = {r["path"]: r["row_count"] for r in info}

    def usable(paths) -> set[str]:
        per: dict[str, list[str]] = {}
        for path in paths:
            per.setdefault(partition_of[path], []).append(path)
        return {p for group in per.values() if len(group) >= 2 for p in group}

    def grouped(paths: set[str]) -> list[tuple[str, list[str]]]:
        out: dict[str, list[str]] = {}
        for r in info:
            if r["path"] in paths:
                out.setdefault(r["spark_schema"], []).append(r["path"])
        return list(out.items())

    paths = usable(expected)
    for attempt in range(2):
        if not paths:
            return 0
        run = uuid.uuid4().hex
        staging = f"{root}/{_STAGING}/{run}"
        target = T.StructType([*schema.fields, *[
            T.StructField(p, T.StringType() if p == "ingest_query" else T.IntegerType())
            for p in partitions if p not in schema.fieldNames()
        ]])
        rows = read_groups(spark, root, grouped(paths), target, strict=True)
        levels = list(partitions)
        if merged_batch is not None:
            rows, levels = rows.withColumn("ingest_batch", F.lit(merged_batch)), [*levels, "ingest_batch"]
        rows.hint("rebalance", *levels).write.partitionBy(*levels).option("compression", "snappy").parquet(staging)
        written = spark.read.parquet(staging).count()
        if written == sum(expected[p] for p in paths):
            return _swap(spark, root, run, staging, sorted(paths), ".parquet")
        files.delete(spark, staging)
        if attempt == 0:
            decoded = _readable_counts(spark, root, grouped(paths), schema)
            paths = usable(p for p in paths if decoded.get(files.qualify(spark, p), 0) == expected[p])
    raise RuntimeError(f"merged row count of {root} does not match; originals were kept")


def compact_bronze(
    spark: SparkSession,
    root: str,
    manifest_path: str,
    agent_id: str = "",
    small_bytes: int = C.NDJSON_SMALL_BYTES,
    as_of=None,
) -> int:
    """Merges small sealed NDJSON files per hour; returns how many were merged.

    The merged files enter the manifest as sealed, with the bytes and records
    they hold; the originals are marked archived and deleted.
    """
    if not files.exists(spark, root):
        return 0
    finish_pending(spark, root)
    log = read_manifest(spark, manifest_path)
    chosen = manifest_ops.compaction_files(log, small_bytes).withColumn(
        "partition", F.format_string("dt=%s/hr=%02d", F.col("partition_dt"), F.col("partition_hr"))
    ).withColumnRenamed("file_path", "path")
    merged = 0
    for part in _slices(chosen.select("path", "partition", "partition_dt", "partition_hr", "record_count"), _SLICE):
        present = [r for r in part if files.exists(spark, r["path"])]
        run = uuid.uuid4().hex
        staging = f"{root}/{_STAGING}/{run}"
        gone = spark.createDataFrame([(r["path"],) for r in part], "file_path string")
        if present:
            where = F.regexp_extract(F.col("_metadata.file_path"), r"/dt=([^/]+)/hr=([^/]+)/", 1)
            hour = F.regexp_extract(F.col("_metadata.file_path"), r"/dt=([^/]+)/hr=([^/]+)/", 2)
            lines = spark.read.text([r["path"] for r in present]).select("value", where.alias("dt"), hour.alias("hr"))
            lines.hint("rebalance", "dt", "hr").write.partitionBy("dt", "hr").text(staging)
            held = spark.read.text(staging).groupBy(F.col("_metadata.file_path").alias("path")).agg(
                F.count(F.lit(1)).alias("record_count")
            )
            sizes = files.listing(spark, staging, "*.txt")
            moment = iso_text(as_instant(as_of))
            name = F.concat(F.lit(f"compacted-{run}-"), F.regexp_extract("path", r"([^/]+)$", 1))
            folder = F.regexp_extract("path", r"/(dt=[^/]+/hr=[^/]+)/[^/]+$", 1)
            new_rows = sizes.join(held, "path").select(
                (F.lit(_last_seq(log)) + 1).cast("bigint").alias("seq"),
                F.concat_ws("/", F.lit(root), folder, name).alias("file_path"),
                F.lit(manifest_ops.SEALED).alias("state"),
                F.regexp_extract("path", r"/dt=([^/]+)/", 1).alias("partition_dt"),
                F.regexp_extract("path", r"/hr=([^/]+)/", 1).cast("int").alias("partition_hr"),
                moment.alias("created_at"),
                moment.alias("sealed_at"),
                F.lit(None).cast("string").alias("transferred_at"),
                F.col("size").alias("size_bytes"),
                "record_count",
                F.lit(agent_id).alias("agent_id"),
            )
            # The log rows are staged too and move in with the data.
            staged_log = f"{root}/{_STAGING}/{run}.log"
            append_manifest(new_rows.unionByName(manifest_ops.mark_archived(log, gone)), staged_log)
            log_moves = [
                {"from": r["path"], "to": f"{manifest_path}/{r['path'].rsplit('/', 1)[1]}"}
                for r in files.listing(spark, staged_log, "*.json").toLocalIterator()
            ]
            _swap(spark, root, run, staging, [r["path"] for r in present], ".txt", log_moves)
            files.delete(spark, staged_log)
        else:
            append_manifest(manifest_ops.mark_archived(log, gone), manifest_path)
        merged += len(part)
        log = read_manifest(spark, manifest_path)
    return merged


def _last_seq(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]

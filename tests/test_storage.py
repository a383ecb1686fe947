from __future__ import annotations

import datetime as dt
import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowstrata import files, schemas
from flowstrata.maintenance import compaction, retention
from flowstrata.operators import gold, manifest
from flowstrata.operators.silver import to_silver
from flowstrata.session import shared_dir
from flowstrata.sinks import writers
from flowstrata.sources import bronze as bronze_source
from flowstrata.sources import evolution, tables

TARGET = T.StructType([
    T.StructField("length", T.LongType()), T.StructField("name", T.StringType()), T.StructField("event_date", T.DateType()),
])
DAY = "event_date=2026-01-15"


def put(root, columns, name, day=DAY):
    os.makedirs(f"{root}/{day}", exist_ok=True)
    pq.write_table(pa.table(columns), f"{root}/{day}/{name}.parquet")


def files_in(root):
    return glob.glob(f"{root}/**/*.parquet", recursive=True)


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_partitioned_write_and_scan(spark, bronze, tmp_path):
    root = str(tmp_path / "silver")
    rows = to_silver(bronze({}, {"timestamp": "2026-01-16T01:00:00Z"}))
    writers.write_partitioned(rows, root)
    writers.write_partitioned(rows, root)
    assert sorted(n for n, is_dir in files.children(spark, root) if is_dir) == [
        "event_date=2026-01-15", "event_date=2026-01-16"]
    back = tables.read_silver(spark, root)
    assert back.schema.fieldNames() == schemas.SILVER.fieldNames()
    assert back.count() == 4 and tables.preview(back, 3).count() == 3
    writers.write_partitioned(gold.hourly(rows), str(tmp_path / "gold"))
    summary = {r["layer"]: r["rows"] for r in tables.table_summary(spark, root, str(tmp_path / "gold")).collect()}
    assert summary == {"silver": 4, "gold": 2}


def test_missing_tables_are_empty(spark, tmp_path):
    gone = str(tmp_path / "nope")
    assert tables.read_silver(spark, gone).count() == 0
    assert tables.read_manifest(spark, gone).count() == 0
    assert tables.read_document(spark, gone).count() == 0
    assert evolution.read_with_evolution(spark, gone, TARGET).count() == 0
    assert compaction.compact_parquet(spark, gone, TARGET) == 0
    assert retention.enforce_retention(spark, gone) == 0


def test_corrupt_documents_are_skipped(spark, tmp_path):
    (tmp_path / "live.json").write_text("{broken")
    assert tables.read_document(spark, str(tmp_path / "live.json")).count() == 0
    line = {"seq": 1, "file_path": "a", "state": "SEALED"}
    (tmp_path / "log.jsonl").write_text(json.dumps(line) + "\n\n{oops\n" + json.dumps({**line, "seq": 2}) + "\n")
    assert tables.read_manifest(spark, str(tmp_path / "log.jsonl")).count() == 2


def test_evolution(spark, tmp_path):
    root = str(tmp_path / "t")
    put(root, {"length": [1, 2], "name": ["a", "b"]}, "now")
    put(root, {"name": ["c"], "obsolete": ["x"]}, "old")
    put(root, {"length": ["7", "not-a-number"], "name": ["d", "e"]}, "text")
    put(root, {"length": [2.0, 2.5], "name": ["f", "g"]}, "float", "event_date=2026-01-16")
    (tmp_path / "t" / DAY / "broken.parquet").write_bytes(b"not parquet")
    put(root, {"length": [9], "name": ["z"]}, "x", "other=1")

    def read(**options):
        return {r["name"]: (r["length"], str(r["event_date"])) for r in
                evolution.read_with_evolution(spark, root, TARGET, **options).collect()}

    first, second = "2026-01-15", "2026-01-16"
    assert read() == {"a": (1, first), "b": (2, first), "c": (None, first), "d": (7, first), "e": (None, first),
                      "f": (2, second), "g": (None, second)}
    strict = read(strict=True)
    assert strict["d"] == (None, first) and strict["f"] == (None, second) and strict["a"] == (1, first)
    assert set(read(partition_filter="event_date=2026-01-16")) == {"f", "g"}


def test_compaction_keeps_rows_and_bad_files(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(5):
        put(root, {"length": [i], "name": [f"n{i}"]}, f"f{i}")
    put(root, {"name": ["old"]}, "old")
    put(root, {"length": [1], "name": ["single"]}, "only", "event_date=2026-01-16")
    broken = tmp_path / "t" / DAY / "broken.parquet"
    broken.write_bytes(b"PAR1 no footer PAR1")
    before = sorted(map(tuple, evolution.read_with_evolution(spark, root, TARGET).collect()), key=str)
    assert compaction.compact_parquet(spark, root, TARGET) == 6
    left = files_in(root)
    assert str(broken) in left and len(left) == 3
    assert sorted(map(tuple, evolution.read_with_evolution(spark, root, TARGET).collect()), key=str) == before
    assert compaction.compact_parquet(spark, root, TARGET) == 0


def test_compaction_skips_large_files(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(3):
        put(root, {"length": [i], "name": ["x"]}, f"f{i}")
    assert compaction.compact_parquet(spark, root, TARGET, small_bytes=10) == 0


def test_compaction_with_a_half_readable_file(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(3):
        put(root, {"length": list(range(200)), "name": [f"{i}-{j}" for j in range(200)]}, f"f{i}")
    bad = tmp_path / "t" / DAY / "f1.parquet"
    data = bytearray(bad.read_bytes())
    data[4:200] = b"\xff" * 196
    bad.write_bytes(bytes(data))
    assert compaction.compact_parquet(spark, root, TARGET) == 2
    assert bad.exists() and len(files_in(root)) == 2


def test_interrupted_compaction_is_finished(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    for i in range(3):
        put(root, {"length": [i], "name": ["x"]}, f"f{i}")

    def stop(*_):
        raise RuntimeError("executor lost")

    finish = compaction._finish
    monkeypatch.setattr(compaction, "_finish", stop)
    with pytest.raises(RuntimeError):
        compaction.compact_parquet(spark, root, TARGET)
    assert tables._partitioned(spark, root, TARGET).count() == 3
    monkeypatch.setattr(compaction, "_finish", finish)
    assert compaction.compact_parquet(spark, root, TARGET) == 3
    assert tables._partitioned(spark, root, TARGET).count() == 3 and len(files_in(root)) == 1


@pytest.mark.parametrize("days, layer, left", [(7, "silver", 4), (None, "silver", 4), (None, "gold", 5), (2, "silver", 2)])
def test_retention(spark, tmp_path, days, layer, left):
    today = dt.date(2026, 3, 1)
    for age in (1, 2, 3, 5, 10, 35):
        put(str(tmp_path), {"name": ["x"]}, "f", f"event_date={today - dt.timedelta(days=age)}")
    put(str(tmp_path), {"name": ["x"]}, "f", "event_date=oops")
    assert retention.enforce_retention(spark, str(tmp_path), days, layer, today) == 6 - left
    assert len(files_in(tmp_path)) == left + 1


def test_bronze_lifecycle(spark, bronze, tmp_path):
    root, log_path = str(tmp_path / "data"), str(tmp_path / "manifest")
    for i in range(3):
        writers.write_bronze(bronze({"length": i}, {"length": i + 10}), root, as_of="2026-01-15T14:05:00")
    lines = bronze_source.read_lines(spark, root)
    assert {(str(r["dt"]), r["hr"]) for r in lines.collect()} == {("2026-01-15", 14)}
    assert bronze_source.read_bronze(spark, root, dt_from="2026-01-16").count() == 0
    held = lines.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("record_count"), F.max("_metadata.file_size").alias("size_bytes"))
    entries = held.select(
        F.lit(1).cast("long").alias("seq"), "file_path", F.lit("ACTIVE").alias("state"), F.lit("2026-01-15").alias("partition_dt"),
        F.lit(14).alias("partition_hr"), F.lit("").alias("created_at"), F.lit(None).cast("string").alias("sealed_at"),
        F.lit(None).cast("string").alias("transferred_at"), F.lit(0).cast("long").alias("size_bytes"),
        F.lit(0).cast("long").alias("record_count"), F.lit("a").alias("agent_id"))
    writers.append_manifest(entries, log_path)
    log = tables.read_manifest(spark, log_path)
    assert compaction.compact_bronze(spark, root, log_path) == 0
    writers.append_manifest(manifest.seal(log, held), log_path)
    files_before = held.count()
    assert compaction.compact_bronze(spark, root, log_path, "me") == files_before
    log = tables.read_manifest(spark, log_path)
    merged = manifest.pending_transfer(log).collect()
    assert sum(r["record_count"] for r in merged) == 6
    assert all(os.path.getsize(r["file_path"].removeprefix("file:")) == r["size_bytes"] for r in merged)
    assert sorted(r["length"] for r in bronze_source.read_bronze(spark, root).collect()) == [0, 1, 2, 10, 11, 12]
    moved = manifest.mark_transferred(log, manifest.pending_transfer(log), "2026-01-15T15:00:00")
    writers.append_manifest(moved, log_path)
    assert retention.enforce_bronze_retention(spark, log_path, as_of="2026-01-18T14:59:00") == 0
    assert retention.enforce_bronze_retention(spark, log_path, as_of="2026-01-18T15:01:00") == len(merged)
    assert bronze_source.read_lines(spark, root).count() == 0
    assert manifest.in_state(tables.read_manifest(spark, log_path), "ARCHIVED").count() == files_before + len(merged)


def test_table_ddl_twice(spark, bronze):
    for _ in range(2):
        writers.create_table(spark, "silver_events", rescued=True)
    names = spark.table("silver_events").columns
    assert "_rescued_data" in names and names[-1] == "event_date"
    spark.sql("DROP TABLE silver_events")

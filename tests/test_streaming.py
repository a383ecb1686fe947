from __future__ import annotations

import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from flowstrata import schemas
from flowstrata.maintenance.compaction import compact_bronze, compact_parquet
from flowstrata.maintenance.retention import enforce_bronze_retention, enforce_retention
from flowstrata.operators import gold, manifest
from flowstrata.operators.silver import to_silver
from flowstrata.operators.validation import accepted, validate_json
from flowstrata.sinks import writers
from flowstrata.sources import bronze as bronze_source
from flowstrata.sources.tables import read_gold, read_manifest
from flowstrata.streaming import live, pipeline

GOLD = [n for n in schemas.GOLD.fieldNames() if n != "computed_at"]


def line(i, **fields):
    return json.dumps({
        "timestamp": f"2026-01-15T{10 + i % 3}:{i % 60:02d}:00+02:00", "src_ip": f"10.0.{i % 2}.{i % 7}", "dst_ip": "8.8.8.8",
        "dst_port": 443, "protocol": "tcp", "length": i, "agent_id": "a", **fields,
    })


def land(root, name, lines):
    folder = root / "dt=2026-01-15" / "hr=10"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.txt").write_text("\n".join(lines) + "\n")


def batch_gold(spark, landing):
    return gold.hourly(to_silver(accepted(validate_json(bronze_source.read_lines(spark, str(landing))))))


def same(left, right):
    return sorted(map(tuple, left.select(*GOLD).collect()), key=str) == sorted(map(tuple, right.select(*GOLD).collect()), key=str)


@pytest.mark.parametrize("grain", ["hour", "date"])
def test_stream_equals_batch(spark, tmp_path, grain):
    landing, layout = tmp_path / "landing", pipeline.Layout(str(tmp_path / "tables"), grain)
    for part in range(3):
        land(landing, f"f{part}", [line(i) for i in range(part, 60, 3)] + ["{broken", line(1, length=-1)])
    lines = lambda: bronze_source.stream_lines(spark, str(landing), max_files=1)
    pipeline.run_available(lines(), layout)
    assert pipeline.silver_table(spark, layout).count() == 60
    assert pipeline.quarantine_table(spark, layout).count() == 6
    assert same(pipeline.gold_table(spark, layout), batch_gold(spark, landing))

    # A restart with late rows of old hours rebuilds those hours only once more.
    land(landing, "late", [line(i, src_ip="10.0.9.9") for i in range(5)])
    pipeline.run_available(lines(), layout)
    assert pipeline.silver_table(spark, layout).count() == 65
    assert same(pipeline.gold_table(spark, layout), batch_gold(spark, landing))


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    landing, layout = tmp_path / "landing", pipeline.Layout(str(tmp_path / "tables"))
    land(landing, "a", [line(i) for i in range(30)] + ["x"])
    rows = bronze_source.read_lines(spark, str(landing))
    for _ in range(2):
        pipeline.process_batch(rows, 7, layout)
    assert pipeline.silver_table(spark, layout).count() == 30
    assert pipeline.quarantine_table(spark, layout).count() == 1
    assert same(pipeline.gold_table(spark, layout), batch_gold(spark, landing))


def test_late_rows_after_silver_retention(spark, tmp_path):
    landing, layout = tmp_path / "landing", pipeline.Layout(str(tmp_path / "tables"))
    land(landing, "a", [line(i) for i in range(50)])
    pipeline.run_available(bronze_source.stream_lines(spark, str(landing)), layout)
    assert enforce_retention(spark, layout.silver, days=1, as_of=dt.date(2030, 1, 1)) == 1
    land(landing, "b", [line(1, src_ip="10.0.9.9")])
    pipeline.run_available(bronze_source.stream_lines(spark, str(landing)), layout)
    assert pipeline.silver_table(spark, layout).count() == 1
    assert same(pipeline.gold_table(spark, layout), batch_gold(spark, landing))
    pipeline.publish_gold(spark, layout)
    assert same(read_gold(spark, layout.gold), batch_gold(spark, landing))


@pytest.mark.parametrize("stream", ["medallion", "second"])
def test_another_query_on_the_same_tables(spark, tmp_path, stream):
    """A new checkpoint of the same stream, and a second stream, add rows and overwrite none."""
    landing, more = tmp_path / "landing", tmp_path / "more"
    land(landing, "a", [line(i) for i in range(50)] + ["x"])
    land(more, "b", [line(i, src_ip="10.0.9.9") for i in range(7)] + ["y"])
    layout = pipeline.Layout(str(tmp_path / "tables"))
    pipeline.run_available(bronze_source.stream_lines(spark, str(landing)), layout)
    shutil.rmtree(layout.checkpoint)
    other = pipeline.Layout(layout.root, stream=stream)
    pipeline.run_available(bronze_source.stream_lines(spark, str(more)), other)
    assert pipeline.silver_table(spark, layout).count() == 57
    assert pipeline.quarantine_table(spark, layout).count() == 2
    both = to_silver(accepted(validate_json(
        bronze_source.read_lines(spark, str(landing)).unionByName(bronze_source.read_lines(spark, str(more)))
    )))
    assert same(pipeline.gold_table(spark, layout), gold.hourly(both))


def test_bronze_lifecycle(spark, tmp_path):
    """Stream, seal, compact, stream on, retain: the lines stay readable."""
    landing, data, log = tmp_path / "landing", str(tmp_path / "bronze"), str(tmp_path / "manifest")

    def stream():
        valid = accepted(validate_json(bronze_source.stream_lines(spark, str(landing), max_files=1)))
        writers.stream_bronze(valid, data, str(tmp_path / "c"), manifest_path=log).awaitTermination()

    for part in range(3):
        land(landing, f"f{part}", [line(i) for i in range(10)])
    stream()
    assert bronze_source.read_lines(spark, data).count() == 30
    assert manifest.pending_transfer(read_manifest(spark, log)).agg(F.sum("record_count")).first()[0] == 30
    assert compact_bronze(spark, data, log) == 3
    land(landing, "late", [line(i) for i in range(5)])
    stream()
    assert bronze_source.read_lines(spark, data).count() == 35
    sealed = manifest.pending_transfer(read_manifest(spark, log))
    assert sealed.agg(F.sum("record_count")).first()[0] == 35
    writers.append_manifest(manifest.mark_transferred(read_manifest(spark, log), sealed, "2026-01-16T00:00:00"), log)
    assert enforce_bronze_retention(spark, log, as_of="2036-01-01T00:00:00") == 2


def test_stream_table_compaction(spark, tmp_path):
    landing, layout = tmp_path / "landing", pipeline.Layout(str(tmp_path / "tables"))
    land(landing, "a", [line(i) for i in range(30)])
    rows = bronze_source.read_lines(spark, str(landing))
    for batch in range(3):
        pipeline.process_batch(rows, batch, layout)
    merged = compact_parquet(spark, layout.silver, schemas.SILVER, partitions=("event_date", "event_hr", "ingest_query"),
                             merged_batch=-1, before_batch=2)
    assert merged == 6 and pipeline.silver_table(spark, layout).count() == 90
    pipeline.process_batch(rows, 2, layout)
    assert pipeline.silver_table(spark, layout).count() == 90


def test_counters_in_the_progress(spark, tmp_path):
    landing, layout = tmp_path / "landing", pipeline.Layout(str(tmp_path / "tables"))
    land(landing, "a", [line(i) for i in range(9)] + ["x"])
    query = pipeline.start(bronze_source.stream_lines(spark, str(landing)), layout, metric_name="stages")
    query.awaitTermination()
    seen = [p.observedMetrics["stages"] for p in query.recentProgress if "stages" in p.observedMetrics]
    assert (seen[0]["captured"], seen[0]["processed"], seen[0]["validation_errors"], seen[0]["silver_records"]) == (10, 9, 1, 9)


def test_bronze_stream_sink_and_table_append(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "a", [line(i) for i in range(12)])
    valid = accepted(validate_json(bronze_source.stream_lines(spark, str(landing))))
    writers.stream_bronze(valid, str(tmp_path / "bronze"), str(tmp_path / "c1")).awaitTermination()
    assert bronze_source.read_bronze(spark, str(tmp_path / "bronze")).count() == 12
    writers.create_table(spark, "stream_silver")
    writers.append_to_table(to_silver(valid), "stream_silver", str(tmp_path / "c2")).awaitTermination()
    assert spark.table("stream_silver").count() == 12
    spark.sql("DROP TABLE stream_silver")


def test_running_and_minute_aggregates(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "a", [line(i) for i in range(30)])
    silver = to_silver(accepted(validate_json(bronze_source.stream_lines(spark, str(landing)))))
    for name, frame, mode in (
        ("totals", live.running_breakdown(silver, ["protocol"]), "complete"),
        ("minutes", live.minute_volumes(silver, "protocol"), "update"),
        ("sketches", live.sketch_partials(silver), "update"),
    ):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("totals").first()["packets"] == 30
    assert spark.table("minutes").agg(F.sum("bytes")).first()[0] == sum(range(30))
    merged = gold.merge_sketches(spark.table("sketches"))
    assert merged.agg(F.sum("packet_count")).first()[0] == 30


def test_published_snapshot(spark, tmp_path, bronze):
    path = str(tmp_path / "live.json")
    for count in (1, 3):
        live.publish_snapshot(to_silver(bronze(*[{}] * count)), path, as_of="2026-01-15T11:00:00", arrival="event_ts")
        from flowstrata.sources.tables import read_document

        assert read_document(spark, path).first()["total_packets"] == count

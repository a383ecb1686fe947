"""The stream that fills every layer, its partial rows and their documents."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowstrata import files, schemas
from flowstrata.operators import gold, health_state, live_state, manifest, metrics, snapshot
from flowstrata.operators.silver import to_silver
from flowstrata.operators.validation import accepted, validate_json
from flowstrata.sinks import writers
from flowstrata.sources import bronze as bronze_source
from flowstrata.sources.tables import read_document, read_manifest
from flowstrata.streaming import layers, pipeline
from flowstrata.streaming.state import BatchState

AS_OF = dt.datetime(2026, 1, 15, 12, tzinfo=dt.timezone.utc)


def line(i, **fields):
    return json.dumps({
        "timestamp": f"2026-01-15T{10 + i % 2}:{i % 60:02d}:00+00:00", "src_ip": f"10.0.{i % 2}.{i % 7}", "dst_ip": "8.8.8.8",
        "dst_port": [443, 53, None][i % 3], "protocol": ["tcp", "udp"][i % 2], "length": i, "agent_id": "a",
        "service_info": ["DNS", None, ""][i % 3], **fields,
    })


def lines(spark, numbers, bad=0):
    rows = [(line(i),) for i in numbers] + [("{broken",)] * bad
    return spark.createDataFrame(rows, "value string")


def comparable(layout, spark):
    """What every layer holds, without the clocks of the run."""
    bronze = sorted(r["value"] for r in bronze_source.read_lines(spark, layout.bronze).collect())
    silver = sorted(map(str, pipeline.silver_table(spark, layout).drop("ingested_at").collect()))
    quarantined = sorted(r["reason"] for r in pipeline.quarantine_table(spark, layout).collect())
    hours = sorted(map(str, pipeline.gold_table(spark, layout).drop("computed_at").collect()))
    log = manifest.current_state(read_manifest(spark, layout.manifest))
    sealed = sorted((r["state"], r["record_count"]) for r in log.collect())
    live = layers.snapshot_row(spark, layout, AS_OF).drop("started_at").collect()
    for packet in live[0]["recent_packets"]:
        assert packet["src_ip"]
    counters = layers.metrics_row(spark, layout, AS_OF).select("counters").collect()
    return bronze, silver, quarantined, hours, sealed, live, counters


class Died(Exception):
    pass


def test_a_batch_that_dies_after_any_layer_is_made_good(spark, tmp_path, monkeypatch):
    clean = layers.Layers(str(tmp_path / "clean"), "date", publish_every=0, fold_every=0)
    layout = layers.Layers(str(tmp_path / "died"), "date", publish_every=0, fold_every=0)
    for tables in (clean, layout):
        layers.process_batch(lines(spark, range(40), bad=2), 0, tables, query_id="q")
    second = lines(spark, range(40, 70), bad=1)
    layers.process_batch(second, 1, clean, query_id="q")
    # Each try gets one layer further than the one before, and dies there.
    for step in ("bronze", "quarantine", "silver", "gold", "live", "health"):
        with monkeypatch.context() as patched:
            done = getattr(layers._Batch, step)

            def dies(self, *args, done=done):
                done(self, *args)
                raise Died

            patched.setattr(layers._Batch, step, dies)
            with pytest.raises(Died):
                layers.process_batch(second, 1, layout, query_id="q")
    layout = layers.Layers(layout.root, "date", fold_every=0)
    layers.process_batch(second, 1, layout, query_id="q")
    assert comparable(layout, spark) == comparable(clean, spark)
    # Every path that the manifest calls sealed is there.
    for row in manifest.current_state(read_manifest(spark, layout.manifest)).collect():
        assert files.exists(spark, row["file_path"])
    assert read_document(spark, layout.snapshot).first()["total_packets"] == 70
    health = read_document(spark, layout.metrics, health_state.DOCUMENT).first()
    assert health["counters"]["processed"] == 70 and health["counters"]["validation_errors"] == 3
    assert health["counters"]["snapshot_flushes"] == 2
    assert [e["component"] for e in health["recent_errors"]] == ["validation"] * 3
    assert set(health["latency_us"]) == {"queue_to_bronze", "bronze_to_silver", "silver_to_gold"}
    # The documents need no stored packets.
    files.delete(spark, layout.silver)
    files.delete(spark, layout.bronze)
    assert layers.snapshot_row(spark, layout, AS_OF).first()["total_packets"] == 70


def test_the_stream(spark, tmp_path):
    landing = tmp_path / "landing" / "dt=2026-01-15" / "hr=10"
    landing.mkdir(parents=True)
    for part in range(3):
        (landing / f"f{part}.txt").write_text("\n".join(line(i) for i in range(part * 20, part * 20 + 20)) + "\nbroken\n")
    layout = layers.Layers(str(tmp_path / "tables"), "date", publish_every=0, fold_every=1)
    stream = bronze_source.stream_lines(spark, str(tmp_path / "landing"), max_files=1)
    layers.start(stream, layout).awaitTermination()
    assert bronze_source.read_lines(spark, layout.bronze).count() == 60
    rows = pipeline.silver_table(spark, layout)
    assert rows.count() == 60
    expected = gold.hourly(rows).drop("computed_at")
    found = pipeline.gold_table(spark, layout).drop("computed_at")
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    counters = layers.metrics_row(spark, layout).first()["counters"]
    assert (counters["captured"], counters["processed"], counters["validation_errors"]) == (63, 60, 3)
    # Two folds have run, and the batches of the first are gone from the folders.
    note = layout.live_state._note(spark)
    assert list(note["through"].values()) == [1] and list(note["gone"].values()) == [0]


def test_documents_equal_those_from_all_packets(spark, tmp_path):
    silver = to_silver(accepted(validate_json(lines(spark, range(120)))), as_of=AS_OF).withColumn("n", F.col("length"))
    counters = spark.createDataFrame([(10, 1, 0, 9, 0)], schemas.CAPTURE_COUNTERS)
    moment = dt.datetime(2026, 1, 15, 11, 30)
    whole = snapshot.live_snapshot(silver, gold.hourly(silver), counters, moment, arrival="n").collect()
    recent = f"{live_state.RECENT}, n bigint"
    states = [
        (BatchState(str(tmp_path / "live"), live_state.PARTIAL, live_state.merge), live_state.partials),
        (BatchState(str(tmp_path / "recent"), recent, lambda df: live_state.merge_recent(df, "n")),
         lambda df: live_state.merge_recent(df, "n")),
        (BatchState(str(tmp_path / "gold"), gold.PARTIAL, gold.fold_partials), gold.partials),
    ]

    def made():
        live, last, hours = (state.read(spark) for state, _ in states)
        return live_state.snapshot(live, last, gold.merge_partials(hours), counters, moment, arrival="n").collect()

    for batch in range(3):
        for state, partials in states:
            state.write(partials(silver.where(F.col("n") % 3 == batch)), "q", batch)
    assert made() == whole
    for through in (0, 2):
        for state, _ in states:
            state.fold(spark, {"q": through})
    assert made() == whole
    masked = live_state.snapshot(*(s.read(spark) for s, _ in states[:2]), as_of=moment, arrival="n", anonymize=True).first()
    assert all(p["src_ip"] == "x.x.x.xxx" for p in masked["recent_packets"])


def test_old_minutes_leave_the_state(spark, tmp_path):
    state = layers.Layers(str(tmp_path)).live_state
    rows = to_silver(accepted(validate_json(lines(spark, range(120)))), as_of=AS_OF)
    state.write(live_state.partials(rows), "q", 0)
    state.fold(spark, {"q": 0})
    minutes = state.read(spark).where("minute IS NOT NULL").agg(F.min("minute"), F.max("minute")).first()
    assert minutes[1] - minutes[0] <= dt.timedelta(minutes=60)
    assert live_state.merge(state.read(spark)).where("kind = 'total'").first()["packets"] == 120


def test_folding_keeps_every_row_once(spark, tmp_path):
    """A reader sees every row once: with a fold cut off before its pointer, after it, and during deletions."""
    state = BatchState(str(tmp_path / "s"), "k string, n long", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))

    def total():
        return {r["k"]: r["n"] for r in state.merge(state.read(spark)).collect()}

    def add(query, batch, n):
        state.write(spark.createDataFrame([("a", n), ("b", 1), (None, 2)], state.schema), query, batch)

    assert total() == {}
    for batch in range(4):
        add("q", batch, 10)
    add("other", 0, 1)
    wanted = {"a": 41, "b": 5, None: 10}
    assert total() == wanted
    state.fold(spark, {"q": 1})
    assert total() == wanted and state.read(spark).count() == 3 + 3 * 3
    before = state.read(spark)  # planned before the next folds
    state.fold(spark, {"q": 3, "other": 0})
    assert total() == wanted and state.read(spark).count() == 3
    assert {r["k"]: r["n"] for r in state.merge(before).collect()} == wanted
    note = files.read_note(spark, f"{state.folded}/{files.POINTER}")
    # A fold that wrote its version but died before the pointer: the version is an orphan, and the next fold removes it.
    spark.createDataFrame([("z", 1)], state.schema).write.parquet(f"{state.folded}/v-orphan")
    assert total() == wanted and files.read_note(spark, f"{state.folded}/{files.POINTER}") == note
    add("q", 4, 5)
    state.fold(spark, {"q": 4})
    assert total() == {"a": 46, "b": 6, None: 12}
    assert not files.exists(spark, f"{state.folded}/v-orphan")
    # A batch that is held is not counted again, even if its folder is still there.
    add("q", 4, 5)
    assert total() == {"a": 46, "b": 6, None: 12}
    state.fold(spark, {"q": 2})  # never goes back
    assert total() == {"a": 46, "b": 6, None: 12}


def test_gold_state_folds_to_keys_and_values(spark, tmp_path):
    layout = pipeline.Layout(str(tmp_path), "date")
    for batch in range(3):
        pipeline.process_batch(lines(spark, range(60)), batch, layout, query_id="q")
    before = sorted(map(str, pipeline.gold_table(spark, layout).drop("computed_at").collect()))
    many = pipeline.gold_state(layout).read(spark).count()
    pipeline.fold_gold(spark, layout, {"q": 2})
    state = pipeline.gold_state(layout).read(spark)
    sums = pipeline.gold_table(spark, layout).agg(
        F.count("*") + F.sum("unique_src_ips") + F.sum("unique_dst_ips") + F.sum("unique_dst_ports")).first()[0]
    assert state.count() == sums == many / 3
    assert sorted(map(str, pipeline.gold_table(spark, layout).drop("computed_at").collect())) == before


def test_a_batch_tried_again_after_the_manifest(spark, tmp_path):
    """The files keep their names, and a try with fewer files leaves no path behind that doesn't exist."""
    root, log = str(tmp_path / "bronze"), str(tmp_path / "log")
    records = accepted(validate_json(lines(spark, range(40))))
    for parts in (4, 4, 1):
        writers.write_bronze_batch(records.repartition(parts), root, "q", 7, AS_OF, manifest_path=log, agent_id="x")
        assert bronze_source.read_lines(spark, root).count() == 40
        current = manifest.pending_transfer(read_manifest(spark, log)).collect()
        assert sum(r["record_count"] for r in current) == 40
        assert all(files.exists(spark, r["file_path"]) and r["agent_id"] == "x" for r in current)
        assert {(r["partition_dt"], r["partition_hr"]) for r in current} == {("2026-01-15", 12)}
    assert len(current) == 1
    writers.write_bronze_batch(records.where("false"), root, "q", 8, AS_OF, manifest_path=log)
    assert bronze_source.read_lines(spark, root).count() == 40


def test_the_batch_clock_stays(spark, tmp_path):
    first = writers.batch_clock(spark, str(tmp_path), 3)
    assert writers.batch_clock(spark, str(tmp_path), 3) == first
    assert writers.batch_clock(spark, str(tmp_path), 4) >= first
    writers.batch_clock(spark, str(tmp_path), 5)
    assert not files.exists(spark, f"{tmp_path}/_clocks/3.txt") and files.exists(spark, f"{tmp_path}/_clocks/4.txt")


def test_metrics_document_fields(spark):
    def at(seconds):
        return AS_OF - dt.timedelta(seconds=seconds)

    samples = spark.createDataFrame(
        [("queue_to_bronze", float(i), at(2000 - i)) for i in range(1200)] + [("elsewhere", 1.0, at(0))], "stage string, us double, ts timestamp")
    errors = spark.createDataFrame([(at(100 - i), f"c{i % 3}", f"e{i}") for i in range(15)], "ts timestamp, component string, error string")
    readings = spark.createDataFrame([("queue_depth", 5, at(9)), ("queue_depth", None, at(1)), ("other", 7, at(1))], "gauge string, value long, ts timestamp")
    events = spark.createDataFrame([(at(i),) for i in range(30)] + [(None,)], "ts timestamp")
    counts = spark.createDataFrame([(3, None, 1)], "captured long, processed long, unheard_of long")
    rows = health_state.counter_rows(counts).unionByName(health_state.counter_rows(counts))
    for more in (health_state.latency_rows(samples), health_state.error_rows(errors), health_state.gauge_rows(readings),
                 health_state.rate_rows(events), health_state.flush_rows(spark, ("silver", "gold"))):
        rows = rows.unionByName(more)
    plain = health_state.document(rows, AS_OF, at(100)).first()
    folded = health_state.document(health_state.merge(health_state.merge(rows)), AS_OF, at(100)).first()
    assert plain == folded
    assert plain["uptime_sec"] == 100.0 and plain["queue_depth"] == 5 and plain["rates"]["packets_per_sec"] == 1.1
    assert plain["counters"]["captured"] == 6 and plain["counters"]["processed"] == 0 and plain["counters"]["gold_flushes"] == 1
    assert plain["latency_us"].keys() == {"queue_to_bronze"}
    assert plain["latency_us"]["queue_to_bronze"].asDict() == {"p50": 700.0, "p95": 1150.0, "p99": 1190.0}
    assert [e["error"] for e in plain["recent_errors"]] == [f"e{i}" for i in range(5, 15)]
    empty = health_state.document(spark.createDataFrame([], health_state.ROWS), AS_OF).first()
    assert empty["uptime_sec"] is None and empty["latency_us"] == {} and empty["recent_errors"] == []
    assert empty["rates"]["packets_per_sec"] == 0.0 and empty["queue_depth"] == 0
    assert metrics.latency_percentiles(samples).first()["samples"] == 1000


def test_silver_rows_of_a_batch_are_made_once_and_let_go(spark, tmp_path, monkeypatch):
    layout = layers.Layers(str(tmp_path), "date", publish_every=0, fold_every=0)
    seen, done = [], layers._Batch.gold

    def watched(self):
        plan = gold.partials(self.silver_rows)._jdf.queryExecution().optimizedPlan().toString()
        seen.append((self.silver_rows, self.silver_rows.storageLevel.useDisk, "InMemoryRelation [event_ts" in plan))
        done(self)

    monkeypatch.setattr(layers._Batch, "gold", watched)
    layers.process_batch(lines(spark, range(20), bad=1), 0, layout, query_id="q")
    ((rows, kept, read),) = seen
    assert kept and read
    assert not rows.storageLevel.useDisk and not rows.storageLevel.useMemory
    # Also where a layer fails.
    monkeypatch.setattr(layers._Batch, "live", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        layers.process_batch(lines(spark, range(20, 30)), 1, layout, query_id="q")
    assert not seen[1][0].storageLevel.useDisk

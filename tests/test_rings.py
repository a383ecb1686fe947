from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowstrata import files, schemas
from flowstrata.operators import metrics, reports, windows
from flowstrata.operators.silver import to_silver
from flowstrata.sinks.writers import write_export
from flowstrata.sources.tables import read_export
from flowstrata.streaming import rings


def stamp(minute, second=0):
    return f"2026-01-15T{10 + minute // 60:02d}:{minute % 60:02d}:{second:02d}+00:00"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_minute_ring_equals_batch_windows_and_stays_bounded(spark, bronze, tmp_path):
    batches = [
        to_silver(bronze(*[{"timestamp": stamp(m, s), "length": m + s, "protocol": p, "service_info": None}
                           for m in range(start, start + 70, 5) for s in (0, 30) for p in ("TCP", "UDP")]))
        for start in (0, 40, 80)
    ]
    ring = rings.minute_ring(str(tmp_path / "ring"))
    everything = batches[0]
    ring.write(batches[0], 0, "q")
    for i, batch in enumerate(batches[1:], 1):
        ring.write(batch, i, "q")
        ring.write(batch, i, "q")  # a retry
        everything = everything.unionByName(batch)
    names = ("dimension", "window", "name", "bytes", "rank", "bar_pct")
    wanted = rows(windows.trailing_windows(everything, windows.latest(everything)), *names)
    assert wanted and rows(rings.trailing_windows(spark, ring), *names) == wanted
    ring.state.fold(spark, {"q": 2})
    assert rows(rings.trailing_windows(spark, ring), *names) == wanted
    # 145 is the newest minute (at :30): 86 to 145 stay, every fifth of them, for two protocols and one network.
    stored = spark.read.parquet(f"{ring.state.folded}/{ring.state._note(spark)['version']}")
    assert rows(stored.groupBy("dimension").count(), "dimension", "count") == [("protocol", 24), ("subnet", 12)]


def test_late_minutes_leave_the_ring_untouched(spark, bronze, tmp_path):
    ring = rings.minute_ring(str(tmp_path / "ring"))
    ring.write(to_silver(bronze({"timestamp": stamp(100), "length": 7})), 0, "q")
    ring.write(to_silver(bronze({"timestamp": stamp(0), "length": 9}, {"timestamp": stamp(99), "length": 2})), 1, "q")
    got = rings.trailing_windows(spark, ring).where("dimension = 'protocol' and window = '60m'")
    assert rows(got, "name", "bytes") == [("TCP", 9)]
    ring.write(to_silver(bronze()), 2, "q")
    assert rows(rings.trailing_windows(spark, ring).where("dimension = 'protocol' and window = '60m'"), "bytes") == [(9,)]


def test_empty_ring(spark, tmp_path):
    assert rings.trailing_windows(spark, rings.minute_ring(str(tmp_path / "a"))).count() == 0
    assert rings.latency_percentiles(spark, rings.latency_ring(str(tmp_path / "b"))).count() == 0


def test_streamed_ring_folds_on_the_way(spark, tmp_path):
    source = spark.range(4000).select(
        F.lit("capture_to_queue").alias("stage"), (F.col("id") % 977).cast("double").alias("us"),
        F.timestamp_micros("id").alias("ts"), F.col("id").alias("seq"),
    )
    source.repartitionByRange(5, "seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ring = rings.latency_ring(str(tmp_path / "ring"), keep=300)
    ring.start(stream, str(tmp_path / "checkpoint"), fold_every=2).awaitTermination()
    wanted = rows(metrics.latency_percentiles(source, 300, "seq"), "stage", "samples", "p50", "p95", "p99")
    assert rows(rings.latency_percentiles(spark, ring, 300), "stage", "samples", "p50", "p95", "p99") == wanted
    note = json.loads(files.read_note(spark, f"{ring.state.folded}/{files.POINTER}"))
    assert list(note["through"].values()) == [3]
    folded = spark.read.parquet(f"{ring.state.folded}/{note['version']}")
    assert folded.count() == 300


@pytest.mark.parametrize("keep", [1, 1000, 5000])
def test_newest_samples_cut_in_parts(spark, keep):
    samples = spark.range(12000).selectExpr("if(id % 12 = 0, 'silver_to_gold', 'queue_to_bronze') stage", "cast(id as double) us", "id at")
    got = metrics.newest_samples(samples, keep, ["at"])
    assert got.columns == ["stage", "us", "at"]
    counted = {r["stage"]: (r["n"], r["low"]) for r in got.groupBy("stage").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect()}
    assert counted["queue_to_bronze"][0] == keep and counted["silver_to_gold"][0] == min(keep, 1000)
    assert counted["silver_to_gold"][1] == max(0, 12 * (1000 - keep))


def test_periodic_report(spark, bronze):
    day = [{"timestamp": f"2026-01-{d:02d}T10:00:00+00:00", "src_ip": f"10.0.0.{i}", "length": 10, "dst_port": None}
           for d in (12, 13) for i in range(1, 4) for _ in range(i)]
    report = reports.periodic_report(to_silver(bronze(*day)), limit=2)
    sources = report.where("breakdown = 'src_ip'")
    monday = dt.date(2026, 1, 12)
    assert rows(sources.where("unit = 'week'"), "period", "rank", "name", "packets", "names", "period_packets", "period_bytes") == [
        (monday, 1, "10.0.0.3", 6, 3, 12, 120), (monday, 2, "10.0.0.2", 4, 3, 12, 120)
    ]
    assert rows(sources.where("unit = 'day'"), "period", "rank", "packets", "period_packets") == [
        (dt.date(2026, 1, d), r, p, 6) for d in (12, 13) for r, p in ((1, 3), (2, 2))
    ]
    # Ports are all null: no names.
    assert report.where("breakdown = 'dst_port'").count() == 0
    assert reports.periodic_report(spark.createDataFrame([], schemas.SILVER)).count() == 0


def test_subnet_report_keeps_networks_without_ports(bronze):
    got = reports.subnet_report(to_silver(bronze(
        {"dst_port": None, "length": 1}, {"src_ip": "10.0.0.1", "dst_port": 80, "length": 2}, {"src_ip": "10.0.0.1", "dst_port": None, "length": 3}
    )))
    assert rows(got, "src_network", "dst_port", "rank", "packets", "subnet_packets", "subnet_bytes") == [
        ("10.0.0.0/24", 80, 1, 1, 2, 5), ("192.168.7.0/24", None, None, None, 1, 1)
    ]


def test_export_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "export")
    schema = "unit string, name string, n long"
    assert read_export(spark, path, schema).count() == 0
    texts = [("day", 'say "hi", you', 1), ("day", "two\nlines", 2), ("week", "", 3), ("week", None, 4), ("day", "back\\slash", 5)]
    write_export(spark.createDataFrame(texts, schema), path, ("unit",))
    names = ("unit", "name", "n")
    wanted = sorted([(u, t or None, n) for u, t, n in texts], key=str)
    assert rows(read_export(spark, path, schema), *names) == wanted
    before = read_export(spark, path, schema)
    # A writer that dies leaves a version that no pointer names.
    spark.createDataFrame([("day", "lost", 9)], schema).write.csv(f"{path}/v-dead", header=True)
    assert rows(read_export(spark, path, schema), *names) == wanted
    write_export(spark.createDataFrame([("day", "new", 6)], schema), path, ("unit",))
    assert rows(read_export(spark, path, schema), *names) == [("day", "new", 6)]
    assert before.count() == 5  # a reader that has begun still finds its version
    assert sorted(n for n, d in files.children(spark, path) if d and n == "v-dead") == []

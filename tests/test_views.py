from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from flowstrata.functions import network as net
from flowstrata.operators import gold, manifest, metrics, reports, search, snapshot, traffic, windows
from flowstrata.operators.silver import to_silver
from flowstrata.sinks.writers import write_partitioned
from flowstrata.sources.tables import read_silver


def stamp(minute, second=0):
    return f"2026-01-15T10:{minute:02d}:{second:02d}Z"


@pytest.fixture
def silver(bronze):
    return to_silver(bronze(
        {"timestamp": stamp(0), "length": 10, "service_info": "DNS A x"},
        {"timestamp": stamp(1), "length": 20, "protocol": "UDP", "dst_port": 5353},
        {"timestamp": stamp(50), "length": 30, "src_ip": "8.8.8.8", "service_info": ""},
        {"timestamp": stamp(58), "length": 40, "dst_port": None, "src_port": None, "protocol": "ICMP"},
        {"timestamp": stamp(59, 59), "length": 50, "src_ip": "172.64.0.1"},
    ), as_of="2026-01-15T11:00:00")


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_gold_counts_each_key_once(bronze):
    rows = to_silver(bronze({}, {"dst_port": None, "length": 300}, {"src_ip": "192.168.7.10"}, {"agent_id": "b"}))
    got = {r["agent_id"]: r for r in gold.hourly(rows).collect()}
    assert (got["probe"]["packet_count"], got["probe"]["total_bytes"]) == (3, 500)
    assert (got["probe"]["unique_src_ips"], got["probe"]["unique_dst_ips"], got["probe"]["unique_dst_ports"]) == (2, 1, 1)
    assert got["probe"]["avg_packet_size"] == pytest.approx(500 / 3)
    assert got["b"]["packet_count"] == 1


def test_gold_of_nothing(silver):
    assert gold.hourly(silver.where("length < 0")).count() == 0


def test_hot_gold_key_is_spread_by_partial_aggregation(silver):
    plan = gold.hourly(silver)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Expand" in plan and "CartesianProduct" not in plan


def test_breakdowns_equal_single_queries(silver):
    one_pass = traffic.breakdowns(silver)
    singles = {
        "protocols": traffic.protocols(silver), "top_src_ips": traffic.source_ips(silver),
        "top_dst_ips": traffic.destination_ips(silver), "top_subnets": traffic.subnets(silver),
        "top_dst_ports": traffic.destination_ports(silver), "port_stats": traffic.ports(silver),
        "services": traffic.services(silver),
    }
    for name, single in singles.items():
        key = traffic.BREAKDOWNS[name][0][0]
        want = sorted((str(r[key]), r["packets"]) for r in single.collect())
        got = sorted((r["name"], r["packets"]) for r in one_pass.where(F.col("breakdown") == name).collect())
        assert got == want, name


def test_breakdown_rank_is_cut_before_the_shuffle(silver):
    assert "WindowGroupLimit" in traffic.breakdowns(silver)._jdf.queryExecution().executedPlan().toString()


def test_shares_of_an_empty_table(silver):
    nothing = silver.where("length < 0")
    assert traffic.protocol_view(nothing).count() == 0
    total = traffic.totals(nothing).first()
    assert (total["packets"], total["bytes"]) == (0, 0)


def test_port_modes(silver):
    assert sorted(r["dst_port"] for r in traffic.port_view(silver, "hide_os_noise").collect()) == [443]
    services = {r["dst_port"]: r["service"] for r in traffic.port_view(silver).collect()}
    assert services == {443: "HTTPS", 5353: "mDNS"}
    with pytest.raises(ValueError):
        traffic.port_view(silver, "other")


def test_trailing_windows_cut_whole_minutes(silver):
    got = {
        (r["window"], r["name"]): r["bytes"]
        for r in windows.protocol_windows(silver, dt.datetime(2026, 1, 15, 11, 0, 30)).collect()
    }
    assert got[("5m", "TCP")] == 50 and got[("5m", "ICMP")] == 40
    assert got[("10m", "TCP")] == 50  # 10:50 is 10.5 minutes old
    assert got[("30m", "TCP")] == 80
    assert got[("60m", "TCP")] == 80 and got[("60m", "UDP")] == 20  # 10:00 is 60.5 minutes old


def test_windows_with_fixed_moment_prune_dates(spark, silver, tmp_path):
    write_partitioned(silver, str(tmp_path))
    found = windows.trailing_windows(read_silver(spark, str(tmp_path)), dt.datetime(2026, 1, 15, 11))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[[^]]*\]", plan)[0]
    assert "event_date" in filters and "2026-01-14" in filters


def test_recent_is_in_arrival_order(bronze):
    rows = to_silver(bronze(*[{"timestamp": stamp(i % 60, i // 60), "length": i} for i in range(100)]))
    got = pairs(search.recent_packets(rows.withColumn("n", F.col("length")), "n"), "n")
    assert [n for (n,) in got] == list(range(40, 100))


@pytest.mark.parametrize("arguments, count", [
    ({"proto": "tcp"}, 3), ({"src_subnet": "192.168.7"}, 3), ({"src_subnet": "192.168.7.0"}, 3), ({"src_subnet": "192.168"}, 3),
    ({"src_subnet": "192.168.70"}, 0), ({"src_subnet": "8"}, 1), ({"dst_port_min": 444}, 1), ({"dst_port_max": "443"}, 3),
    ({"dst_port_min": "x"}, 5), ({"dst_port_min": 70000}, 5), ({"port_category": "Unknown"}, 1), ({"q": "dns a"}, 1),
    ({"q": "none"}, 0), ({"q": "8.8.8.8 10.1"}, 1), ({"where": "length > 25 AND protocol = 'TCP'"}, 2), ({}, 5),
])
def test_search(silver, arguments, count):
    assert search.search_packets(silver, **arguments).count() == count


def test_search_order(silver):
    assert [r["length"] for r in search.search_packets(silver, sort="len_desc").collect()] == [50, 40, 30, 20, 10]
    assert [r["length"] for r in search.search_packets(silver, limit=2).collect()] == [50, 40]


@pytest.mark.parametrize("ip, private", [
    ("10.0.0.1", True), ("172.16.0.1", True), ("172.31.255.255", True), ("172.32.0.1", False), ("192.168.0.1", True),
    ("169.254.9.9", True), ("8.8.8.8", False), ("266.0.0.1", False), ("10.0.0", False), ("fe80::1", False), ("", False),
    (None, False), ("10.a.0.1", False), ("10..0.1", False),
])
def test_private_addresses(spark, ip, private):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(net.is_private_ipv4(F.col("ip"))).first()[0] is private


def test_masking(silver):
    got = sorted(pairs(search.anonymize_packets(silver), "src_ip", "src_port", "dst_ip", "dst_port", "src_network"), key=str)
    assert got == sorted([
        ("x.x.x.xxx", "****", "x.x.x.xxx", "****", "x.x.x.0/24"), ("x.x.x.xxx", "****", "x.x.x.xxx", "****", "x.x.x.0/24"),
        ("8.8.8.8", "40000", "x.x.x.xxx", "****", "8.8.8.0/24"), ("x.x.x.xxx", None, "x.x.x.xxx", None, "x.x.x.0/24"),
        ("172.64.0.1", "40000", "x.x.x.xxx", "****", "172.64.0.0/24"),
    ], key=str)


@pytest.mark.parametrize("size, text", [(0, "0.0 B"), (1023, "1023.0 B"), (1536, "1.5 KiB"), (97536, "95.2 KiB"), (98048, "95.8 KiB"), (1024**2, "1.0 MiB"),
                                        (5 * 1024**3, "5.0 GiB"), (1024**5, "1024.0 TiB")])
def test_human_bytes(spark, size, text):
    assert spark.range(1).select(net.human_bytes(F.lit(size))).first()[0] == text


def test_snapshot(silver, spark):
    counters = spark.createDataFrame([(980, 20, None, 5, 1)], "os_recv long, os_drop long, os_ifdrop long, app_queued long, app_dropped long")
    document = snapshot.live_snapshot(silver, gold.hourly(silver), counters, dt.datetime(2026, 1, 15, 11), arrival="event_ts")
    got = json.loads(snapshot.snapshot_document(document).first()["document"])
    assert (got["total_packets"], got["total_bytes"]) == (5, 150)
    assert got["protocols"][0] == {"name": "TCP", "packets": 3, "bytes": 90}
    assert [p["length"] for p in got["recent_packets"]] == [10, 20, 30, 40, 50]
    assert got["gold"]["UDP"]["packets"] == 1
    assert got["protocol_windows"]["5m"][0] == {"name": "TCP", "bytes": 50}
    assert got["capture_health"]["drop_rate_pct"] == 2.0
    health = snapshot.health_document(document).first()
    assert (health["status"], health["os_drop"]) == ("yellow", 20)


def test_latency_percentiles(spark):
    rows = [("queue_to_bronze", float(i), i) for i in range(100)] + [("unknown", 1.0, 0)]
    rows += [("silver_to_gold", float(i), i) for i in range(2000)]
    got = {r["stage"]: r for r in metrics.latency_percentiles(
        spark.createDataFrame(rows, "stage string, us double, seq long"), order="seq").collect()}
    assert set(got) == {"queue_to_bronze", "silver_to_gold"}
    assert [got["queue_to_bronze"][p] for p in ("p50", "p95", "p99")] == [50.0, 95.0, 99.0]
    assert [got["silver_to_gold"][p] for p in ("samples", "p50", "p99")] == [1000, 1500.0, 1990.0]


def test_gauges_keep_old_value_over_null(spark):
    rows = [("depth", 5, 1), ("depth", None, 2), ("recv", 1, 1), ("recv", 9, 3)]
    df = spark.createDataFrame(rows, "gauge string, value long, ts long")
    assert sorted(pairs(metrics.gauges(df), "gauge", "value")) == [("depth", 5), ("recv", 9)]


def test_health_of_nothing_seen(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0), (1000, 1000, 0, 0, 0)],
                               "os_recv long, os_drop long, os_ifdrop long, app_queued long, app_dropped long")
    assert sorted(pairs(metrics.capture_health(df), "drop_rate_pct", "status")) == [(0.0, "green"), (50.0, "red")]


def test_data_age(silver):
    assert metrics.data_age(silver, "2026-01-15T11:00:04").first().asDict() == {"age_sec": 4.0, "healthy": True}
    assert metrics.data_age(silver, "2026-01-15T10:00:00").first()["age_sec"] == 0.0
    assert metrics.data_age(silver.where("length < 0"), "2026-01-15T11:00:00").first().asDict() == {
        "age_sec": None, "healthy": False}


def test_manifest_last_write_wins(spark):
    from flowstrata import schemas

    def line(seq, path, state, moved=None):
        return (seq, path, state, "2026-01-15", 3, "", None, moved, 10, 2, "a")

    log = spark.createDataFrame([
        line(1, "a", "ACTIVE"), line(2, "b", "SEALED"), line(3, "a", "SEALED"), line(4, "c", "TRANSFERRED", "2026-01-01T00:00:00Z"),
        line(5, "d", "TRANSFERRED", "bad"), line(6, "e", "TRANSFERRED", None),
    ], schemas.MANIFEST)
    assert sorted(pairs(manifest.pending_transfer(log), "file_path")) == [("a",), ("b",)]
    assert pairs(manifest.retention_candidates(log, "2026-01-10T00:00:00"), "file_path") == [("c",)]
    assert manifest.compaction_candidates(log).first()["files"] == 2
    done = log.unionByName(manifest.mark_archived(log, log.select("file_path").where("file_path IN ('a', 'nope')")))
    assert sorted(pairs(manifest.current_state(done), "file_path", "state"))[0] == ("a", "ARCHIVED")
    assert manifest.current_state(done).count() == 5


def test_flow_sessions_match_brute_force(spark, bronze):
    seconds = [0, 10, 299, 300, 601, 1000, 1299, 1600, 1899, 1900]
    rows = to_silver(bronze(*[
        {"timestamp": f"2026-01-15T10:{s // 60:02d}:{s % 60:02d}Z", "length": 1} for s in seconds
    ]))
    want, last = [], None
    for s in seconds:
        if last is None or s - last >= 300:
            want.append(0)
        want[-1] += 1
        last = s
    got = [r["packets"] for r in reports.flow_sessions(rows, 300).orderBy("first_seen").collect()]
    assert got == want

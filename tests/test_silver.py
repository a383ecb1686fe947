from __future__ import annotations

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowstrata import schemas
from flowstrata.functions import timestamps as iso
from flowstrata.operators.silver import to_silver
from flowstrata.operators.validation import accepted, quarantine_rows, rejected, validate_json, validate_records

UTC = dt.timezone.utc


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_schema_and_values(bronze):
    silver = to_silver(bronze({}), as_of="2026-01-16T00:00:00")
    assert silver.schema.fieldNames() == schemas.SILVER.fieldNames()
    assert [f.dataType for f in silver.schema] == [f.dataType for f in schemas.SILVER]
    row = rows(silver)[0]
    assert row["event_ts"] == dt.datetime(2026, 1, 15, 10, 30, 45, 123456)
    assert row["event_hour"] == dt.datetime(2026, 1, 15, 10)
    assert row["event_date"] == dt.date(2026, 1, 15)
    assert row["ingested_at"] == dt.datetime(2026, 1, 16)
    assert row["src_network"] == "192.168.7.0/24"
    assert row["port_category"] == "well_known"


TIMES = [
    "2026-01-15", "2026-01-15T10", "2026-01-15 10:30", "2026-01-15T10:30:59", "2026-01-15T10:30:59.5",
    "2026-01-15T10:30:59.123456", "2026-01-15T10:30:59.123456789", "2026-01-15T10:30:59Z", "2026-01-15T10:30Z",
    "2026-01-15T00:30:00+02:00", "2026-01-15T23:30:00-05:00", "2026-01-15T12:10:00+05:30", "2026-01-15T12:10:00-0530",
    "2026-01-15T10:30:00-00:30", "1969-12-31T23:59:59.999999", "0001-01-02T00:00:00", "2024-02-29T12:00:00",
    # Not timestamps.
    "", "x", "not-a-date", "2026", "2026-02", "2026-1-5", "2026-02-30T10:00", "2026-01-15T24:30", "2026-01-15T10:61",
    "2026-01-15T10:30:00+25:00", "2026-01-15 10:30 Europe/Paris", "T10:30", "0000-01-01", "2026-13-01", "2023-02-29",
    "2026-01-15T10:30:00 ", "2026-01-15T10:30:00+02:0",
]


def expected_time(text):
    try:
        moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    aware = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    naive = aware.astimezone(UTC).replace(tzinfo=None)
    hour = aware.replace(minute=0, second=0, microsecond=0).astimezone(UTC).replace(tzinfo=None)
    return naive, hour, aware.date()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_match_python(spark, bronze, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = to_silver(bronze(*[{"timestamp": t, "flags": t} for t in TIMES]))
        text = df.selectExpr("flags", "unix_micros(event_ts) AS ts", "unix_micros(event_hour) AS hr", "event_date")
        got = {r["flags"]: r for r in text.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    epoch = dt.datetime(1970, 1, 1)

    def micros(moment):
        return (moment - epoch) // dt.timedelta(microseconds=1)

    for text in TIMES:
        wanted = expected_time(text)
        if wanted is None:
            assert text not in got, text
        else:
            row = got[text]
            assert (row["ts"], row["hr"], row["event_date"]) == (micros(wanted[0]), micros(wanted[1]), wanted[2]), text


def test_utc_buckets(bronze):
    row = rows(to_silver(bronze({"timestamp": "2026-01-15T00:30:00+02:00"}), utc_buckets=True))[0]
    assert row["event_date"] == dt.date(2026, 1, 14)
    assert row["event_hour"] == dt.datetime(2026, 1, 14, 22)


@pytest.mark.parametrize("ip, network", [
    ("10.0.0.1", "10.0.0.0/24"), ("invalid", "invalid"), ("1.2.3", "1.2.3"), ("1.2.3.4.5", "1.2.3.4.5"),
    ("", ""), ("fe80::1", "fe80::1"), ("a.b.c.d", "a.b.c.0/24"), (None, "0.0.0.0/24"),
])
def test_source_network(bronze, ip, network):
    assert rows(to_silver(bronze({"src_ip": ip})))[0]["src_network"] == network.replace("0.0.0.0/24", "0.0.0.0/24")


@pytest.mark.parametrize("src, dst, category", [
    (None, None, "unknown"), (5353, 443, "os_noise"), (443, 1900, "os_noise"), (50000, 80, "well_known"),
    (22, None, "well_known"), (None, 49152, "ephemeral"), (49151, 9000, "user_app"), (None, 0, "user_app"),
    (60000, 9000, "ephemeral"),
])
def test_port_category(bronze, src, dst, category):
    assert rows(to_silver(bronze({"src_port": src, "dst_port": dst})))[0]["port_category"] == category


def test_missing_columns_get_defaults(spark):
    df = spark.createDataFrame([("2026-01-15T10:00:00Z",)], "timestamp string")
    row = rows(to_silver(df))[0]
    assert (row["src_ip"], row["dst_ip"], row["protocol"], row["length"], row["agent_id"]) == (
        "0.0.0.0", "0.0.0.0", "OTHER", 0, "")


def test_validate_records(bronze):
    checked = validate_records(bronze({}, {"length": -1}, {"timestamp": None}, {"protocol": ""}))
    assert [r["protocol"] for r in rows(accepted(checked))] == ["TCP", "OTHER"]
    bad = rows(quarantine_rows(checked, as_of="2026-01-01T00:00:00"))
    assert sorted(r["reason"] for r in bad) == [
        "length: must be greater than or equal to 0", "timestamp: field required"]
    assert all(json.loads(r["raw"])["src_ip"] == "192.168.7.9" and r["ts"].startswith("2026-01-01") for r in bad)


GOOD = {"timestamp": "2026-01-15T10:00:00Z", "length": 5}


@pytest.mark.parametrize("change, field, value", [
    ({"length": "12"}, "length", 12), ({"length": " 12 "}, "length", 12), ({"length": 12.0}, "length", 12),
    ({"length": "12.0"}, "length", 12), ({"length": True}, "length", 1), ({"dst_port": None}, "dst_port", None),
    ({"dst_port": 443}, "dst_port", 443), ({"protocol": None}, "protocol", "OTHER"), ({"protocol": 6}, "protocol", "6"),
    ({"protocol": "udp"}, "protocol", "UDP"), ({}, "src_ip", "0.0.0.0"), ({}, "agent_id", "me"),
    ({"length": 1e3}, "length", 1000), ({"flags": None}, "flags", None), ({"length": 10**12}, "length", 10**12),
])
def test_lax_json_accepts(spark, change, field, value):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "value string")
    got = rows(accepted(validate_json(df, default_agent="me")))
    assert len(got) == 1 and got[0][field] == value


@pytest.mark.parametrize("line, reason", [
    ({**GOOD, "length": -1}, "length: must be greater than or equal to 0"),
    ({**GOOD, "length": 1.5}, "length: must be an integer in range"),
    ({**GOOD, "length": "x"}, "length: must be an integer in range"),
    ({**GOOD, "dst_port": "eighty"}, "dst_port: must be an integer in range"),
    ({**GOOD, "dst_port": 2**40}, "dst_port: must be an integer in range"),
    ({**GOOD, "src_ip": 5}, "src_ip: must be a string"), ({**GOOD, "src_ip": None}, "src_ip: must not be null"),
    ({**GOOD, "flags": [1]}, "flags: must be a string"), ({"length": 5}, "timestamp: field required"),
    ({"timestamp": "x"}, "length: field required"), ({**GOOD, "length": None}, "length: must not be null"),
    ({**GOOD, "timestamp": 12}, "timestamp: must be a string"),
    ("{broken", "record: not a JSON object"), ("[1, 2]", "record: not a JSON object"), ("7", "record: not a JSON object"),
    ("null", "record: not a JSON object"), ("", "record: not a JSON object"),
])
def test_json_rejects(spark, line, reason):
    text = line if isinstance(line, str) else json.dumps(line)
    checked = validate_json(spark.createDataFrame([(text,)], "value string"))
    assert [r["errors"] for r in rows(rejected(checked))] == [reason]
    assert accepted(checked).count() == 0


def test_rescued_fields(spark):
    lines = [json.dumps({**GOOD, "vlan": 7, "tags": ["a"]}), json.dumps({**GOOD, "ttl": "old"}), json.dumps(GOOD)]
    checked = validate_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["value"]: r["_rescued_data"] for r in rows(checked)}
    assert json.loads(got[lines[0]]) == {"vlan": 7, "tags": ["a"]}
    assert json.loads(got[lines[1]]) == {"ttl": "old"}
    assert got[lines[2]] is None


TEXT = st.one_of(st.none(), st.text(max_size=30), st.sampled_from(TIMES))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TEXT, TEXT, TEXT), min_size=30, max_size=60))
def test_any_text_gives_no_failure(spark, values):
    clean = [tuple(None if v is None else v.encode("utf-8", "ignore").decode() for v in t) for t in values]
    df = spark.createDataFrame(clean, "timestamp string, src_ip string, protocol string")
    for row in to_silver(df).collect():
        assert row["event_ts"] is not None and row["src_network"] is not None and row["protocol"]
    lines = df.selectExpr("coalesce(timestamp, '') AS value").unionByName(df.selectExpr("to_json(struct(*)) AS value"))
    checked = validate_json(lines)
    assert accepted(checked).count() + rejected(checked).count() == 2 * len(clean)


def test_filter_does_not_repeat_the_parse(bronze):
    plan = to_silver(bronze({}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_minute_and_iso_text(spark):
    row = spark.range(1).select(
        iso.minute_of(iso.as_instant("2026-01-15T10:30:45.5")).alias("m"),
        iso.iso_text(iso.as_instant("2026-01-15T10:30:45.5")).alias("t"),
    ).first()
    assert row["m"] == dt.datetime(2026, 1, 15, 10, 30)
    assert row["t"] == "2026-01-15T10:30:45.500000+00:00"

from __future__ import annotations

import datetime as dt
import random
import socket
import struct

import pyarrow as pa
import pytest

from flowstrata import schemas
from flowstrata.functions import payloads
from flowstrata.operators.decode import decode_frames
from flowstrata.operators.silver import to_silver
from flowstrata.operators.validation import accepted, validate_records

AT = dt.datetime(2026, 1, 15, 10, 0, 0)


def ipv4(body, number, ttl=64, fragment=0, options=b"", total=None):
    size = 20 + len(options) + len(body) if total is None else total
    head = struct.pack(">BBHHHBBH4s4s", 0x40 | (5 + len(options) // 4), 0, size, 1, fragment, ttl, number, 0,
                       socket.inet_aton("192.168.7.9"), socket.inet_aton("10.1.2.3"))
    return head + options + body


def ether(body, kind=0x0800, tags=b""):
    return b"\xff" * 6 + b"\x00" * 6 + tags + struct.pack(">H", kind) + body


def tcp(dport, payload=b"", flags=0x18, sport=40000, offset=5):
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 0, offset << 4, flags, 8192, 0, 0) + b"\x00" * (4 * (offset - 5)) + payload


def udp(dport, payload=b"", sport=40000):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def hello(name=b"www.example.com", extra=b""):
    entry = struct.pack(">BH", 0, len(name)) + name
    sni = struct.pack(">HHH", 0, len(entry) + 2, len(entry)) + entry
    extensions = extra + sni
    body = b"\x03\x03" + b"r" * 32 + b"\x04abcd" + b"\x00\x04\x13\x01\x13\x02" + b"\x01\x00"
    body += struct.pack(">H", len(extensions)) + extensions
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def query(name=b"\x07example\x03com\x00", kind=1, flags=0x0100, count=1):
    return struct.pack(">HHHHHH", 1, flags, count, 0, 0, 0) + name + struct.pack(">HH", kind, 1)


def decode(spark, *frames):
    df = spark.createDataFrame([(i, AT, bytearray(f)) for i, f in enumerate(frames)], schemas.FRAMES)
    return {r["frame_id"]: r for r in decode_frames(df, agent_id="tap").collect()}


def test_headers(spark):
    options = ipv4(tcp(443, flags=0x12), 6, ttl=7, options=b"\x01" * 8)
    got = decode(
        spark, ether(ipv4(tcp(443, flags=0x12), 6)), ether(ipv4(udp(9000), 17)), ether(ipv4(b"\x08\x00ping", 1)),
        ether(ipv4(b"", 47)), ether(options), ether(ipv4(udp(53), 17), tags=b"\x81\x00\x00\x05"),
        ether(ipv4(udp(53), 17), tags=b"\x88\xa8\x00\x05\x81\x00\x00\x06"),
        # A later fragment and a cut TCP header have no ports.
        ether(ipv4(udp(53), 17, fragment=3)), ether(ipv4(tcp(443)[:12], 6)),
        # A data offset below five is no TCP header; total length 0 means the whole rest.
        ether(ipv4(tcp(443, offset=5)[:12] + b"\x40" + tcp(443)[13:], 6)), ether(ipv4(udp(9000), 17, total=0)),
        # None of these is an IPv4 packet.
        b"\x00" * 10, ether(b"\x00" * 28, 0x0806), ether(b"\x60" + b"\x00" * 40, 0x86DD), ether(b"\x65" + ipv4(b"", 6)[1:]),
        ether(b"\x44" + ipv4(b"", 6)[1:]), b"",
    )
    assert sorted(got) == list(range(11))
    first = got[0]
    assert first.asDict() == {
        "frame_id": 0, "timestamp": "2026-01-15T10:00:00.000000+00:00", "src_ip": "192.168.7.9", "dst_ip": "10.1.2.3",
        "src_port": 40000, "dst_port": 443, "protocol": "TCP", "length": 54, "ttl": 64, "flags": "SA", "agent_id": "tap",
        "service_info": None,
    }
    assert [got[i]["protocol"] for i in range(4)] == ["TCP", "UDP", "ICMP", "PROTO_47"]
    assert [got[i]["dst_port"] for i in range(1, 11)] == [9000, None, None, 443, 53, 53, None, None, None, 9000]
    assert got[4]["ttl"] == 7 and got[1]["flags"] is None


@pytest.mark.parametrize("bits, text", [(0, ""), (1, "F"), (0x12, "SA"), (0xFF, "FSRPAUEC")])
def test_flags(spark, bits, text):
    assert decode(spark, ether(ipv4(tcp(1, flags=bits), 6)))[0]["flags"] == text


REQUEST = b"GET /foo HTTP/1.1\r\nHost: example.com\r\nAccept: x\r\n\r\n"
SERVICES = [
    (tcp(443, hello()), 6, "HTTPS/TLS SNI=www.example.com"),
    (tcp(443, hello(extra=b"\x00\x0b\x00\x02\x01\x00")), 6, "HTTPS/TLS SNI=www.example.com"),
    (tcp(443, b"\x16\x03\x01\x00\x20\x01" + b"\x00" * 40), 6, "HTTPS/TLS"),
    (tcp(443, hello()[:60]), 6, "HTTPS/TLS"), (tcp(443, b"\x16\x03"), 6, None), (tcp(443, b""), 6, None),
    (tcp(443, b"\x17" + hello()[1:]), 6, None),
    (tcp(80, REQUEST), 6, "HTTP GET example.com/foo"), (tcp(8001, REQUEST), 6, "HTTP GET example.com/foo"),
    (tcp(80, b"POST /p HTTP/1.0\r\n\r\n"), 6, "HTTP POST /p"),
    (tcp(80, b"GET /foo HTTP/1.1\r\nHost: example.com\r\n"), 6, None),
    (tcp(80, b"POST /p HTTP/1.1\r\nContent-Length: 9\r\n\r\nshort"), 6, None),
    (tcp(80, b"POST /p HTTP/1.1\r\nContent-Length: 5\r\n\r\nabcde"), 6, "HTTP POST /p"),
    (tcp(80, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<a>"), 6, "HTTP 200 text/html"),
    (tcp(80, b"HTTP/1.1 304 Not Modified\r\n\r\n"), 6, "HTTP 304"), (tcp(80, b"garbage\r\n\r\n"), 6, None),
    (udp(53, query()), 17, "DNS A example.com"), (udp(53, query(kind=28)), 17, "DNS AAAA example.com"),
    (udp(53, query(kind=9999)), 17, "DNS 9999 example.com"), (udp(53, query(name=b"\x00", kind=2)), 17, "DNS NS"),
    (udp(53, query(flags=0x8180)), 17, None), (udp(53, query(count=0)), 17, None), (udp(53, b"dns"), 17, None),
    (udp(53, query(name=b"\xc0\x0c")), 17, None), (udp(53, query()[:-3]), 17, None),
    (tcp(22, b"SSH-2.0-Open\xffSSH_8.9 \r\nrest"), 6, "SSH-2.0-OpenSSH_8.9"), (tcp(22, b"hello"), 6, None),
    (tcp(22, b"SSH-" + b"a" * 100), 6, "SSH-" + "a" * 76),
    (tcp(25, b"220 mail ready\r\n"), 6, "220 mail ready"), (tcp(587, b"250 no"), 6, None),
    # Only the destination port counts, unless it is 0.
    (tcp(50000, b"SSH-2.0-x\n", sport=22), 6, None), (tcp(0, b"SSH-2.0-x\n", sport=22), 6, "SSH-2.0-x"),
    (udp(443, hello()), 17, None), (tcp(9000, REQUEST), 6, None),
]


def test_services(spark):
    got = decode(spark, *[ether(ipv4(body, number)) + b"\x00" * 4 for body, number, _ in SERVICES])
    for i, (_, _, label) in enumerate(SERVICES):
        assert got[i]["service_info"] == label, i


def _spoilt(payload, rng):
    """The payload with some bytes changed, or cut off."""
    data = bytearray(payload)
    for _ in range(rng.randint(0, 3)):
        data[rng.randrange(len(data))] = rng.choice([0, 1, 3, 5, 16, 63, 64, 0xC0, 0xC3, 0xFF, rng.randrange(256)])
    return bytes(data[: rng.randint(0, len(data))] if rng.random() < 0.3 else data)


@pytest.mark.parametrize("whole_batch, alone, samples", [
    (payloads._dns_labels, payloads._dns_question, [
        query(), query(kind=28), query(kind=9999), query(name=b"\x00"), query(name=b"\xc0\x0c"), query(name=b"\x03a\xffb\x00"),
        query(name=b"\x01a\xc0\x0c"), query(name=b"\x02\xc3\xbc\x03com\x00"), query(name=b"\x3f" + b"x" * 63 + b"\x00"), query(count=0),
    ]),
    (payloads._tls_labels, payloads._server_name, [
        hello(), hello(extra=b"\x00\x0b\x00\x02\x01\x00" * 3), hello(b""), hello(b"xn--bcher-kva.example"), hello(b"XN--a"),
        hello(b"a\xffb.com"), hello(b"a..b"), hello(extra=b"\x00\x00\x00\x01\x00"), hello()[:43], hello()[:44],
    ]),
])
def test_batch_walk_reads_as_one_by_one(whole_batch, alone, samples):
    rng = random.Random(7)
    rows = [*samples, None, b"", *(_spoilt(rng.choice(samples), rng) for _ in range(4000))]
    wanted = [None if r is None else alone(r) for r in rows]
    assert whole_batch(pa.array(rows, pa.binary())).to_pylist() == wanted
    # A slice has an offset of its own; empty and all-null batches have no data.
    assert whole_batch(pa.array(rows, pa.binary())[5:60]).to_pylist() == wanted[5:60]
    assert whole_batch(pa.array([], pa.binary())).to_pylist() == []
    assert whole_batch(pa.array([None, None], pa.binary())).to_pylist() == [None, None]


def test_frames_reach_silver(spark):
    df = spark.createDataFrame([(0, AT, bytearray(ether(ipv4(b"ping", 1))))], schemas.FRAMES)
    row = to_silver(accepted(validate_records(decode_frames(df)))).first()
    assert (row["protocol"], row["src_port"], row["port_category"], row["event_ts"]) == ("ICMP", None, "unknown", AT)

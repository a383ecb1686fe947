from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from flowstrata.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "flowstrata-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def packet():
    """One Bronze record; keyword arguments replace fields."""

    def make(**fields):
        base = {
            "timestamp": "2026-01-15T10:30:45.123456+00:00", "src_ip": "192.168.7.9", "dst_ip": "10.1.2.3",
            "src_port": 40000, "dst_port": 443, "protocol": "TCP", "length": 100, "ttl": 64, "flags": "SA",
            "agent_id": "probe", "service_info": None,
        }
        return {**base, **fields}

    return make


@pytest.fixture
def bronze(spark, packet):
    from flowstrata import schemas

    def make(*changes):
        rows = [packet(**c) for c in changes]
        return spark.createDataFrame([tuple(r[n] for n in schemas.BRONZE.fieldNames()) for r in rows], schemas.BRONZE)

    return make

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from flowstrata.sources import evolution

TARGET = T.StructType([T.StructField("length", T.LongType()), T.StructField("name", T.StringType())])


@pytest.fixture
def table(spark, tmp_path):
    """Twenty rows of two schemas and a broken file, also reachable by a path that only Spark can open."""
    folder = tmp_path / "t" / "event_date=2026-01-15"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"length": list(range(10)), "name": ["a"] * 10}), folder / "a.parquet")
    pq.write_table(pa.table({"name": ["b"] * 10}), folder / "b.parquet")
    (folder / "broken.parquet").write_bytes(b"PAR1 no footer PAR1")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    spark._jsc.hadoopConfiguration().setBoolean("fs.viewfs.impl.disable.cache", True)
    return str(tmp_path / "t")


def test_store_that_only_spark_opens(spark, table):
    for root in (table, "viewfs://store/in/t"):
        assert evolution.read_with_evolution(spark, root, TARGET).count() == 20
        assert [r.path.rsplit("/", 1)[1] for r in evolution.unreadable_files(spark, root).collect()] == ["broken.parquet"]


def test_a_failing_store_fails_the_job(spark, table, monkeypatch):
    monkeypatch.setattr(evolution, "_RANGED", ("viewfs",))
    with pytest.raises(Exception, match="libhdfs|nrecognized|Protocol"):
        evolution.read_with_evolution(spark, "viewfs://store/in/t", TARGET).count()


def test_strict_nulls_whole_files(spark, tmp_path):
    folder = tmp_path / "s" / "event_date=2026-01-15"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"length": ["7", "x"], "name": ["a", "b"]}), folder / "a.parquet")
    pq.write_table(pa.table({"length": ["8", "9"], "name": ["c", "d"]}), folder / "b.parquet")
    rows = evolution.read_with_evolution(spark, str(tmp_path / "s"), TARGET, strict=True).collect()
    assert {r["name"]: r["length"] for r in rows} == {"a": None, "b": None, "c": 8, "d": 9}

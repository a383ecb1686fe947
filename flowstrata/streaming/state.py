"""Partial rows of a stream's batches, which merge by aggregation, and their folding.

A batch replaces its own partition, so a batch that is tried again changes nothing. ``fold`` merges the rows of all
batches that are done into one new version and then names it in a pointer file, together with the last batch of each
query that it holds. Readers take the version that the pointer names and the batches it doesn't hold, so they see every
row once at any moment: before the pointer is replaced, after it, and while old batches are deleted. What a fold has
replaced is deleted by the next one, which gives readers that have begun the time between two folds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..sinks.writers import overwrite_partitions

QUERY, BATCH = "ingest_query", "ingest_batch"


@dataclass(frozen=True)
class BatchState:
    """``path``: partial rows below ``by``, query and batch. ``merge`` folds rows into fewer of the same columns and may be
    applied to its own result. ``schema``: the rows' columns as DDL; ``by`` names some of them."""

    path: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]
    by: tuple[str, ...] = ()

    @property
    def folded(self) -> str:
        return f"{self.path}_folded"

    @property
    def columns(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).fieldNames()

    def write(self, rows: DataFrame, query: str, batch: int) -> None:
        """Replaces the rows of one batch."""
        named = rows.select(*self.columns).withColumns({QUERY: F.lit(query), BATCH: F.lit(batch).cast("bigint")})
        overwrite_partitions(named, self.path, [*self.by, QUERY, BATCH])

    def _note(self, spark: SparkSession) -> dict:
        pointer = f"{self.folded}/{files.POINTER}"
        if not files.exists(spark, pointer):
            return {"version": None, "through": {}, "gone": {}}
        return json.loads(files.read_note(spark, pointer))

    def _version(self, spark: SparkSession, note: dict) -> DataFrame:
        if note["version"] is None:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.folded}/{note['version']}").select(*self.columns)

    def _batches(self, spark: SparkSession) -> DataFrame:
        schema = f"{self.schema}, {QUERY} string, {BATCH} bigint"
        if not files.exists(spark, self.path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path)

    @staticmethod
    def _held(through: dict[str, int]):
        """Whether a batch is held; on partition columns, so that held batches are not even listed for reading."""
        held = F.lit(False)
        for query, batch in sorted(through.items()):
            held = held | ((F.col(QUERY) == query) & (F.col(BATCH) <= batch))
        return held

    def read(self, spark: SparkSession) -> DataFrame:
        """The partial rows of all batches so far, each batch once; ``merge`` gives their sum."""
        note = self._note(spark)
        fresh = self._batches(spark).where(~self._held(note["through"])).select(*self.columns)
        return self._version(spark, note).unionByName(fresh)

    def fold(self, spark: SparkSession, through: dict[str, int]) -> None:
        """Merges all batches up to the given one of each query; they must be done, and other queries stay as they are.

        One fold runs at a time. A fold that is cut off leaves the old pointer or the new one; both are whole.
        """
        note = self._note(spark)
        after = note["through"] | {q: max(b, note["through"].get(q, b)) for q, b in through.items()}
        fresh = self._batches(spark).where(self._held(after) & ~self._held(note["through"])).select(*self.columns)
        version = f"v-{uuid.uuid4().hex}"
        merged = self.merge(self._version(spark, note).unionByName(fresh)).select(*self.columns)
        writer = merged.hint("rebalance", *self.by).write.option("compression", "snappy")
        (writer.partitionBy(*self.by) if self.by else writer).parquet(f"{self.folded}/{version}")
        pointer = {"version": version, "through": after, "gone": note["through"]}
        files.write_note(spark, f"{self.folded}/{files.POINTER}", json.dumps(pointer))
        self._sweep(spark, keep={version, note["version"]}, gone=note["through"])

    def _sweep(self, spark: SparkSession, keep: set, gone: dict[str, int]) -> None:
        for name, is_directory in list(files.children(spark, self.folded)):
            if is_directory and name.startswith("v-") and name not in keep:
                files.delete(spark, f"{self.folded}/{name}")
        if not files.exists(spark, self.path):
            return
        folders = [self.path]
        for _ in self.by:
            folders = [f"{f}/{name}" for f in folders for name, is_directory in files.children(spark, f) if is_directory]
        for folder in folders:
            for query, last in gone.items():
                below = f"{folder}/{QUERY}={query}"
                for name, _ in list(files.children(spark, below)):
                    if name.startswith(f"{BATCH}=") and int(name.split("=", 1)[1]) <= last:
                        files.delete(spark, f"{below}/{name}")

"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import expanded, numbered

# Fixed values of the published algorithm: multiplier of its 64-bit congruential generator, and its modulus.
MULTIPLIER = "2862933555777941757"
MODULUS = "18446744073709551616"
# Rounds in the first loop; a key needs about ln(shards) rounds.
_FIRST_ROUNDS = 48


def _number(text: str) -> Column:
    return F.lit(text).cast("decimal(20,0)")


def _rounds(count: Column, state: Column, shards: int) -> Column:
    def jump(at: Column, _: Column) -> Column:
        key = ((at["key"] * _number(MULTIPLIER) + 1) % _number(MODULUS)).cast("decimal(20,0)")
        high = F.call_function("div", key, _number(str(2**33))).cast("double") + 1
        target = F.floor((at["next"] + 1).cast("double") * (F.lit(float(2**31)) / high)).cast("bigint")
        moved = F.struct(key.alias("key"), at["next"].alias("last"), target.alias("next"))
        return F.when(at["next"] < shards, moved).otherwise(at)

    return F.aggregate(count, state, jump)


def jumps(key: Column, shards: int) -> Column:
    """``last``: the shard; ``next``: the shard count (less one) at which the key moves for the first time.

    The key is a signed 64-bit integer read as unsigned. Products stay exact in decimals, as 64-bit
    multiplication would raise under ANSI rules. No ring table is kept, and no more rounds run than the key
    needs: the second loop is empty for a key that has come to rest.
    """
    unsigned = F.when(key < 0, key.cast("decimal(20,0)") + _number(MODULUS)).otherwise(key.cast("decimal(20,0)"))
    start = F.struct(
        unsigned.cast("decimal(20,0)").alias("key"), F.lit(-1).cast("bigint").alias("last"),
        F.lit(0).cast("bigint").alias("next"),
    )
    state = _rounds(F.sequence(F.lit(1), F.lit(min(shards, _FIRST_ROUNDS))), start, shards)
    if shards > _FIRST_ROUNDS:
        left = F.when(state["next"] < shards, F.sequence(F.lit(1), F.lit(shards))).otherwise(F.array().cast("array<int>"))
        state = _rounds(left, state, shards)
    return state


def assign(rows: DataFrame, key: list[str], shards: int) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (the shard once one more is appended) to any table; a projection, no shuffle.

    Null keys are a key like any other. Columns of these names are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    moved = rows.withColumn("_jump", jumps(F.xxhash64(*key), shards))
    shard = F.col("_jump.last").cast("int")
    grown = F.when(F.col("_jump.next") == shards, F.lit(shards)).otherwise(shard)
    return moved.withColumns({"shard": shard, "grown_shard": grown}).drop("_jump")


def with_slots(assigned: DataFrame, key: list[str], buckets: int = 4096) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in ``slot``; equal rows get different slots.

    Takes few, short columns (key, sizes, digests), not whole texts. ``buckets`` bounds what a task holds to a
    shard's rows divided by it.
    """
    return expanded(numbered(assigned, ["shard"], key, buckets), "slot")


def write_shards(rows: DataFrame, path: str, key: list[str], shards: int) -> None:
    """Writes whole rows below ``shard=N`` folders; large shards are split over tasks and files."""
    assign(rows, key, shards).drop("grown_shard").hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Digest of the sharding of documents, one row per document.

    Null text: no bytes (size 1, checksum 0). Empty table: no rows. Repeated rows are separate documents of the
    same shard. Other columns of the table are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    short = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_slots(assign(short, ["doc_id"], shards), ["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )

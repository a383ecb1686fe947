"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes a set of shingle hashes; texts with equal sets are one class and go on as one row.
2. A class keeps the k least hashes (its sketch). Two sets of Jaccard similarity t share at least ``floor`` values of
   their sketches, but for a probability below 1e-9, so of the sketch's values in order of corpus frequency each must
   hold one of the other's among its rarest ``len - floor + 1``. Only those go into inverted lists, so values that
   many texts share stay out of the lists of all texts but those that consist of them.
3. First, each list offers a few of its members as hubs to all others. Where the members are copies of each other this
   leaves one component, at a cost linear in the list.
4. Lists that still join two components are finished by blocks: classes with the same longest list form blocks of
   bounded size, and each two blocks that meet in a list are compared once, as a whole, but for pairs of one component.
   Sets go to block pairs, not to pairs, and only links come back, so a large group of texts that are similar, but not
   similar enough, makes no row per pair. No pair that could join two components stays untested.
5. The union of two sketches gives an estimate that filters hub pairs; the full sets decide everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, null_safe_join, save
from .components import components

SKETCH = 64
HUBS = 8
PAIRS = 4000  # hub pairs that a task compares at once
BLOCK = 256  # classes of a block
APART = 64  # a component of this size has blocks of its own
_COLUMNS = 16_384  # of a comparison at once
MISS = 1e-9
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; one for the whole sequence where it is shorter."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64).view(np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - width + 1
    mixed = hashes[:count].copy()
    for i in range(1, width):
        mixed = mixed * _MULTIPLIER + hashes[i : count + i]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[0]
    mixed = (mixed ^ (mixed >> np.uint64(27))) * _MIX[1]
    return np.unique((mixed ^ (mixed >> np.uint64(31))).view(np.int64))


def overlap_floor(size: int, num: int, den: int, miss: float = MISS) -> int:
    """The most values that two sketches of this size share but for a probability below ``miss``."""
    t = num / den
    below, floor = 0.0, 0
    for i in range(size):
        below += math.comb(size, i) * t**i * (1 - t) ** (size - i)
        if below >= miss:
            break
        floor = i + 1
    return max(floor, 1)


def _sketched(docs: DataFrame, keys: list[str], width: int, size: int) -> DataFrame:
    """``keys``, ``fp`` (128-bit digest of the set, null for an empty one), ``n`` (set size), ``sketch``."""
    import xxhash

    bound_batches(docs.sparkSession)
    rows = docs.select(*keys, F.col("text").cast("binary").alias("_raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, counts, sketches = [], [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                found = shingle_set(raw or b"", width)
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                counts.append(len(found))
                sketches.append(found[:size])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(sketches, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "fp", "n", "sketch"],
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{types}, fp binary, n long, sketch array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``fp, full``: the whole sets of the classes wanted (``keys`` of one of their rows, ``fp``)."""
    texts = null_safe_join(docs.select(*keys, F.col("text").cast("binary").alias("_raw")), wanted, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw or b"", width).tobytes() for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], names=["fp", "full"])

    return texts.select("_raw", "fp").mapInArrow(run, "fp binary, full binary").dropDuplicates(["fp"])


def _similar(x: np.ndarray, y: np.ndarray, size: int, floor: int, num: int, den: int) -> bool:
    """Whether two sets are similar enough; the union of their sketches is looked at first."""
    union = np.union1d(x[:size], y[:size])[:size]
    if len(union) == size:
        shared = np.isin(union, x[:size], assume_unique=True) & np.isin(union, y[:size], assume_unique=True)
        if shared.sum() < floor:
            return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, sets: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` (a stored table) that are similar, about ``PAIRS`` of them at once."""
    blocks = max(1, round(math.sqrt(2 * pairs.count() / PAIRS)))
    floor = overlap_floor(size, num, den)
    block = lambda name: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    dealt = pairs.select(block("a").alias("i"), block("b").alias("j"), "a", "b")
    ends = dealt.select("i", "j", F.col("a").alias("fp")).union(dealt.select("i", "j", F.col("b").alias("fp"))).distinct()
    needed = ends.toDF("p", "q", "fp").join(sets, "fp")

    def decide(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        full = {name: np.frombuffer(raw, np.int64) for name, raw in zip(held["fp"], held["full"])}
        chosen = [_similar(full[a], full[b], size, floor, num, den) for a, b in zip(asked["a"], asked["b"])]
        return asked.loc[chosen, ["a", "b"]]

    both = dealt.groupBy("i", "j").cogroup(needed.groupBy("p", "q"))
    return both.applyInPandas(decide, "a binary, b binary")


def _lists(classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Inverted lists: ``value, fp, n`` for the rarest values of each sketch, of those that two classes share."""
    postings = classes.select("fp", F.explode("sketch").alias("value"))
    # Stored, so that the join below has an exchange of its own on both sides, which adaptive execution can split.
    counts = save(postings.groupBy("value").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "counts")
    shared = postings.join(counts, "value")
    ordered = shared.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("classes", "value"))).alias("_shared"))
    kept = F.least(F.col("n"), F.lit(size))
    # Sets this small have partners whose sketches are whole sets: the exact floor holds.
    floor = F.when(F.col("n") * den <= size * num, F.ceil(F.col("n") * num / den)).otherwise(
        F.lit(overlap_floor(size, num, den))
    )
    joined = ordered.join(classes.select("fp", "n"), "fp")
    rarest = F.greatest(kept - floor + 1 - (kept - F.size("_shared")), F.lit(0)).cast("int")
    return joined.select("fp", "n", F.explode(F.slice("_shared", F.lit(1), rarest)["value"]).alias("value"))


def _candidates(members: DataFrame, hubs: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that the hubs of each list make with its members; one hub for each slot of a hash."""
    first = F.min(F.struct(F.xxhash64("fp"), "fp", "n")).alias("_hub")
    chosen = members.groupBy("value", F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(hubs)).alias("_slot")).agg(first)
    chosen = chosen.select("value", F.col("_hub.fp").alias("hub"), F.col("_hub.n").alias("hub_n"))
    near = (F.col("n") * den >= F.col("hub_n") * num) & (F.col("hub_n") * den >= F.col("n") * num)
    met = members.join(chosen, "value").where((F.col("fp") != F.col("hub")) & near)
    return met.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components that the verified links ``a, b`` connect."""
    between = links.join(labels.toDF("a", "_ca"), "a").join(labels.toDF("b", "_cb"), "b")
    roots = components(between.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")))
    moved = labels.join(roots.toDF("comp", "_root"), "comp", "left")
    return save(moved.select("fp", F.coalesce("_root", "comp").alias("comp")), "labels")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    found = np.zeros((len(left), len(right)), np.float32)
    values, counts = np.unique(np.concatenate([*left, *right]), return_counts=True)
    values = values[counts > 1]
    for start in range(0, len(values), _COLUMNS):
        part = values[start : start + _COLUMNS]
        sides = []
        for sets in (left, right):
            holds = np.zeros((len(sets), len(part)), np.float32)
            for row, full in enumerate(sets):
                inside = full[np.searchsorted(full, part[0]) : np.searchsorted(full, part[-1], "right")]
                at = np.searchsorted(part, inside)
                holds[row, at[part[at] == inside]] = 1
            sides.append(holds)
        found += sides[0] @ sides[1].T
    return found


def _compared(lists: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``a, b`` between components, of all pairs that meet in one of the lists."""
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("_size"))
    apart = F.when(F.col("_size") >= APART, F.col("comp"))
    longest = save(lists.groupBy("value").agg(F.count(F.lit(1)).alias("_m")), "lengths")
    nodes = lists.join(longest, "value").groupBy("fp").agg(F.max(F.struct("_m", "value")).alias("_long"))
    nodes = nodes.join(labels, "fp").join(sizes, "comp")
    nodes = nodes.select("fp", "comp", apart.alias("apart"), F.col("_long.value").alias("_key"))
    counts = nodes.groupBy("apart", "_key").agg(F.count(F.lit(1)).alias("_n"))
    placed = null_safe_join(nodes, counts, ["apart", "_key"])
    salt = F.pmod(F.xxhash64("fp", F.lit(3)), F.ceil(F.col("_n") / BLOCK))
    placed = save(placed.select("fp", "comp", "apart", F.xxhash64("apart", "_key", salt).alias("block")), "blocks")
    met = lists.select("fp", "value").join(placed, "fp").select("value", "block", "apart").distinct()
    other = met.toDF("value", "block2", "apart2")
    joins = (F.col("block") <= F.col("block2")) & ~F.coalesce(F.col("apart") == F.col("apart2"), F.lit(False))
    pairs = save(met.join(other, "value").where(joins).select("block", "block2").distinct(), "block-pairs")
    held = placed.join(sets, "fp").select("block", "fp", "comp", "full")
    first = pairs.join(held, "block").select("block", "block2", "fp", "comp", "full")
    second = pairs.where("block <> block2").join(held.withColumnRenamed("block", "block2"), "block2")
    second = second.select("block", "block2", "fp", "comp", "full").toDF("p", "q", "fp2", "comp2", "full2")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = left if right.empty else right.set_axis(left.columns, axis=1)
        x, y = ([np.frombuffer(raw, np.int64) for raw in side["full"]] for side in (left, right))
        common = _common(x, y)
        whole = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None]
        alike = den * common.astype(np.int64) >= num * (whole - common.astype(np.int64))
        alike &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None]
        at, to = np.nonzero(alike)
        return pd.DataFrame({"a": left["fp"].to_numpy()[at], "b": right["fp"].to_numpy()[to]}, dtype=object)

    both = first.groupBy("block", "block2").cogroup(second.groupBy("p", "q"))
    return both.applyInPandas(compare, "a binary, b binary")


def link_classes(docs: DataFrame, classes: DataFrame, keys: list[str], width: int, num: int, den: int,
                 size: int = SKETCH, hubs: int = HUBS) -> DataFrame:
    """``fp, comp`` for every class that shares an inverted list; other classes are linked with nothing."""
    lists = save(_lists(classes, size, num, den), "lists")
    several = save(lists.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value"), "several")
    members = save(lists.join(several, "value"), "members")
    names = save(members.select("fp").distinct(), "names")
    labels = names.select("fp", F.col("fp").alias("comp"))
    if names.isEmpty():
        return labels
    sets = save(_full_sets(docs, classes.select(*keys, "fp").join(names, "fp"), keys, width), "sets")
    pairs = save(_candidates(members, hubs, num, den), "pairs")
    links = save(_verified(pairs, sets, size, num, den), "verified")
    if not links.isEmpty():
        labels = _relabelled(labels, links)
    marked = members.join(labels, "fp")
    live = marked.groupBy("value").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high")
    rest = save(members.select("fp", "value").join(live.select("value"), "value"), "rest")
    if rest.isEmpty():
        return labels
    links = save(_compared(rest, labels, sets, num, den), "verified")
    return labels if links.isEmpty() else _relabelled(labels, links)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, size: int = SKETCH,
                    hubs: int = HUBS) -> DataFrame:
    """``doc_id, __llm_hash`` (of the text), ``n`` (set size), ``component_id`` and ``first`` for every row.

    Texts are lower-cased (A-Z) and cut at ASCII white space; sets hold ``width``-word shingles, and are linked where
    den * shared >= num * union. ``component_id`` is the least doc_id of the component, null last; ``first`` marks the
    rows of its least doc_id and, among several texts of that id, of one of them. Null, empty and blank texts have an
    empty set and stay alone, each ``first``. Repeated rows fall into one class. Only doc_id and text are read.
    """
    keys = ["doc_id", "__llm_hash"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__llm_hash"))
    rows = save(_sketched(keyed, keys, width, size), "sketches")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__llm_hash")).alias("low")
    filled = rows.where(F.col("fp").isNotNull())
    classes = filled.groupBy("fp").agg(low, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = save(classes.select("fp", "n", "sketch", "low", "low.doc_id", "low.__llm_hash"), "classes")
    labels = link_classes(keyed, classes, keys, width, num, den, size, hubs)
    placed = classes.select("fp", "low").join(labels, "fp", "left").select("fp", "low", F.coalesce("comp", "fp").alias("comp"))
    placed = save(placed, "placed")
    least = placed.groupBy("comp").agg(F.min(F.struct("low.none", "low.doc_id", "low.__llm_hash", "fp")).alias("least"))
    final = placed.join(least, "comp").select("fp", "least")
    judged = rows.select(*keys, "n", "fp").join(final.toDF("fp", "least"), "fp", "left")
    alone = F.col("fp").isNull()
    own = F.col("least.fp").eqNullSafe(F.col("fp")) & F.col("least.doc_id").eqNullSafe(F.col("doc_id"))
    return judged.select(
        *keys, "n", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (alone | own).alias("first"),
    )


def mark_documents(docs: DataFrame) -> DataFrame:
    """Components of documents by the data contract: 3-word shingles, similarity of 0.85 or more."""
    found = near_duplicates(docs, width=3, num=85, den=100)
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def keep_first(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of near duplicates, with all columns; documents without words stay.

    Of repeated rows (equal id and text) one stays, also of those without words.
    """
    found = near_duplicates(docs, width, num, den)
    dropped = found.where(~F.col("first")).select("doc_id", "__llm_hash").distinct()
    single = docs.withColumn("__llm_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__llm_hash"])
    return null_safe_join(single, dropped, ["doc_id", "__llm_hash"], "left_anti").drop("__llm_hash")

"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Graph: equal vectors become one node. Blocks of vectors on the same side of random hyperplanes give every node its
first neighbours; NN-descent rounds then join each node's neighbours (both ways) with each other and keep what is
nearer. Search: a query starts at the pivots nearest to it and, if it is a node itself, at its own neighbours, and
in each hop looks at the neighbours of the nearest nodes not yet opened, until the ``beam`` nearest nodes known are all open.
Vectors stay in buckets of bounded size; candidates travel to them as ids, so no vector is sent once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, save


@dataclass(frozen=True)
class Settings:
    """degree: neighbours kept per node; block: vectors compared with each other at the start, trees: how often;
    settled: NN-descent ends with the round that changes at most this share of all neighbours, ``local`` own and as many
    reverse neighbours of a node are joined in a round, with ``offers`` results each;
    beam: nodes a query keeps; opened: of these, in one hop; pivots: entry points, a bounded sample by hash;
    bucket: vectors held by one task of a search."""

    degree: int = 32
    block: int = 1024
    trees: int = 6
    settled: float = 0.1
    local: int = 16
    offers: int = 6
    beam: int = 384
    opened: int = 96
    pivots: int = 256
    entries: int = 16
    bucket: int = 4096
    seed: int = 11


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec`` of the vectors that take part, as double arrays.

    Null, empty and zero vectors and those with null or non-finite components don't; nor do null ids, nor vectors of
    another length than the most common one (the shorter on a tie).
    """
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0.0))
    lengths = rows.groupBy(F.size("vec").alias("_length")).agg(F.count(F.lit(1)).alias("_n"))
    most = lengths.orderBy(F.desc("_n"), "_length").first()
    return rows.where(F.size("vec") == (most[0] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column of arrays as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def _nothing(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([], dtype=object) for name in columns})


def _planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, count))


def _first_neighbours(nodes: DataFrame, count: int, dim: int, mean: np.ndarray, s: Settings) -> DataFrame:
    """``node, near, dist``: each node's nearest in its block of every tree, as arrays."""
    depth = max(0, round(np.log2(max(count, 1) / s.block)))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [_planes(dim, depth, s.seed + t) for t in range(s.trees)]
        for batch in batches:
            x = _matrix(batch.column(1)) - mean
            for tree, sides in enumerate(planes):
                code = ((x @ sides) > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)), pa.array(code, pa.int64()), *batch.columns],
                    names=["tree", "leaf", "node", "vec"],
                )

    kept = nodes.select("node", "vec")
    placed = save(kept.mapInArrow(leaves, "tree int, leaf long, node long, vec array<double>"), "leaves")
    # A leaf that many vectors fall into is cut by a hash into blocks of about the same size.
    sizes = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("_n"))
    blocks = sizes.select("tree", "leaf", F.greatest(F.lit(1), F.round(F.col("_n") / s.block)).cast("long").alias("_blocks"))
    placed = placed.join(blocks, ["tree", "leaf"])
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("node", "tree"), "_blocks"))

    def nearest(block: pd.DataFrame) -> pd.DataFrame:
        ids = block["node"].to_numpy()
        x = np.stack(block["vec"].to_numpy())
        k = min(s.degree, len(ids) - 1)
        if k < 1:
            return _nothing("node", "near", "dist")
        distances = _square_distances(x, x)
        np.fill_diagonal(distances, np.inf)
        order = np.argpartition(distances, k - 1, axis=1)[:, :k]
        return pd.DataFrame({
            "node": ids, "near": list(ids[order]), "dist": list(np.take_along_axis(distances, order, 1)),
        })

    return placed.groupBy("tree", "leaf", "_block").applyInPandas(nearest, "node long, near array<long>, dist array<double>")


def _merged(offers: DataFrame, degree: int) -> DataFrame:
    """The nearest distinct neighbours of each node from rows of arrays: a bounded number of rows per node."""
    pairs = F.arrays_zip(F.col("dist"), F.col("near"))
    joined = offers.groupBy("node").agg(F.flatten(F.collect_list(pairs)).alias("_all"))
    nearest = F.slice(F.sort_array(F.array_distinct("_all")), 1, degree)
    return joined.withColumn("_all", nearest).select("node", F.col("_all.near").alias("near"), F.col("_all.dist").alias("dist"))


def _edges(graph: DataFrame, own: int, back: int) -> DataFrame:
    """``node, other``: the nearest ``own`` neighbours and the ``back`` nearest nodes that name the node."""
    named = graph.select("node", F.posexplode(F.arrays_zip("near", "dist")).alias("at", "_e"))
    forward = named.where(F.col("at") < own).select("node", F.col("_e.near").alias("other"), F.col("_e.dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("dist", "other"))
    reverse = forward.select(F.col("other").alias("node"), F.col("node").alias("other"), "dist")
    reverse = reverse.withColumn("_rank", rank).where(F.col("_rank") <= back)
    return forward.select("node", "other").union(reverse.select("node", "other")).distinct()


def _descended(graph: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """One round of NN-descent: neighbours of a node are offered to each other."""
    bound = graph.select(F.col("node").alias("other"), F.element_at("dist", -1).alias("_worst"), F.size("near").alias("_known"))
    known = nodes.select(F.col("node").alias("other"), F.col("vec").cast("array<float>").alias("vec")).join(bound, "other")
    gathered = _edges(graph, s.local, s.local).join(known, "other")
    groups = gathered.groupBy("node").agg(F.collect_list(F.struct("other", "_worst", "_known", "vec")).alias("_g"))
    groups = groups.select(*(F.col(f"_g.{c}").alias(c) for c in ("other", "_worst", "_known")), F.flatten("_g.vec").alias("vecs"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, near, dist = [], [], []
            for ids, worst, size, flat in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, worst = np.asarray(ids.values), np.asarray(worst.values)
                full = np.asarray(size.values) >= s.degree
                k = min(s.offers, len(ids) - 1)
                if k < 1:
                    continue
                x = np.asarray(flat.values).reshape(len(ids), -1).astype(np.float64)
                distances = _square_distances(x, x)
                np.fill_diagonal(distances, np.inf)
                order = np.argpartition(distances, k - 1, axis=1)[:, :k]
                values = np.take_along_axis(distances, order, 1)
                better = (values < worst[:, None]) | ~full[:, None]
                for i in np.flatnonzero(better.any(1)):
                    found.append(ids[i])
                    near.append(ids[order[i][better[i]]])
                    dist.append(values[i][better[i]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(dist, pa.list_(pa.float64()))],
                names=["node", "near", "dist"],
            )

    offers = groups.mapInArrow(join, "node long, near array<long>, dist array<double>")
    # Single precision would make equal neighbours differ; one distance per neighbour is kept.
    both = graph.select("node", "near", "dist").unionByName(offers)
    flat = both.select("node", F.explode(F.arrays_zip("near", "dist")).alias("_e"))
    one = flat.groupBy("node", F.col("_e.near").alias("near")).agg(F.min("_e.dist").alias("dist"))
    joined = one.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "near"))), 1, s.degree).alias("_all"))
    return joined.select("node", F.col("_all.near").alias("near"), F.col("_all.dist").alias("dist"))


def _changed(before: DataFrame, after: DataFrame) -> float:
    """Share of all neighbours that a round has brought in."""
    old = before.select("node", F.col("near").alias("_old"))
    new = F.size(F.array_except("near", F.coalesce("_old", F.array().cast("array<long>"))))
    counted = after.join(old, "node", "left").agg(F.sum(new).alias("new"), F.sum(F.size("near")).alias("all")).first()
    return counted["new"] / counted["all"] if counted["all"] else 0.0


@dataclass(frozen=True)
class Index:
    """nodes: ``node, vec, bucket``; graph: ``node, links`` (both ways, bounded); pivots: at most a fixed number."""

    nodes: DataFrame
    graph: DataFrame
    pivot_ids: np.ndarray
    pivot_vectors: np.ndarray
    buckets: int


def build_index(vectors: DataFrame, s: Settings = Settings()) -> Index:
    """Builds the graph over distinct vectors ``node, vec``; every node is in it."""
    count = vectors.count()
    buckets = max(1, -(-count // s.bucket))
    nodes = save(vectors.select("node", "vec", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int").alias("bucket")), "nodes")
    # A fixed number of pivots: those of least hash.
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(s.seed)), "node").limit(s.pivots).select("node", "vec").collect()
    ids = np.array([row[0] for row in chosen], np.int64)
    points = np.array([row[1] for row in chosen], np.float64).reshape(len(chosen), len(chosen[0][1]) if chosen else 0)
    mean = points.mean(0) if len(points) else np.zeros(0)
    graph = save(_merged(_first_neighbours(nodes, count, points.shape[1], mean, s), s.degree), "graph")
    changed = 1.0
    while changed > s.settled:  # ends: lists only get nearer
        before, graph = graph, save(_descended(graph, nodes, s), "graph")
        changed = _changed(before, graph)
    edges = _edges(graph, s.degree, s.degree)
    links = save(edges.groupBy("node").agg(F.collect_list("other").alias("links")), "links")
    return Index(nodes, links, ids, points, buckets)


_STATE = "query long, vec array<double>, ids array<long>, dist array<double>, open array<boolean>, seen array<long>, next array<long>"


def _entered(queries: DataFrame, index: Index, s: Settings) -> DataFrame:
    """The state before the first hop: nearest pivots, and the query's own node to open where it has one."""
    ids, points = index.pivot_ids, index.pivot_vectors

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            rows = []
            distances = _square_distances(x, points) if len(x) else np.empty((0, 0))
            for query, own, vec, near in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), x, distances):
                order = np.lexsort((ids, near))[: s.entries]
                mine = [] if own is None else [own]
                rows.append((query, vec.tolist(), [], [], [], [], list(dict.fromkeys([*mine, *ids[order].tolist()]))))
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=["query", "vec", "ids", "dist", "open", "seen", "next"]), schema=_schema(), preserve_index=False
            )

    return queries.select("query", "vec", "own").mapInArrow(enter, _STATE)


def _schema() -> pa.Schema:
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()),
             pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.schema(list(zip(["query", "vec", "ids", "dist", "open", "seen", "next"], kinds)))


def _measured(state: DataFrame, index: Index) -> DataFrame:
    """``query, ids, dist`` for the nodes in ``next``, by bucket: a query's vector goes to a bucket once."""
    wanted = state.select("query", "vec", F.explode("next").alias("node"))
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(index.buckets)).cast("int"))
    wanted = wanted.groupBy("bucket", "query").agg(F.first("vec").alias("vec"), F.collect_list("node").alias("want"))

    def measure(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return _nothing("query", "ids", "dist")
        order = np.argsort(held["node"].to_numpy())
        names, points = held["node"].to_numpy()[order], np.stack(held["vec"].to_numpy()[order])
        ids, distances = [], []
        for vec, want in zip(asked["vec"], asked["want"]):
            want = np.unique(np.asarray(want))
            at = np.minimum(np.searchsorted(names, want), len(names) - 1)
            at = at[names[at] == want]
            ids.append(names[at])
            distances.append(np.sqrt(((points[at] - np.asarray(vec)) ** 2).sum(1)))
        return pd.DataFrame({"query": asked["query"].to_numpy(), "ids": ids, "dist": distances})

    both = wanted.groupBy("bucket").cogroup(index.nodes.groupBy("bucket"))
    return both.applyInPandas(measure, "query long, ids array<long>, dist array<double>")


def _hopped(state: DataFrame, index: Index, s: Settings) -> DataFrame:
    """One hop: measure what is next, keep the beam, open its nearest nodes and ask for their links."""
    found = _measured(state, index).groupBy("query").agg(
        F.flatten(F.collect_list("ids")).alias("_ids"), F.flatten(F.collect_list("dist")).alias("_dist")
    )
    joined = state.drop("next").join(found, "query", "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, vec, ids, dist, opened, seen, new, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array(ids + (new or []), np.int64)
                dist = np.array(dist + (far or []), np.float64)
                opened = np.array(opened + [False] * len(new or []), bool)
                order = np.lexsort((ids, dist))[: s.beam]
                ids, dist, opened = ids[order], dist[order], opened[order]
                turn = np.flatnonzero(~opened)[: s.opened]
                opened[turn] = True
                rows.append((query, vec, ids, dist, opened, seen + (new or []), ids[turn]))
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=["query", "vec", "ids", "dist", "open", "seen", "next"]), schema=_schema(), preserve_index=False
            )

    kept = save(joined.select("query", "vec", "ids", "dist", "open", "seen", "_ids", "_dist").mapInArrow(keep, _STATE), "beam")
    asked = kept.select("query", F.explode("next").alias("node"))
    linked = asked.join(index.graph, "node").select("query", F.explode("links").alias("node"))
    links = linked.groupBy("query").agg(F.collect_set("node").alias("_links"))
    moved = kept.drop("next").join(links, "query", "left")
    fresh = F.array_except(F.coalesce("_links", F.array().cast("array<long>")), "seen")
    return save(moved.withColumn("next", fresh).drop("_links"), "beam")


def search(queries: DataFrame, index: Index, s: Settings = Settings()) -> DataFrame:
    """``query, ids, dist``: the nodes found nearest, nearest first, up to the beam.

    ``queries``: query, vec, own (the query's own node, or null). A query is done once all nodes of its beam have
    been opened; the search ends when all are.
    """
    bound_batches(queries.sparkSession)
    state = save(_entered(queries, index, s), "beam")
    finished = []
    while True:
        active = state.where(F.size("next") > 0)
        finished.append(state.where(F.size("next") == 0).select("query", "ids", "dist"))
        if active.isEmpty():
            break
        state = _hopped(active, index, s)
    done = finished[0]
    for part in finished[1:]:
        done = done.unionByName(part)
    return done


def nearest(table: DataFrame, key: str, vector: str, is_query, k: int = 10, s: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row chosen by ``is_query``, the k nearest other rows found.

    ``score`` is the Euclidean distance of the original vectors in double precision. Rows with equal vectors share a
    node, and of each node only its k + 1 smallest ids can be among a query's k nearest, so only those are kept. Ties go
    to the smaller id, within the beam too.
    A repeated id counts once per distinct vector. No valid vector, or no query: no rows.
    """
    rows = valid_vectors(table, key, vector).select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))
    rows = save(rows.distinct(), "vectors")
    nodes = rows.groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # A node is named by its least id, so that ties by name are ties by id; further vectors of a repeated id by a hash.
    again = F.row_number().over(Window.partitionBy("least").orderBy(F.xxhash64("vec"))) > 1
    name = F.when(again, F.xxhash64("vec", "least")).otherwise(F.col("least"))
    nodes = save(nodes.select("vec", "least", "copies", name.alias("node")), "distinct")
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    extra = rows.join(nodes.where("copies > 1").select("vec", "node"), "vec")
    extra = extra.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).select("node", "id")
    members = nodes.where("copies = 1").select("node", F.col("least").alias("id")).union(extra)
    members = save(members, "members")
    index = build_index(nodes.select("node", "vec"), s)
    asked = rows.where(is_query(F.col("id"))).join(nodes.select("vec", "node"), "vec")
    asked = save(asked.select(F.xxhash64("id", "node").alias("query"), "id", "vec", F.col("node").alias("own")), "queries")
    found = search(asked.select("query", "vec", "own"), index, s)
    pairs = found.select("query", F.explode(F.arrays_zip(F.slice("ids", 1, k + 1).alias("ids"), F.slice("dist", 1, k + 1).alias("dist"))).alias("_f"))
    pairs = pairs.select("query", F.col("_f.ids").alias("node"), F.col("_f.dist").alias("score"))
    named = pairs.join(members, "node").join(asked.select("query", F.col("id").alias("query_id")), "query")
    named = named.where("id <> query_id")
    order = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return named.withColumn("rank", order).where(F.col("rank") <= k).select(
        F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"
    )


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100."""
    return nearest(embeddings, "vec_id", "embedding", lambda i: i % 100 == 0)

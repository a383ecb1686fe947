"""Mixing sources to target weights by entropy balancing.

Document rates r stay as near as they can to 1 in relative entropy while each source's words meet its target:
minimise the sum of r log r - r subject to, per source, the sum of r * size = target and 0 <= r <= cap. The convex dual has one
multiplier per source, and its solution tilts rates exponentially: r = min(cap, exp(multiplier * size / mean size)).
Newton iterations, kept inside a shrinking bracket, solve all sources at once: each is one grouped aggregate over the
histogram of sizes. Rates are then rounded into whole copies so that errors cancel within a source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, expanded, hashable, null_safe_join, numbered, save

# Fixed values of the data contract.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
TOLERANCE = 1e-9
MAX_ROUNDS = 60
BUCKETS = 1024


def word_count(text: str = "text"):
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """``source, source_size, n_docs, target`` from a histogram ``source, size, n``.

    Weights go to the sources in code point order, null last, and repeat. The budget is a share of all words. Targets
    are proportional to weight up to ``cap`` times the source's size; what a capped source cannot take goes to the
    others by weight. The windows run over one row per source, which the aggregate before them has made.
    """
    totals = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    ranked = totals.withColumn("_rank", F.row_number().over(by_name)).withColumns({
        "_w": F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1),
        "_most": F.col("source_size").cast("double") * cap,
    }).withColumn("_ratio", F.col("_most") / F.col("_w"))
    # Sources fill up in the order of cap by weight; the first that doesn't sets the level for the rest.
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", "_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levelled = ranked.withColumn(
        "_level", (F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        / F.sum("_w").over(after),
    )
    open_level = F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_rank", "_level"))
    levelled = levelled.withColumn("_open", F.min(open_level).over(every)["_level"])
    target = F.when(F.col("_open").isNull() | (F.col("_ratio") <= F.col("_open")), F.col("_most"))
    return levelled.select(
        "source", "source_size", "n_docs", "least", target.otherwise(F.col("_w") * F.col("_open")).alias("target")
    )


def _tilt(cap: int):
    """Rate and whether it is below the cap; ``z``: size by mean size of the source."""
    power = F.col("multiplier") * F.col("size") / F.col("mean")
    free = power < math.log(cap)
    return F.when(free, F.exp(power)).otherwise(F.lit(float(cap))), free


def solve_dual(sizes: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE,
               max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Adds ``mean`` and ``multiplier`` to the targets.

    Sources without words, with target 0 or with all of the cap need no search (multiplier 0, or beyond every
    size). State passes from round to round through written tables, one row per source.
    """
    mean = F.col("source_size") / F.col("n_docs")
    most = F.lit(math.log(cap)) * mean / F.col("least")
    full = F.col("target") >= F.col("source_size") * float(cap)
    fixed = (F.col("source_size") == 0) | (F.col("target") <= 0) | full
    state = targets.withColumns({
        "mean": F.when(F.col("source_size") > 0, mean).otherwise(F.lit(1.0)),
        "low": F.when(fixed, F.lit(0.0)).otherwise(-F.col("source_size") / (math.e * F.col("target"))),
        "high": F.when(fixed, F.lit(0.0)).otherwise(most),
        "done": fixed,
        "multiplier": F.when(F.col("source_size") == 0, F.lit(0.0))
        .when(full, most * 2).when(F.col("target") <= 0, F.lit(-math.inf)).otherwise(F.lit(0.0)),
    })
    state = save(state, "dual")
    columns = state.columns
    for _ in range(max_rounds):
        if state.where(~F.col("done")).isEmpty():
            break
        rate, free = _tilt(cap)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(free, words * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        cells = null_safe_join(sizes, state.where(~F.col("done")).select("source", "multiplier", "mean"), ["source"])
        sums = cells.groupBy("source").agg(F.sum(words).alias("_words"), F.sum(slope).alias("_slope"))
        off = F.col("_words") - F.col("target")
        moved = null_safe_join(state, sums, ["source"], "left").withColumns({
            "low": F.when(off < 0, F.greatest("low", "multiplier")).otherwise(F.col("low")),
            "high": F.when(off > 0, F.least("high", "multiplier")).otherwise(F.col("high")),
            "_next": F.col("multiplier") - off / F.when(F.col("_slope") > 0, F.col("_slope")),
        })
        near = F.abs(off) <= F.col("target") * tolerance
        shut = (F.col("high") - F.col("low")) <= F.abs(F.col("high")) * 1e-15
        inside = (F.col("_next") > F.col("low")) & (F.col("_next") < F.col("high"))
        chosen = F.when(inside, F.col("_next")).otherwise((F.col("low") + F.col("high")) / 2)
        still = F.col("done") | near | shut
        moved = moved.withColumns({
            "multiplier": F.when(still, F.col("multiplier")).otherwise(chosen), "done": still,
        })
        state = save(moved.select(*columns), "dual")
    return state.drop("low", "high", "done")


def cell_copies(sizes: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds ``takes`` to the histogram: how often all documents of a source and size are taken together.

    Sizes of a source are taken from the largest down, and what rounding leaves is carried on, so that a source
    misses its target by about its smallest size. A source's cells come together, one short row for each distinct
    size: at most as many as the words of its longest text, however many documents it has.
    """

    def carry(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, kind="stable")
        with np.errstate(over="ignore", invalid="ignore"):
            power = (cells["multiplier"] * cells["size"] / cells["mean"]).to_numpy()
        rates = np.where(cells["size"].to_numpy() == 0, 1.0, np.exp(np.minimum(power, math.log(cap))))
        left, takes = 0.0, []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), rates.tolist()):
            if size == 0:
                takes.append(n)
                continue
            wanted = left + rate * size * n
            taken = min(max(math.floor(wanted / size + 0.5), 0), cap * n)
            left = wanted - taken * size
            takes.append(taken)
        return cells.assign(takes=takes)[["source", "size", "n", "takes"]]

    cells = null_safe_join(sizes, solved.select("source", "multiplier", "mean"), ["source"])
    return cells.groupBy("source").applyInPandas(carry, "source string, size long, n long, takes long")


def mix(rows: DataFrame, key: list[str], weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """Decides how often each row is taken; rows: the key columns, ``source`` (string) and ``size`` (words).

    Returns a row for each distinct row: its columns, ``copies`` (how often the row occurs), ``takes`` (how often these
    are taken together), ``start`` and ``cell_n``, ``cell_takes`` (see ``taken_by_row``), ``source_size`` and
    ``target``. Documents of equal source and size share one rate; which of them are taken once more follows a hash
    of the key, so reruns agree. Rows without words are taken once.
    """
    rows = rows.select(*key, "source", "size")
    placed = numbered(rows, ["source", "size"], key, BUCKETS)
    sizes = save(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = save(source_targets(sizes, weights, budget, cap), "targets")
    solved = solve_dual(sizes, targets, cap)
    cells = cell_copies(sizes, solved, cap).withColumnsRenamed({"n": "cell_n", "takes": "cell_takes"})
    cells = save(null_safe_join(cells, targets.select("source", "source_size", "target"), ["source"]), "cells")
    joined = null_safe_join(placed, cells, ["source", "size"])
    takes = _spread(F.col("start") + F.col("copies")) - _spread(F.col("start"))
    return joined.withColumn("takes", takes.cast("bigint"))


def _spread(position):
    """Takes among the first ``position`` rows of a cell; exact, as products may pass 64 bits."""
    product = position.cast("decimal(19,0)") * F.col("cell_takes").cast("decimal(19,0)")
    return F.call_function("div", product, F.greatest(F.col("cell_n"), F.lit(1)).cast("decimal(19,0)"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document, one row each.

    Null text has no words; null source is a source. Repeated rows are separate documents. An empty table, or one
    without a word, has no targets above 0. Only doc_id, source and text are read.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"))
    mixed = expanded(mix(rows, ["doc_id"]), "_at")
    taken = (_spread(F.col("_at") + 1) - _spread(F.col("_at"))).cast("bigint") * F.col("size")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def take_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: documents with all their columns, each as often as it is taken.

    Rows that are equal in all columns (maps aside) are taken together, as copies of one of them.
    """
    marked = docs.withColumns({"__llm_size": word_count(), "__llm_hash": F.xxhash64(*hashable(docs))})
    rows = marked.select("doc_id", F.col("source").cast("string").alias("source"), F.col("__llm_size").alias("size"), "__llm_hash")
    takes = mix(rows, ["doc_id", "__llm_hash"]).groupBy("doc_id", "__llm_hash").agg(F.sum("takes").alias("__llm_takes"))
    single = marked.dropDuplicates(["doc_id", "__llm_hash"])
    taken = null_safe_join(single, takes.where("__llm_takes > 0"), ["doc_id", "__llm_hash"])
    times = F.sequence(F.lit(1).cast("bigint"), F.col("__llm_takes"))
    return taken.withColumn("__llm_copy", F.explode(times)).select(*docs.columns)

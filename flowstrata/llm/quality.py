"""Quality rules: base counts of each text, then robust multivariate outliers per language and source.

A minimum-covariance-determinant (MCD) estimate of centre and scatter is made for all groups at once by concentration
steps: every step finds, per group, the h nearest share of rows by Mahalanobis distance and takes their mean and
covariance. Steps are grouped aggregates over the whole table; only sums for each group leave a task, so a source
that holds a third of all rows is spread like any other data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, null_safe_join, save

_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))  # of UTF-8; other bytes begin a code point
_SYMBOLS = b"#*$%&|<>"
WINDOW = 8

# Transformed statistics and the least spread taken as real for each: about half the step of one repeated line, a repeated
# window in a text of some hundred words.
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
FLOORS = (0.25, 0.25, 0.03, 0.35, 0.03)
# Added to the words that repeated ones are a share of: one line that comes twice is no sign of a bad text, however short.
SHORT_WORDS = 75
SHARE = 0.6  # rows of a group that the estimate rests on
TAIL = 1e-9  # of the chi-squared distribution beyond the cutoff
STEPS = 5
LEAST_ROWS = 100  # smaller groups are pooled
_QUANTILE_ACCURACY = 2000

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_STATS_NAMES = [part.split()[0] for part in STATS.split(", ")]


def _repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows that occur twice or more in the text."""
    import xxhash

    n = len(words)
    if n < window + 1:
        return 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    keys = hashes[: n - window + 1].copy()
    for i in range(1, window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - window + 1 + i]
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_stats(raw: bytes, window: int = WINDOW) -> tuple[int, int, int, int, int]:
    """Base counts of one UTF-8 text: words, code points in words, symbols, repeated lines, repeated words."""
    words = raw.split()
    filled = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    return (
        len(words), len(raw.translate(None, _SPACES + _CONTINUATION)), len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(filled) - len(set(filled)), _repeated_words(words, window),
    )


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by its base counts; the other columns stay. Null text counts nothing."""
    bound_batches(docs.sparkSession)
    rest = docs.drop(*_STATS_NAMES)
    rest = rest.select(*(c for c in rest.columns if c != text), F.col(text).cast("binary").alias("_raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [text_stats(raw or b"") for raw in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *_STATS_NAMES]
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[:-1])
    return rest.mapInArrow(run, f"{types}, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "f_words": F.log1p(F.col("n_words")),
        "f_length": F.col("word_chars") / words,
        "f_symbols": F.sqrt(F.col("n_symbols") / chars),
        "f_lines": F.log1p(F.col("n_dup_lines")),
        "f_repeats": F.col("n_repeat_words") / (words + SHORT_WORDS),
    }


def _chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def _chi2_quantile(tail: float, k: int) -> float:
    """Where the upper tail is as given; tails down to 1e-13."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - _chi2_cdf(middle, k) > tail else (low, middle)
    return high


def _consistency(share: float, k: int) -> float:
    """Makes the scatter of the nearest share of normal data that of the whole."""
    return share / _chi2_cdf(_chi2_quantile(1 - share, k), k + 2)


def _groups(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Adds ``_g1``, ``_g2``: language and source; small sources pooled within the language; small pools all together."""
    pooled = "\x00pooled"
    first, second = keys
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") < least
    sizes = sizes.select(
        *keys, "_n", F.when(small, F.lit(pooled)).otherwise(F.coalesce(F.concat(F.lit("="), second), F.lit(""))).alias("_g2")
    )
    pools = sizes.groupBy(first, "_g2").agg(F.sum("_n").alias("_all"))
    sizes = null_safe_join(sizes, pools, [first, "_g2"])
    lone = (F.col("_g2") == pooled) & (F.col("_all") < least)
    sizes = sizes.select(
        *keys, "_g2",
        F.when(lone, F.lit(pooled)).otherwise(F.coalesce(F.concat(F.lit("="), first), F.lit(""))).alias("_g1"),
    )
    return null_safe_join(rows, sizes, keys)


def _distance() -> Column:
    """Squared Mahalanobis distance from array columns ``_centre`` and ``_inverse`` (row-major)."""
    k = len(FEATURES)
    off = [F.col(name) - F.col("_centre")[i] for i, name in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(k):
        for j in range(i, k):
            total = total + off[i] * off[j] * F.col("_inverse")[i * k + j] * (1.0 if i == j else 2.0)
    return total


def _moments() -> list[Column]:
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    return [
        F.count(F.lit(1)).alias("_m"), F.array(*(F.sum(f) for f in FEATURES)).alias("_sums"),
        F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).alias("_products"),
    ]


def _solve(moments: DataFrame, factor: float, floors: tuple[float, ...]) -> DataFrame:
    """Centre and inverse scatter of each group from its sums; one short row a group."""
    k = len(FEATURES)

    @F.pandas_udf("centre array<double>, inverse array<double>")
    def solve(count: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
        rows = []
        for m, s, p in zip(count, sums, products):
            centre = np.asarray(s, float) / m
            second = np.zeros((k, k))
            second[np.triu_indices(k)] = np.asarray(p, float) / m
            second = second + np.triu(second, 1).T
            scatter = (second - np.outer(centre, centre)) * factor
            # In units of the floors, no direction has a spread below 1.
            values, vectors = np.linalg.eigh((scatter + scatter.T) / 2 / np.outer(floors, floors))
            scatter = (vectors * np.maximum(values, 1)) @ vectors.T * np.outer(floors, floors)
            rows.append((centre.tolist(), np.linalg.inv(scatter).ravel().tolist()))
        return pd.DataFrame(rows, columns=["centre", "inverse"])

    solved = moments.withColumn("_solved", solve("_m", "_sums", "_products"))
    return solved.select(
        "_g1", "_g2", F.col("_solved.centre").alias("_centre"), F.col("_solved.inverse").alias("_inverse")
    )


def judge(stats: DataFrame, keys: list[str], share: float = SHARE, tail: float = TAIL, steps: int = STEPS,
          least: int = LEAST_ROWS, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Adds ``base_failed``, ``distance`` and ``kept`` to rows with base counts.

    Rows that fail the base rules are rejected and take no part in the estimates. ``keys`` are two columns,
    language and source; null is a value of its own. Groups of fewer than ``least`` rows are pooled within the
    language, and then over languages; if even that pool is smaller, its rows have no distance and are kept.
    """
    rows = stats.withColumn("base_failed", base_failed())
    sound = rows.where(~F.col("base_failed")).withColumns(_features())
    sound = save(_groups(sound, keys, least), "quality")
    group = ["_g1", "_g2"]
    # First estimate: medians, and quartiles as spread.
    parts = [F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(_QUANTILE_ACCURACY)).alias(f) for f in FEATURES]
    first = sound.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"), *parts).where(F.col("_m") >= least)
    k = len(FEATURES)
    spreads = [
        F.lit(1.0) / F.pow(F.greatest((F.col(f)[2] - F.col(f)[0]) / 1.349, F.lit(floors[i])), F.lit(2)) for i, f in enumerate(FEATURES)
    ]
    state = first.select(
        *group, F.array(*(F.col(f)[1] for f in FEATURES)).alias("_centre"),
        F.array(*(spreads[i] if i == j else F.lit(0.0) for i in range(k) for j in range(k))).alias("_inverse"),
    )
    state = save(state, "scatter")
    for _ in range(steps):
        measured = sound.join(state, group).select(*group, *FEATURES, _distance().alias("_d"))
        nearest = measured.groupBy(*group).agg(
            F.percentile_approx("_d", F.lit(share), F.lit(_QUANTILE_ACCURACY)).alias("_limit")
        )
        limits = save(state.join(nearest, group), "limits")
        inner = sound.join(limits, group).where(_distance() <= F.col("_limit"))
        state = save(_solve(inner.groupBy(*group).agg(*_moments()), _consistency(share, k), floors), "scatter")
    cutoff = _chi2_quantile(tail, k)
    judged = sound.join(state, group, "left").withColumn("distance", _distance())
    judged = judged.withColumn("kept", F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    failed = rows.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    columns = [*rows.columns, "distance", "kept"]
    return judged.select(*columns).unionByName(failed.select(*columns))


def judge_documents(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every document.

    Null and empty texts count nothing and fail the base rules. Repeated rows are judged alike. Other columns than
    doc_id, lang, source and text are not read; an empty table gives no rows.
    """
    stats = save(with_stats(docs.select("doc_id", "lang", "source", "text")), "stats")
    judged = judge(stats, ["lang", "source"])
    return judged.select("doc_id", *_STATS_NAMES, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    marked = docs.withColumn("__llm_hash", F.xxhash64("text"))
    keys = ["doc_id", "lang", "source", "__llm_hash"]
    stats = save(with_stats(marked.select(*keys, "text")), "stats")
    good = judge(stats, ["lang", "source"])
    rejected = good.where(~F.col("kept")).select(*keys).distinct()
    return null_safe_join(marked, rejected, keys, "left_anti").drop("__llm_hash")

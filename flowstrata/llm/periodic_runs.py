"""Periodic runs in word sequences, found with an enhanced suffix array.

Documents are taken by the block, each with words and an end sign of its own, so that one suffix array (prefix doubling;
only suffixes that still tie are sorted again) serves many of them. Its LCP intervals are listed by one sweep with a
stack; no tree is built. For an interval of depth D, the suffixes i of all but its largest child look up whether i + D
or i - D lies in the interval, too, but goes on differently: that is a square of period D which no later word extends,
a branching tandem repeat. Squares rotate to the left as far as the words agree and so merge into their run. Squares of
a power of a shorter period end where the run of that period ends, and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_batches

LEAST_LENGTH = 6  # words of a run
LEAST_POWER = 4  # periods of a run
BLOCK_WORDS = 300_000  # words whose suffixes are sorted together; a longer text stands alone, whole
_STEP = 1 << 21  # look-ups at a time

RUNS = "array<struct<start:long,length:long,period:long>>"


class SuffixArray:
    """Suffixes of ``symbols`` (distinct documents share no symbol, each ends in one that occurs once), in order.

    ``order`` and ``rank`` are inverse; ``lcp[j]`` belongs to neighbours ``j - 1`` and ``j``; ``levels[k]`` names the
    classes of equal words at each position, 2 ** k words long.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        # born[j]: the round that told neighbour j from neighbour j - 1.
        born, levels, width = np.where(head, 0, -1), [], 1
        while True:
            levels.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
            tied = ~head
            tied[:-1] |= ~head[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            at = order[slots]
            pair = rank[at] * n + rank[at + width]
            sorting = np.argsort(pair, kind="stable")
            pair, at = pair[sorting], at[sorting]
            first = np.r_[True, pair[1:] != pair[:-1]]
            order[slots] = at
            rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
            fresh = slots[first]
            fresh = fresh[~head[fresh]]
            head[fresh], born[fresh] = True, len(levels)
            width *= 2
        self.symbols, self.order, self.rank, self.levels = symbols, order, rank, levels
        self.lcp = np.zeros(n, np.int64)
        later = np.flatnonzero(born > 0)
        known = born[later] - 1  # lcp is in [2 ** known, 2 ** (known + 1))
        length = np.int64(1) << known
        for k in range(len(levels) - 2, -1, -1):
            some = np.flatnonzero(known > k)
            a, b = order[later[some] - 1] + length[some], order[later[some]] + length[some]
            length[some] += (levels[k][a] == levels[k][b]).astype(np.int64) << k
        self.lcp[later] = length

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` (elementwise different) have in common."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            length += (self.levels[k][a + length] == self.levels[k][b + length]).astype(np.int64) << k
        return length

    def children(self) -> tuple[np.ndarray, ...]:
        """Children of all LCP intervals: first and last rank, then first rank, last rank and depth of the interval."""
        lcp = self.lcp.tolist()
        n = len(lcp)
        lcp.append(0)
        starts, ends, lows, highs, depths = [], [], [], [], []
        stack = []  # (depth, first rank, start of the child that is open, children so far)
        for j, depth in enumerate(lcp):
            if j == 0:
                continue
            low = j - 1
            while stack and stack[-1][0] > depth:
                top, low, opened, done = stack.pop()
                done.append(opened)
                done_ends = [*(d - 1 for d in done[1:]), j - 1]
                starts += done
                ends += done_ends
                lows += [low] * len(done)
                highs += [j - 1] * len(done)
                depths += [top] * len(done)
            if depth == 0 or j == n:
                continue
            if stack and stack[-1][0] == depth:
                top, first, opened, done = stack[-1]
                done.append(opened)
                stack[-1] = (top, first, j, done)
            else:
                stack.append((depth, low, j, [low]))
        return tuple(np.array(c, np.int64) for c in (starts, ends, lows, highs, depths))


def branching_squares(array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares that the next word doesn't extend."""
    start, end, low, high, depth = array.children()
    if not len(start):
        return start, start
    size = end - start + 1
    # The largest child of each interval looks nothing up; children of an interval stand together.
    interval = np.cumsum(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (depth[1:] != depth[:-1])]) - 1
    ranked = np.lexsort((-size, interval))
    largest = ranked[np.r_[True, interval[ranked][1:] != interval[ranked][:-1]]]
    small = np.ones(len(start), bool)
    small[largest] = False
    start, size, low, high, depth = start[small], size[small], low[small], high[small], depth[small]
    symbols, rank, found = array.symbols, array.rank, []
    bounds = np.cumsum(size)
    first = 0
    while first < len(start):
        before = bounds[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(bounds, before + _STEP, "right")))
        counts = size[first:last]
        child = np.repeat(np.arange(first, last), counts)
        at = array.order[start[child] + np.arange(len(child)) - np.repeat(np.cumsum(counts) - counts, counts)]
        wide = depth[child]
        for square in (at, at - wide):
            other = np.where(square is at, at + wide, square)
            inside = other >= 0
            place = rank[np.where(inside, other, 0)]
            inside &= (place >= low[child]) & (place <= high[child])
            one, period = square[inside], wide[inside]
            ends = symbols[one + period] != symbols[one + 2 * period]
            found.append(np.stack([one[ends], period[ends]]))
        first = last
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def find_runs(symbols: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start and period. ``symbols`` as for ``SuffixArray``."""
    if len(symbols) < 2:
        return []
    array = SuffixArray(symbols)
    start, period = branching_squares(array)
    end = start + 2 * period
    least = np.maximum(least_length, least_power * period)
    fits = end >= least
    start, period, end, least = start[fits], period[fits], end[fits], least[fits]
    long = symbols[end - least] == symbols[end - least + period]
    start, period, end, least = start[long], period[long], end[long], least[long]
    long = array.common(end - least, end - least + period) == least - period
    start, period, end, least = start[long], period[long], end[long], least[long]
    runs, ending, last = [], [], -1
    for i in np.lexsort((period, end)).tolist():
        at, step, stop = int(start[i]), int(period[i]), int(end[i])
        if stop != last:
            ending, last = [], stop
        if any(step % p == 0 and first <= at for p, first in ending):
            continue
        first = _rotated(symbols, stop - int(least[i]), step)
        ending.append((step, first))
        runs.append((first, stop - first, step))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _rotated(symbols: np.ndarray, at: int, period: int) -> int:
    """The least start to which a run of ``period`` that covers ``at`` extends."""
    width = 64
    while at > 0:
        low = max(0, at - width)
        unlike = np.flatnonzero(symbols[low:at] != symbols[low + period : at + period])
        if len(unlike):
            return low + int(unlike[-1]) + 1
        at, width = low, width * 2
    return at


def _blocks(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        words = text.split()
        if held and size + len(words) > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _runs_of(documents: list[list[bytes]], least_length: int, least_power: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each document's words."""
    ids, sizes = {}, np.array([len(words) + 1 for words in documents])
    flat = [ids.setdefault(word, len(ids) + 1) for words in documents for word in (*words, b"")]
    # No word is empty: that id is the end sign, and becomes another symbol in each document.
    symbols = np.repeat(np.arange(len(documents)), sizes) * (len(ids) + 1) + np.array(flat, np.int64)
    starts = np.cumsum(sizes) - sizes
    found = [[] for _ in documents]
    for start, length, period in find_runs(symbols, least_length, least_power):
        owner = int(np.searchsorted(starts, start, "right")) - 1
        found[owner].append((start - int(starts[owner]), length, period))
    return found


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def mark_runs(docs: DataFrame, columns: list[str], text: str = "text", least_length: int = LEAST_LENGTH,
              least_power: int = LEAST_POWER) -> DataFrame:
    """Every row's runs of words: the named columns, ``n_words``, ``runs`` (start, length and period in words, by start and
    period) and ``collapsed`` (the words that stay, joined by one space).

    A run is a stretch of ``least_length`` words or more and of ``least_power`` smallest periods or more that can't be
    extended. Null, empty and blank texts have no words and no runs. Rows are judged one by one: repeated ones come back
    as often as they occur, an empty table gives no rows. Other columns are not read. No shuffle.
    """
    if least_power < 2:
        raise ValueError("a run holds two periods at least")
    bound_batches(docs.sparkSession)
    keys = docs.select(*columns, F.coalesce(text, F.lit("")).alias("__llm_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema),
                        "n_words long", f"runs {RUNS}", "collapsed string"])
    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in _blocks(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                runs = _runs_of(block, least_length, least_power)
                texts = [_collapsed(words, own) for words, own in zip(block, runs, strict=True)]
                kept = batch.slice(done, len(block))
                done += len(block)
                yield pa.RecordBatch.from_arrays([
                    *kept.columns[:-1], pa.array([len(words) for words in block], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], struct),
                    pa.array(texts, pa.binary()).cast(pa.string(), safe=False),
                ], names=[*kept.schema.names[:-1], "n_words", "runs", "collapsed"])

    return keys.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact power; ties to the least start, then period; null without runs."""

    def before(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        ahead = (left > right) | ((left == right) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])))
        return F.when(ahead, F.lit(-1)).otherwise(F.lit(1))

    return F.try_element_at(F.array_sort(runs, before), F.lit(1))


def with_periods(docs: DataFrame) -> DataFrame:
    """``documents`` in which the tail of every tenth text, by the checksum of its id, is made periodic (a rule of the
    data contract). Rows without an id stay as they are."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = docs.select("doc_id", "text", check.alias("_h"), F.when(check % 10 == 0, words).alias("_words"))
    g, n = F.floor(F.col("_h") / 10), F.size("_words")
    chosen = chosen.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    chosen = chosen.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    turned = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return chosen.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digest_documents(docs: DataFrame) -> DataFrame:
    """Digests of the runs of every document."""
    marked = mark_runs(with_periods(docs), ["doc_id"]).withColumn("_best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return marked.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

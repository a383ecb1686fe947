"""Phrase collocation mining with HAT-tries of word ids.

Phrases of one word are counted first, then those of two, and so on. A task counts in a trie: its shallow levels are
word ids, its leaves containers of packed ids that burst into a further level when they grow. When the trie reaches its
budget, its largest subtrees are spilled, as sorted runs, and leave the memory. Runs meet in prefix partitions, by
language and first word; a prefix is dealt over slices, so that a very common first word is no hot task. A longer phrase
is counted only where both phrases that are one word shorter are frequent, which Bloom filters of fixed size tell
(a wrong yes costs work; counts are exact at any size).

A chunk of texts is cut into words and encoded by its own dictionary in arrays; only the words of that dictionary, not
their occurrences, are looked up one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, save

LEAST = 10  # occurrences of a frequent phrase
COVERED = 50  # per cent of a phrase's occurrences inside a longer one that make it redundant
SCALE = 1_000_000
BLOOM_BITS = 1 << 26  # 8 MB at any corpus size
PROBES = 4
ENTRIES = 2_000_000  # counts held by a task's trie, 16 bytes each
WORDS = 300_000  # words of a task's dictionary; below 2 ** ID_BITS
BURST = 65_536  # entries of a container
RUN = 262_144  # entries of a run, about: a subtree is not cut
RANGE_BITS = 8  # first ids that share a container until it bursts: 2 ** RANGE_BITS
CHUNK_BYTES = 2 << 20
SLICES = 16
ID_BITS = 21  # three ids fit one 64-bit key

# Upper to lower case; every piece end to a full stop, which then stands for itself as a word.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)
_RUNS = "_part long, lang string, phrase string, n long"


def _tokens(texts: list[bytes]) -> pa.Array:
    """Lower-cased words in order, with a full stop for every piece end and after every text."""
    data = np.frombuffer(b".".join([*texts, b""]).translate(_FOLD), np.uint8)
    stop, inside = data == ord("."), (data != ord(" ")) & (data != ord("\t"))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | stop[:-1]
    begins |= stop
    starts = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int64)
    buffers = [None, pa.py_buffer(starts), pa.py_buffer(data[inside])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, buffers)


class _Words(dict):
    """Word to id, from 1; piece ends are 0. ``codes`` holds a hash per id."""

    def __init__(self):
        self[b"."] = 0
        self.names, self.codes = [b"."], np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        return number

    def ids(self, texts: list[bytes], known=None) -> np.ndarray:
        """Ids of the words of texts. ``known`` tells from codes which words get one; the others are 0."""
        coded = _tokens(texts).dictionary_encode()
        own = coded.dictionary.to_pylist()
        numbers = np.zeros(len(own), np.int64)
        if known is None:
            numbers[:] = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
        else:
            at = np.flatnonzero(known(_hashed(own)))
            numbers[at] = np.fromiter((self[own[i]] for i in at.tolist()), np.int64, len(at))
        self.codes = np.concatenate([self.codes, _hashed(self.names[len(self.codes) :])])
        return numbers[coded.indices.to_numpy()]


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(lang: bytes, codes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit code per phrase, from its language and its words' codes in order."""
    mixed = np.full(len(codes[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for code in codes:
        mixed = (mixed ^ code) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _positions(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (codes >> np.uint64(32)) | np.uint64(1)
    return [(codes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]


def _among(bloom: np.ndarray, codes: np.ndarray) -> np.ndarray:
    found = np.ones(len(codes), bool)
    for at in _positions(codes, len(bloom) * 64):
        found &= (bloom[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


class HatTrie:
    """Counts phrases of ``order`` word ids, packed into one key. A root entry is a language and a range of first ids; its
    node is a container until it bursts, into nodes by first id, and those by the next id. ``size`` counts what the
    containers hold: keys that came twice count twice until ``compact``."""

    def __init__(self, order: int):
        self.order, self.size, self.root = order, 0, {}
        self.bits = (order - 1) * ID_BITS + RANGE_BITS

    def add(self, lang: bytes, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct packed keys in ascending order, with their counts."""
        for head, rests, own in _by_head(keys, counts, self.bits):
            self.root.setdefault((lang, head), _Node(self.bits)).add(rests, own)
        self.size += len(keys)

    def compact(self) -> None:
        """Every key once; containers that have grown burst."""
        for node in self.root.values():
            node.compact()
        self.size = sum(node.size for node in self.root.values())

    def spill(self, keep: int, words: _Words) -> Iterator[pa.RecordBatch]:
        """Takes the largest subtrees out until ``keep`` counts stay; sorted runs of a language each."""
        self.compact()
        taken, held = defaultdict(list), defaultdict(int)
        for path in sorted(self.root, key=lambda p: self.root[p].size, reverse=True):
            if self.size <= keep:
                break
            node = self.root.pop(path)
            self.size -= node.size
            taken[path[0]] += node.entries(path[1] << self.bits)
            held[path[0]] += node.size
            if held[path[0]] >= RUN:
                yield self._run(path[0], taken.pop(path[0]), words)
                held[path[0]] = 0
        for lang, parts in taken.items():
            yield self._run(lang, parts, words)

    def _run(self, lang: bytes, parts: list[tuple[np.ndarray, np.ndarray]], words: _Words) -> pa.RecordBatch:
        keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        ids = [keys >> i * ID_BITS & (1 << ID_BITS) - 1 for i in range(self.order - 1, -1, -1)]
        used = np.flatnonzero(np.bincount(np.concatenate(ids)))
        names = pa.array([words.names[i] for i in used.tolist()], pa.binary())
        sorted_names = pc.sort_indices(names).to_numpy()
        rank = np.zeros(used[-1] + 1, np.int64)
        rank[used[sorted_names]] = np.arange(len(used))
        ranked = np.zeros(len(keys), np.int64)
        for i in ids:
            ranked = ranked << ID_BITS | rank[i]
        order = np.argsort(ranked)
        names = names.take(pa.array(sorted_names))
        phrases = [names.take(pa.array(rank[i][order])) for i in ids]
        joined = pc.binary_join_element_wise(*phrases, pa.scalar(b" ", pa.binary())) if self.order > 1 else phrases[0]
        codes = [words.codes[i[order]] for i in ids]
        slices = _mixed(lang, codes) % np.uint64(SLICES)
        return _as_batch(lang, joined, counts[order], (_mixed(lang, codes[:1]) + slices).view(np.int64))


def _by_head(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts ascending keys where their bits above ``bits`` change: those bits, what is below them, counts."""
    if not len(keys):
        return
    heads, rests = keys >> bits, keys & ((1 << bits) - 1)
    starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
    for head, low, high in zip(heads[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        yield head, rests[low:high], counts[low:high]


class _Node:
    __slots__ = ("bits", "size", "parts", "below", "table")

    def __init__(self, bits: int):
        self.bits, self.size, self.parts, self.below, self.table = bits, 0, [], 0, {}

    def add(self, rests: np.ndarray, counts: np.ndarray) -> None:
        """Packed remainders of keys, ascending; a burst node hands them on when it is compacted."""
        self.parts.append((rests, counts))
        self.size += len(rests)

    def compact(self) -> None:
        """Sums counts by key; a container that has grown bursts (``below`` set) into nodes by its keys' heads."""
        if self.parts:
            rests, counts = _summed(self.parts)
            self.parts, self.size = [(rests, counts)], len(rests)
            below = (self.bits - 1) // ID_BITS * ID_BITS
            if not self.below and below and self.size > BURST:
                self.below = below
            if self.below:
                for head, low, own in _by_head(rests, counts, self.below):
                    self.table.setdefault(head, _Node(self.below)).add(low, own)
                self.parts = []
        if self.below:
            for node in self.table.values():
                node.compact()
            self.size = sum(node.size for node in self.table.values())

    def entries(self, prefix: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of the containers below, after ``compact``."""
        if not self.below:
            return [(rests | prefix, counts) for rests, counts in self.parts]
        return [part for head, node in self.table.items() for part in node.entries(prefix | head << self.below)]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts[order], starts)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    """Texts by language, some megabytes at a time; a longer text stands alone, whole."""
    held, sizes = defaultdict(list), defaultdict(int)
    for lang, text in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 1)), strict=True):
        held[lang].append(text)
        sizes[lang] += len(text)
        if sizes[lang] >= CHUNK_BYTES:
            yield lang, held.pop(lang)
            sizes[lang] = 0
    yield from held.items()


def _as_batch(lang: bytes, phrases: pa.Array, counts: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang], pa.binary()).take(pa.array(np.zeros(len(phrases), np.int64)))
    texts = [c.cast(pa.string(), safe=False) for c in (langs, phrases)]
    return pa.RecordBatch.from_arrays([pa.array(parts), *texts, pa.array(counts, pa.int64())], ["_part", "lang", "phrase", "n"])


def _count_runs(docs: DataFrame, order: int, blooms: list) -> DataFrame:
    """Sorted runs of counts with their partitions. At order 1 an empty phrase carries a language's words. ``blooms``: a
    broadcast filter for each lower order."""
    limits = ENTRIES, WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words, totals = HatTrie(order), _Words(), defaultdict(int)
        for batch in batches:
            for lang, texts in _chunks(batch):
                known = (lambda codes, lang=lang: _among(blooms[0].value, _mixed(lang, [codes]))) if blooms else None
                ids = words.ids(texts, known)
                valid = ids > 0
                if order == 1:
                    totals[lang] += int(valid.sum())
                for size in range(2, order + 1):
                    valid = valid[:-1] & valid[1:]
                    if size < order:
                        at = np.flatnonzero(valid)
                        codes = [words.codes[ids[at + i]] for i in range(size)]
                        valid[at] = _among(blooms[size - 1].value, _mixed(lang, codes))
                at = np.flatnonzero(valid)
                keys = np.zeros(len(at), np.int64)
                for i in range(order):
                    keys = keys << ID_BITS | ids[at + i]
                trie.add(lang, *np.unique(keys, return_counts=True))
                if len(words) > limits[1]:
                    yield from trie.spill(0, words)
                    words = _Words()
                elif trie.size > limits[0]:
                    yield from trie.spill(limits[0] // 2, words)
        yield from trie.spill(0, words)
        for lang, total in totals.items():
            yield _as_batch(lang, pa.array([b""], pa.binary()), np.array([total]), np.zeros(1, np.int64))

    return docs.mapInArrow(run, _RUNS)


def _merged(runs: DataFrame) -> DataFrame:
    """Sums runs per prefix partition: language, first word and one of its slices. Runs are sums already, so their rows
    are dealt out as they are, and summed once."""
    return runs.repartition("_part").groupBy("_part", "lang", "phrase").agg(F.sum("n").alias("n")).drop("_part")


def _bloom(frequent: DataFrame, bits: int):
    """Broadcast filter of the frequent phrases of one length; ``bits / 8`` bytes, built in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = (batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 1))
            at = []
            for lang, phrase in zip(langs, phrases, strict=True):
                codes = [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.split(b" ")]
                at += _positions(_mixed(lang, codes), bits)
            at = np.concatenate(at) if at else np.zeros(0, np.uint64)
            ones = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(ones)], ["at", "ones"])

    marks = frequent.select("lang", "phrase").mapInArrow(run, "at long, ones long")
    found = marks.groupBy("at").agg(F.bit_or("ones").alias("ones")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found.column("at").to_numpy()] = found.column("ones").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def count_phrases(docs: DataFrame, max_words: int = 3, least: int = LEAST, lang: str = "lang", text: str = "text",
                  bloom_bits: int = BLOOM_BITS) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of up to ``max_words`` (3 at most) words that occur ``least`` times or more in their
    language, as lang, phrase, n, size; and all words of each language, as lang, n.

    Null language counts as ``und``, null text as empty. Every row counts, repeated ones too. Columns beside the two
    named ones are not read. ``bloom_bits``, a power of two, bounds each broadcast.
    """
    if not 1 <= max_words <= 3:
        raise ValueError("phrases hold one to three words")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    levels, blooms = [], []
    for order in range(1, max_words + 1):
        counts = _merged(_count_runs(texts, order, blooms)).where((F.col("n") >= least) | (F.col("phrase") == ""))
        counts = save(counts.withColumn("size", F.lit(order)), f"phrases-{order}")
        if order == 1:
            totals = counts.where("phrase = ''").select("lang", "n")
            counts = counts.where("phrase <> ''")
        levels.append(counts)
        if order < max_words:
            blooms.append(_bloom(counts, bloom_bits))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, totals


def score_phrases(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut: lang, phrase, size, a, l, r, score.

    Score: ``floor(1000000 * a * a / (l * r))`` in decimals, exact while a language has below 10 ** 15 words.
    """
    many = counts.where("size > 1").withColumnRenamed("n", "a")
    words = F.split("phrase", " ", -1)
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("_head"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("_tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("_head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("_tail"), F.col("n").alias("r"))
    both = cuts.join(heads, ["lang", "_head"]).join(tails, ["lang", "_tail"])
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    score = F.floor(F.call_function("div", wide["a"] * wide["a"] * F.lit(SCALE).cast("decimal(7,0)"), wide["l"] * wide["r"]))
    best = both.select("lang", "phrase", "size", "a", F.struct(score.cast("bigint").alias("score"), "k", "l", "r").alias("_cut"))
    chosen = best.groupBy("lang", "phrase", "size", "a").agg(F.min("_cut").alias("_cut"))
    return chosen.select("lang", "phrase", "size", "a", "_cut.l", "_cut.r", "_cut.score")


def without_covered(scored: DataFrame, per_cent: int = COVERED) -> DataFrame:
    """Drops phrases that stand inside a longer one which holds ``per_cent`` of their occurrences."""
    words, longest = F.split("phrase", " ", -1), scored.where("size > 2")
    sized = longest.withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    placed = sized.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_n") + 1)))
    inner = placed.select("lang", F.array_join(F.slice(words, F.col("_at"), F.col("_n")), " ").alias("phrase"), "a")
    inside = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_inside"))
    joined = scored.join(inside, ["lang", "phrase"], "left")
    covered = F.col("_inside") * 100 >= F.col("a") * per_cent
    return joined.where(~F.coalesce(covered, F.lit(False))).drop("_inside")


def mine_phrases(docs: DataFrame, max_words: int = 3, least: int = LEAST, per_cent: int = COVERED,
                 lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All collocations of a corpus, as lang, phrase, size, a, l, r, score; and the words of each language."""
    counts, totals = count_phrases(docs, max_words, least, lang, text)
    return without_covered(save(score_phrases(counts), "scored"), per_cent), totals


def top_phrases(docs: DataFrame, per_lang: int = 2_000) -> DataFrame:
    """Each language's ``per_lang`` best phrases: a top list by score, count and phrase.

    Languages without a frequent phrase give no rows, nor does an empty table.
    """
    found, totals = mine_phrases(docs)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")

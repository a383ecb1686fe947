"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

Cutting a text anywhere and joining the two encodings changes only tokens near the cut. A place where a character
that isn't white space is followed by white space is always a border between pieces of the split pattern, whatever
surrounds it: no alternative of the pattern has white space after anything else. So the tokens left of such a place
in the left half, and right of such a place in the right half, are those of the whole text. A join looks for the two
places in windows around the cut that double until both are found or a half is used up, re-encodes what lies between,
and keeps everything outside.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

LEAF_CHARS = 256  # longer texts are halved
FIRST_WINDOW = 32
# White space for every reading of the pattern's ``\s``; ``str.isspace`` knows a few characters more.
_SPACE = frozenset(" \t\n\r\x0b\x0c")

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a public vocabulary: about 50,000 lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes whole texts with fixed ranks and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS, window: int = FIRST_WINDOW):
        import tiktoken

        self._encode = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.leaf, self.window = max(1, leaf), max(1, window)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(token) for token in self.tokens], np.int64)
        self.names = [str(rank) for rank in range(len(self.tokens))]

    def encode(self, text: str) -> list[int]:
        return self._half(text, 0, len(text))

    def _half(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self._encode(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._half(text, start, middle), self._half(text, middle, end))

    def _join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        low = self._border_before(text, start, cut)
        high = self._border_after(text, cut, end)
        kept_left = len(left) - self._count(reversed(left), len(text[low:cut].encode("utf-8", "replace")))
        kept_right = self._count(right, len(text[cut:high].encode("utf-8", "replace")))
        return left[:kept_left] + self._encode(text[low:high]) + right[kept_right:]

    def _border_before(self, text: str, start: int, cut: int) -> int:
        width = self.window
        while True:
            low = max(start, cut - width)
            for at in range(cut - 1, max(low, start + 1) - 1, -1):
                if text[at] in _SPACE and not text[at - 1].isspace():
                    return at
            if low == start:
                return start
            width *= 2

    def _border_after(self, text: str, cut: int, end: int) -> int:
        width = self.window
        while True:
            high = min(end, cut + width)
            for at in range(cut + 1, high):
                if text[at] in _SPACE and not text[at - 1].isspace():
                    return at
            if high == end:
                return end
            width *= 2

    def _count(self, tokens, wanted: int) -> int:
        """How many tokens spell the wanted number of bytes."""
        number = 0
        for token in tokens:
            if wanted <= 0:
                break
            wanted -= self.lengths[token]
            number += 1
        return number

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of both halves, concatenated up the tree."""
        if len(ids) <= self.leaf:
            return b"".join([self.tokens[rank] for rank in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds ``n_tokens``, digests of ids and decoded bytes, and ``ids`` (little-endian 32-bit numbers) to every row.

    Columns of these names are replaced. Null and empty text: no tokens. Texts of any length are encoded whole. The
    vocabulary (of a fixed, known size) is read by the driver and broadcast; executors need no file. Nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    added = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    carried = docs.drop(*added)
    if text not in carried.columns:
        raise ValueError(f"no column {text}")
    at = carried.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*vocabulary.value)
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            for value in batch.column(at).to_pylist():
                ids = codec.encode(value or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join([codec.names[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                kept.append(np.array(ids, "<i4").tobytes() if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(decoded, pa.string()), pa.array(kept, pa.binary())],
                names=[*batch.schema.names, *added],
            )

    types = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in carried.schema)
    return carried.mapInArrow(run, f"{types}, {RESULT}")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Replaces ``ids``, as ``encode`` writes them, by ``text``; null ids give null."""
    bound_batches(encoded.sparkSession)
    vocabulary = encoded.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(*vocabulary.value)
        for batch in batches:
            yield batch.map(
                lambda raw: None if raw is None else codec.decode(np.frombuffer(raw, "<i4").tolist()).decode("utf-8", "replace")
            )

    return encoded.withColumn("text", spell("ids")).drop("ids")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digest of the encoding of documents, one row each."""
    short = docs.select("doc_id", "text")
    return encode(short, ranks_path, pattern, keep_ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )

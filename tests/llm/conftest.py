from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from ``(doc_id, text[, lang, source])``."""

    def make(rows, extra=None):
        full = [(*r, *(["en", "src0"][len(r) - 2 :]), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", *extra) if extra else df

    return make


@pytest.fixture(scope="session")
def prose():
    """Distinct texts of random words; the same for the same seed."""

    def make(seed, words, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(words))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, blanks, a very long text, ties and repeated rows."""
    text = prose(1, 30)
    return [
        (None, None, None, None), (None, text, "en", None), (1, "", "en", "a"), (2, " \n\t \r\n", "en", "a"),
        (3, prose(2, 60_000), "en", "a"), (4, text, "de", "b"), (4, text, "de", "b"), (5, text, "de", "b"),
        (6, "één à\x1cb c", None, "b"), (7, "x" * 200_000, "en", "a"), (8, None, "en", "a"),
    ]

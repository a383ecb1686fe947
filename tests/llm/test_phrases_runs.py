"""Phrase collocations and periodic runs, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from flowstrata.llm import collocations, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases

def plain_phrases(rows, least=10, per_lang=2000):
    found, counts, totals = [], {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, own in counts.items():
        many = {p: n for p, n in own.items() if len(p) > 1 and n >= least}
        longest = Counter()
        for phrase, n in many.items():
            if len(phrase) == 3:
                for inner in (phrase[:2], phrase[1:]):
                    longest[inner] = max(longest[inner], n)
        scored = []
        for phrase, a in many.items():
            cuts = [(own[phrase[:k]], own[phrase[k:]]) for k in range(1, len(phrase))]
            score, k = min((1_000_000 * a * a // (l * r), k) for k, (l, r) in enumerate(cuts))
            if 100 * longest[phrase] < 50 * a:
                scored.append((-score, -a, " ".join(phrase).encode(), *cuts[k]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:per_lang], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def phrase_rows(seed, documents=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "Été", "c\x1cd", "w%", "x y", *(f"w{i}" for i in range(40))]
    rows = []
    for number in range(documents):
        words = []
        for _ in range(rng.randrange(60)):
            words.append(rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(["New York city", "of the", "a b c d"]))
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? "]))
        rows.append((number, "".join(words), rng.choice(["en", "en", "en", "de", None, "und", ""]), "src0"))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_phrases_by_brute_force(documents, monkeypatch, small):
    if small:  # spills, bursts, dictionary changes, a filter that is mostly full
        for name, value in {"ENTRIES": 40, "WORDS": 25, "BURST": 4, "RANGE_BITS": 2, "CHUNK_BYTES": 300, "BLOOM_BITS": 128}.items():
            monkeypatch.setattr(collocations, name, value)
        monkeypatch.setattr(collocations.count_phrases, "__defaults__", (3, 10, "lang", "text", 128))
    rows = phrase_rows(3) + [(None, None, "en", None), (1, "", "de", "a"), (1, "", "de", "a"), (2, "nur .", "eo", "a")]
    rows += [(9, "on and on and on " * 20, "xx", "a")] * 3
    df = documents(rows, ["'clash' AS n", "1L AS phrase"])
    found = sorted(tuple(r) for r in collocations.top_phrases(df).collect())
    assert found == plain_phrases(rows)
    assert {r[0] for r in found} >= {"en", "und", "xx"}


def test_phrases_of_nothing(documents):
    empty = documents([(1, "a b c", "en", "a")]).where("false")
    assert collocations.top_phrases(empty).collect() == []
    assert collocations.top_phrases(documents([(1, None, None, None), (2, "too few", "en", "a")])).collect() == []
    with pytest.raises(ValueError, match="one to three"):
        collocations.count_phrases(empty, max_words=4)


def test_top_list_and_exact_scores(spark, documents):
    rows = [(i, " , ".join(f"a{j} b{j}" for j in range(30)), "en", "a") for i in range(12)]
    top = collocations.top_phrases(documents(rows), per_lang=7).collect()
    assert [r["phrase"] for r in top] == sorted(f"a{j} b{j}" for j in range(30))[:7]
    # 2 ** 40 squared, times a million, passes 64 bits.
    big = 1 << 40
    counts = spark.createDataFrame(
        [("en", "x", big + 1, 1), ("en", "y", big + 3, 1), ("en", "x y", big, 2)], "lang string, phrase string, n long, size int"
    )
    assert [r["score"] for r in collocations.score_phrases(counts).collect()] == [10**6 * big * big // ((big + 1) * (big + 3))]


def test_filter_has_no_misses_and_sheds_rare_phrases(spark):
    rows = [("en", f"p{i} q{i % 7}") for i in range(500)]
    bloom = collocations._bloom(spark.createDataFrame(rows, "lang string, phrase string"), 1 << 14).value
    words = collocations._Words()

    def among(lang, pairs):
        ids = [words.ids([f"{a} {b}".encode()]) for a, b in pairs]
        codes = [words.codes[[i[k] for i in ids]] for k in (0, 1)]
        return collocations._among(bloom, collocations._mixed(lang, codes))

    assert among(b"en", [p.split() for _, p in rows]).all()
    assert among(b"en", [(f"q{i % 7}", f"p{i}") for i in range(500)]).mean() < 0.1
    assert among(b"de", [p.split() for _, p in rows]).mean() < 0.1


def test_counting_sums_in_the_task_and_shuffles_once(documents, monkeypatch):
    # A task sends a phrase once, however often and in whatever chunks it comes, and no word that the filter rules out.
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 100)
    rare = " ".join(f"rare{i} once{i}" for i in range(500))
    df = documents([(i, f"on and on, {rare}", "en", "a") for i in range(12)] + [(99, "on and " + "off " * 9, "en", "a")])
    words = documents([(1, "x", "en", "a")]).selectExpr("'en' AS lang", "explode(array('on', 'and')) AS phrase")
    runs = collocations._count_runs(df.select("lang", "text").coalesce(1), 2, [collocations._bloom(words, 1 << 20)])
    assert {r["phrase"]: r["n"] for r in runs.collect()} == {"on and": 13, "and on": 12}
    assert runs.count() == 2
    merged = collocations._merged(runs)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    # Nothing is summed below the exchange.
    assert plan.rindex("Aggregate") < plan.index("Exchange")


@pytest.mark.parametrize("burst", [3, 10_000])
def test_trie_counts_across_bursts_and_spills(monkeypatch, burst):
    monkeypatch.setattr(collocations, "BURST", burst)
    monkeypatch.setattr(collocations, "RUN", 50)
    rng, words, plain, found = random.Random(burst), collocations._Words(), Counter(), Counter()
    trie = collocations.HatTrie(3)
    for _ in range(20):
        ids = words.ids([" ".join(f"w{rng.randrange(9)}" for _ in range(60)).encode()])[:-1]
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        trie.add(b"en", *np.unique(keys, return_counts=True))
        names = [words.names[i] for i in ids]
        plain.update(b" ".join(names[i : i + 3]).decode() for i in range(len(names) - 2))
        runs = list(trie.spill(100, words))
        assert trie.size <= 100
        for run in runs:
            assert (listed := run["phrase"].to_pylist()) == sorted(set(listed))
            found.update(dict(zip(listed, run["n"].to_pylist(), strict=True)))
    for run in trie.spill(0, words):
        found.update(dict(zip(run["phrase"].to_pylist(), run["n"].to_pylist(), strict=True)))
    assert found == plain and trie.size == 0


# --- runs

def plain_runs(words, least_length=6, least_power=4):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : j + q]
            shorter = any(q % p == 0 and stretch[p:] == stretch[:-p] for p in range(1, q))
            if length >= max(least_length, least_power * q) and not shorter:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    power = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, power, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)))


def random_words(rng):
    words = [f"{rng.randrange(rng.choice([1, 2, 2, 3, 50]))}" for _ in range(rng.randrange(70))]
    if words and rng.random() < 0.6:
        a, q = rng.randrange(len(words)), rng.randrange(1, 8)
        words = [words[i] if i < a else words[a + (i - a) % min(q, len(words) - a)] for i in range(len(words))]
    return words


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (5, 3)])
def test_runs_by_brute_force(limits):
    rng = random.Random(sum(limits))
    for _ in range(120):
        block = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        found = periodic_runs._runs_of([[w.encode() for w in words] for words in block], *limits)
        assert found == [plain_runs(words, *limits) for words in block]


def test_suffix_array_by_sorting():
    import numpy as np

    rng = random.Random(8)
    symbols = np.array([*(rng.randrange(3) for _ in range(200)), 3])
    array = periodic_runs.SuffixArray(symbols)
    suffixes = [tuple(symbols[i:].tolist()) for i in range(201)]
    assert array.order.tolist() == sorted(range(201), key=suffixes.__getitem__)
    for j in range(1, 201):
        a, b = suffixes[array.order[j - 1]], suffixes[array.order[j]]
        assert array.lcp[j] == next(k for k in range(201) if a[k] != b[k])


def test_digest_query_by_brute_force(documents, odd_rows, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", 500)
    rng = random.Random(4)
    rows = [(i, "  ".join(random_words(rng)) + "\n", "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(200))), "en", "a") for i in range(60)]
    rows += [r for r in odd_rows if r[0] != 3]
    found = periodic_runs.digest_documents(documents(rows, ["'x' AS runs", "1 AS n_words"])).collect()
    key = repr
    assert sorted((tuple(r) for r in found), key=key) == sorted((plain_digest(r[0], r[1]) for r in rows), key=key)
    assert sum(r["n_runs"] > 0 for r in found) > 50


def test_very_long_runs(documents, prose):
    body = prose(1, 300)
    text = "a " * 200_000 + body + " x y z" * 50_000
    row = periodic_runs.mark_runs(documents([(1, text, "en", "a")]), ["doc_id"]).collect()[0]
    assert [tuple(r) for r in row["runs"]] == [(0, 200_000, 1), (200_300, 150_000, 3)]
    assert row["collapsed"] == f"a {body} x y z"
    assert row["n_words"] == 350_300


def test_runs_keep_columns_and_empty_tables(documents):
    df = documents([(1, "a a a a a a", "en", "a"), (1, "a a a a a a", "en", "a"), (2, None, None, None)])
    rows = periodic_runs.mark_runs(df, ["doc_id", "lang"]).collect()
    assert sorted((r["doc_id"], r["lang"] or "", len(r["runs"]), r["collapsed"]) for r in rows) == [
        (1, "en", 1, "a"), (1, "en", 1, "a"), (2, "", 0, ""),
    ]
    assert periodic_runs.mark_runs(df.where("false"), ["doc_id"]).collect() == []
    assert periodic_runs.digest_documents(df.where("false")).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.mark_runs(df, ["doc_id"], least_power=1)

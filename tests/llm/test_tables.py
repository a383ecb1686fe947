"""Quality rules, line templates, mixing, near duplicates, neighbours and the pipeline, against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowstrata.llm import common, line_templates, mixing, near_dup, neighbours, quality
from flowstrata.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- helpers

def test_numbered_is_gapless(spark, monkeypatch):
    monkeypatch.setattr(common, "_CHUNK", 7)
    rows = [(g, v) for g in ("a", None) for v in list(range(40)) + [5] * 60]
    df = spark.createDataFrame(rows, "g string, v long")
    found = common.expanded(common.numbered(df, ["g"], ["v"], 8), "at").collect()
    for group in ("a", None):
        assert sorted(r["at"] for r in found if r.g == group) == list(range(100))
    assert Counter((r.g, r.v) for r in found) == Counter(rows)


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {n: n for pair in links for n in pair}
    for _ in range(500):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: root[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- quality rules

def plain_stats(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def test_text_stats_by_brute_force():
    rng = random.Random(4)
    parts = ["a", "bc", "é", " ", "\n", "\n\n", "\t", "\x1c", "日本", "#", "|x", "a b c d e f g h i ", "\r", " \x0b"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        assert quality.text_stats(text.encode()) == plain_stats(text)


def test_quality_documents(documents, odd_rows, prose):
    rng = random.Random(8)
    rows = [(1000 + i, prose(i, rng.randrange(60, 400)), "en", f"src{i % 2}") for i in range(500)]
    junk = [(5000 + i, " ".join(f"{w}###" for w in prose(i, 100).split()), "en", "src0") for i in range(40)]
    found = quality.judge_documents(documents(rows + junk + odd_rows, extra=["1 as n_words", "2 as kept"])).collect()
    assert len(found) == len(rows + junk + odd_rows)
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[r[0]] for r in rows) and not any(kept[r[0]] for r in junk)
    texts = Counter((r[0], *plain_stats(r[1] or "")) for r in rows + junk + odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == texts
    for row in found:
        assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
        assert not (row.base_failed and row.kept)
    docs = documents(rows[:5] + odd_rows)
    assert quality.keep_good(docs).where("doc_id < 1000").count() == 4  # 3, 4, 4, 5
    assert quality.judge_documents(docs.limit(0)).collect() == []


def test_each_statistic_can_reject(spark):
    rng = random.Random(6)
    rows = [(i, "en", "a", n, 5 * n + rng.randrange(20), rng.randrange(3), 0, 0)
            for i, n in enumerate(rng.randrange(150, 500) for _ in range(600))]
    odd = [(1000, "en", "a", 1_000_000, 5_000_000, 0, 0, 0), (1001, "en", "a", 300, 3600, 1, 0, 0),
           (1002, "en", "a", 300, 1500, 300, 0, 0), (1003, "en", "a", 300, 1500, 1, 100, 0), (1004, "en", "a", 300, 1500, 1, 0, 85)]
    stats = spark.createDataFrame(rows + odd, "doc_id long, lang string, source string, " + quality.STATS)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(stats, ["lang", "source"]).collect()}
    assert [kept[r[0]] for r in odd] == [(False, False)] * 5
    assert all(kept[r[0]] == (False, True) for r in rows)


def test_line_repeated_in_short_text_is_kept(spark):
    rng = random.Random(7)
    rows = [(i, "en", "a", n, 5 * n + rng.randrange(20), 0, 0, 0) for i, n in enumerate(20 + int(rng.lognormvariate(5.5, 0.9)) for _ in range(600))]
    short = [(1000 + n, "en", "a", n, 5 * n, 0, 1, 18) for n in range(64, 91)]
    stats = spark.createDataFrame(rows + short, "doc_id long, lang string, source string, " + quality.STATS)
    kept = {r.doc_id: r.kept for r in quality.judge(stats, ["lang", "source"]).collect()}
    assert all(kept[r[0]] for r in rows + short)


def plain_mcd(rows):
    """Centre and scatter by concentration steps over rows held in memory, from medians and quartiles on."""
    k, floors = len(quality.FEATURES), np.array(quality.FLOORS)
    low, centre, high = np.quantile(rows, [0.25, 0.5, 0.75], axis=0)
    inverse = np.diag(1 / np.maximum((high - low) / 1.349, floors) ** 2)
    for _ in range(quality.STEPS):
        off = rows - centre
        distance = np.einsum("ni,ij,nj->n", off, inverse, off)
        near = rows[np.argsort(distance)[: round(quality.SHARE * len(rows))]]
        centre = near.mean(axis=0)
        scatter = np.cov(near.T, bias=True) * quality._consistency(quality.SHARE, k)
        values, vectors = np.linalg.eigh(scatter / np.outer(floors, floors))
        inverse = np.linalg.inv((vectors * np.maximum(values, 1)) @ vectors.T * np.outer(floors, floors))
    off = rows - centre
    return np.einsum("ni,ij,nj->n", off, inverse, off)


def test_verdict_by_plain_mcd(spark):
    rng = np.random.default_rng(11)
    rows = []
    for source, level in (("a", 5.0), ("b", 6.5)):
        words = np.exp(rng.normal(level, 0.8, 700)).astype(int) + 20
        for i, n in enumerate(words.tolist()):
            odd = i % 20 == 0
            length = rng.normal(8 if odd else 5, 0.4)
            rows.append((len(rows), "en", source, n, int(length * n), int(n * rng.uniform(0, 2 if odd else 0.1)),
                         int(rng.integers(0, 3)), int(min(0.29, rng.exponential(0.01)) * n)))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + quality.STATS)
    found = {r.doc_id: r for r in quality.judge(stats, ["lang", "source"]).collect()}
    cutoff = quality._chi2_quantile(quality.TAIL, len(quality.FEATURES))
    for source in "ab":
        group = [r for r in rows if r[2] == source]
        n, chars, symbols, lines, repeats = (np.array([r[i] for r in group], float) for i in range(3, 8))
        wanted = plain_mcd(np.column_stack([
            np.log1p(n), chars / n, np.sqrt(symbols / chars), np.log1p(lines), repeats / (n + quality.SHORT_WORDS)]))
        got = np.array([found[r[0]].distance for r in group])
        assert np.allclose(got, wanted, rtol=0.1)
        clear = np.abs(wanted / cutoff - 1) > 0.1
        assert ((got <= cutoff) == (wanted <= cutoff))[clear].all() and clear.mean() > 0.95
        assert {found[r[0]].kept for r in group} == {True, False}


def test_chi_squared():
    assert quality._chi2_quantile(0.05, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality._chi2_cdf(6.6257, 5) == pytest.approx(0.75, abs=1e-4)


# --- line templates

def test_lines_dropped(documents, prose):
    header = "Report number {} of the city council follows below here"
    rows = [(i, f"{prose(i, 30)}\n{header.format(i * 17)}\n{prose(900 + i, 25)}") for i in range(12)]
    copies = [(100 + i, prose(7, 40) + "\n" + prose(8, 40) + "\n\n" + prose(9, 40)) for i in range(9)]
    lone = [(200 + i, "One and the same line that is a whole document of its own, again and again") for i in range(9)]
    docs = documents(rows + copies + lone, extra=["1 as dropped", "2 as __llm_hash", "map('a', 1) as m"])
    found = {r.doc_id: r for r in line_templates.drop_lines(docs).collect()}
    for i, text, *_ in rows:
        first, _, last = text.split("\n")
        assert (found[i].text, found[i].n_lines, found[i].n_dropped, found[i].dropped) == (f"{first}\n{last}", 3, 1, 1)
    for i, text, *_ in copies + lone:
        assert (found[i].text, found[i].n_dropped) == (text, 0)


def test_lines_of_fields_are_kept(documents):
    words = ["".join(random.Random(i).choices("abcdefghij", k=8)) for i in range(2000)]

    def prose_of(i):
        return " ".join(words[40 * i : 40 * i + 40])

    table = [(i, f"{prose_of(i)}\n{i}1 {i}2 {i}3 {i}4 {i}5\n" + " ".join(f"{i}{j}" for j in range(10))) for i in range(8)]
    mixed = [(100 + i, f"{prose_of(10 + i)}\nPage {i} of the annual report") for i in range(8)]
    found = {r.doc_id: r for r in line_templates.drop_lines(documents(table + mixed)).collect()}
    for i, text, *_ in table:
        assert (found[i].text, found[i].n_dropped) == (text, 0)
    for i, text, *_ in mixed:
        assert (found[i].text, found[i].n_dropped) == (text.split("\n")[0], 1)


def own_words(seed, count):
    return " ".join("".join(random.Random(seed * 1000 + i).choices("abcdefghij", k=9)) for i in range(count))


def test_a_common_opening_is_no_template(documents):
    rows = [(i, f"{own_words(i, 60)}\nit is well known that {own_words(100 + i, 3)}\n{own_words(200 + i, 60)}") for i in range(5)]
    # Long lines with the same first or second half only.
    front, back = own_words(900, 20), own_words(901, 20)
    rows += [(50 + i, f"{own_words(300 + i, 60)}\n{front} {own_words(400 + i, 18)}\n{own_words(500 + i, 18)} {back}") for i in range(30)]
    found = {r.doc_id: r for r in line_templates.drop_lines(documents(rows)).collect()}
    for i, text, *_ in rows:
        assert (found[i].text, found[i].n_dropped) == (text, 0)


def test_heavy_boilerplate_goes_and_copies_stay(documents):
    same = own_words(7000, 60)
    heavy = [(i, f"{own_words(i, 40)}\n{same}") for i in range(200)]
    twice = [(300, f"{own_words(300, 80)}\n{own_words(7001, 55)}"), (301, f"{own_words(301, 5)}\n{own_words(7001, 55)}")]
    # A group of near copies: each has changed one line of eight.
    lines = [own_words(8000 + j, 25) for j in range(8)]
    near = [(400 + i, "\n".join(own_words(600 + i, 25) if j == i % 8 else x for j, x in enumerate(lines))) for i in range(40)]
    found = {r.doc_id: r for r in line_templates.drop_lines(documents(heavy + twice + near)).collect()}
    for i, text, *_ in heavy + twice:
        assert (found[i].text, found[i].n_dropped) == (text.split("\n")[0], 1)
    for i, text, *_ in near:
        assert (found[i].text, found[i].n_dropped) == (text, 0)


def test_one_varying_part_is_a_field(documents):
    names = own_words(9000, 30).split()
    rows = [(i, f"{own_words(i, 40)}\nThis article was written by {names[i]} for the weekly paper of the old town and its people")
            for i in range(30)]
    found = {r.doc_id: r for r in line_templates.drop_lines(documents(rows)).collect()}
    for i, text, *_ in rows:
        assert (found[i].text, found[i].n_dropped) == (text.split("\n")[0], 1)


def test_lines_odd_rows(documents, odd_rows):
    found = line_templates.clean_documents(documents(odd_rows)).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in odd_rows)
    assert {r.n_lines for r in found if r.text is None} == {0} and {r.n_lines for r in found if r.text == ""} == {1}
    assert line_templates.clean_documents(documents(odd_rows).limit(0)).collect() == []


# --- mixing

def plain_targets(totals, weights=(3, 1, 2), budget=1.5, cap=2):
    names = sorted((n for n in totals if n is not None)) + ([None] if None in totals else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, target = budget * sum(totals.values()), set(names), {}
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > cap * totals[n]]
        for n in over or list(free):
            target[n] = float(cap * totals[n]) if over else share[n]
            free.discard(n)
            left -= target[n]
    return target


def test_mix_documents(documents, odd_rows):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 200), "en", rng.choice(["a", "b", "c", "ä", None])) for i in range(600)]
    rows += [(1000, "one two three", "en", "hot")] * 300 + odd_rows[:1]
    found = mixing.mix_documents(documents(rows, extra=["1 as size", "2 as takes"])).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((r[0], size(r[1])) for r in rows)
    totals = defaultdict(int)
    for r in rows:
        totals[r[3]] += size(r[1])
    target = plain_targets(totals)
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in found:
        name = source[r.doc_id]
        assert r.source_size == totals[name] and r.target == pytest.approx(target[name], rel=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[name] += r.taken
    for name in totals:
        assert abs(taken[name] - target[name]) <= 5
    again = mixing.mix_documents(documents(rows[::-1])).collect()
    assert Counter(again) == Counter(r for r in found)


def test_mix_degenerate_tables(documents):
    assert mixing.mix_documents(documents([(1, "a b")]).limit(0)).collect() == []
    blank = mixing.mix_documents(documents([(1, None), (2, ""), (None, "  ")])).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in blank] == [(0, 0, 0.0, 0)] * 3


def test_dual_meets_targets(spark):
    sizes = spark.createDataFrame([("a", s, 1 + s % 3) for s in range(1, 300)] + [("b", s, 2) for s in range(1, 50)],
                                  "source string, size long, n long")
    total = {"a": sum(s * (1 + s % 3) for s in range(1, 300)), "b": sum(2 * s for s in range(1, 50))}
    for share in (0.3, 1.999):
        targets = mixing.source_targets(sizes).withColumn("target", F.col("source_size") * share)
        for row in mixing.solve_dual(sizes, targets).collect():
            cells = sizes.where(F.col("source") == row.source).collect()
            rates = [min(2.0, math.exp(min(1, row.multiplier * c["size"] / row["mean"]))) for c in cells]
            met = sum(r * c["size"] * c.n for r, c in zip(rates, cells))
            assert met == pytest.approx(share * total[row.source], rel=1e-6)


def test_take_documents(documents):
    rows = [(i, "w " * (1 + i % 50), "en", "abc"[i % 3]) for i in range(300)]
    docs = documents(rows, extra=["map('a', 1) as m"])
    copies = Counter(r.doc_id for r in mixing.take_documents(docs).collect())
    assert set(copies.values()) <= {1, 2}
    words = sum(n * (1 + i % 50) for i, n in copies.items())
    assert abs(words - 1.5 * sum(1 + i % 50 for i in range(300))) <= 10


# --- near duplicates

def plain_components(rows, width, num, den):
    def shingles(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return frozenset()
        return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and den * shared >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r[0])
    least = {k: min(v, key=lambda x: (x is None, x or 0)) for k, v in low.items()}
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows(prose):
    rng = random.Random(9)
    rows = [(i, prose(i, rng.randrange(1, 150), 500)) for i in range(100)]
    rows += [(200 + i, edited(rng, prose(3, 140), rng.randrange(12))) for i in range(60)]  # around the threshold
    rows += [(300 + i, edited(rng, prose(4, 20), rng.randrange(2))) for i in range(30)]
    common = prose(5, 60)
    rows += [(400 + i, common + " " + prose(400 + i, rng.randrange(1, 40))) for i in range(40)]  # a shared passage
    return rows + [(500, "Two Words"), (501, "two words"), (502, "two"), (502, "two words")]


def test_near_duplicates_by_brute_force(documents, prose, odd_rows):
    width, num, den, hubs = 3, 85, 100, 2
    rows = near_rows(prose) + [(1000 + i if i is not None else None, t) for i, t, *_ in odd_rows]
    found = near_dup.near_duplicates(documents(rows), width, num, den, hubs=hubs).collect()
    assert Counter((r.doc_id, r.n, r.component_id) for r in found) == plain_components(rows, width, num, den)


def test_mark_and_keep(documents, prose, odd_rows):
    rows = [(10_000 + i, t) for i, t in near_rows(prose)[80:120]] + odd_rows
    docs = documents(rows, extra=["1 as n", "2 as fp", "map('a', 1) as m"])
    marked = near_dup.mark_documents(docs).collect()
    assert len(marked) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in marked)
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in marked}
    assert groups <= {r.doc_id for r in kept.collect()} | {None}
    assert kept.where("doc_id = 4").count() == 1
    assert near_dup.mark_documents(docs.limit(0)).collect() == []
    assert near_dup.keep_first(docs.limit(0)).collect() == []


def test_overlap_floor():
    assert near_dup.overlap_floor(64, 85, 100) == 34


# --- neighbours

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(1500, 12)).astype(np.float32)
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    rows += [(2000 + i, points[100].tolist(), 0) for i in range(30)]
    rows += [(5000, None, 0), (5100, [0.0] * 12, 0), (5200, [float("nan")] * 12, 0), (None, points[3].tolist(), 0),
             (5300, [1.0, None] + [0.0] * 10, 0), (5400, [1.0], 0), (5500, [float("inf")] * 12, 0), (5600, [], 0)]
    small = neighbours.Settings(block=128, trees=3, settled=0.5, beam=96, opened=32, bucket=256)
    found = neighbours.nearest(vectors(spark, rows), "vec_id", "embedding", lambda i: i % 100 == 0, s=small).collect()
    names = np.array([r[0] for r in rows[:1530]])
    x = np.array([r[1] for r in rows[:1530]], np.float64)
    hits = 0
    for query in [i for i in names.tolist() if i % 100 == 0]:
        mine = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == query)
        assert [m[0] for m in mine] == list(range(1, 11))
        far = np.sqrt(((x - x[names == query][0]) ** 2).sum(1))
        others = names != query
        order = np.lexsort((names[others], far[others]))[:10]
        hits += len(set(names[others][order].tolist()) & {m[1] for m in mine})
        for _, vec_id, score in mine:
            assert score == pytest.approx(far[names == vec_id][0], abs=1e-12)
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (m[1], m[0]))
    queries = [i for i in names.tolist() if i % 100 == 0]
    assert hits / (10 * len(queries)) >= 0.95
    copies = sorted((r["rank"], r.vec_id) for r in found if r.query_id == 100)
    assert [c[1] for c in copies] == list(range(2000, 2010))


def test_nearest_ties_go_to_smaller_ids(spark):
    """Unit vectors along both ways of 64 axes: all but the opposite one are at the same distance."""
    sides = [[float(sign) if j == axis else 0.0 for j in range(64)] for axis in range(64) for sign in (1, -1)]
    found = neighbours.search_embeddings(vectors(spark, [(i, side, 0) for i, side in enumerate(sides)])).collect()
    for query, wanted in ((0, list(range(2, 12))), (100, list(range(10)))):
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == query] == wanted


def test_nearest_small_tables(spark):
    few = vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (100, [1.0, 1.0], 0)])
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search_embeddings(few).collect())
    assert found == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert neighbours.search_embeddings(few.limit(0)).collect() == []
    assert neighbours.search_embeddings(vectors(spark, [(0, None, 0), (1, [0.0], 0)])).collect() == []
    assert neighbours.search_embeddings(vectors(spark, [(0, [2.0], 0)])).collect() == []


# --- pipeline

def test_pipeline(spark, documents, prose, odd_rows):
    clean = [(10 + i, prose(i, 120) + "\nShared footer of the archive, page number one of this edition\n" + prose(700 + i, 30), "en",
              "abc"[i % 3]) for i in range(60)]
    near = [(500 + i, clean[0][1] + f" tail{i}", "en", "a") for i in range(5)]
    docs = documents(clean + near + odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.save(stage(spark, docs, ""), name)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "quality_rules":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in clean + near} | {None, 3, 4, 5}
        if name == "line_dedup":
            assert not out.where(F.col("text").contains("Shared footer") & (F.col("doc_id") >= 11) & (F.col("doc_id") < 100)).count()
            assert out.where("n_chars <> char_length(text)").isEmpty()
        if name == "near_dedup":
            ids = {r.doc_id for r in out.collect()}
            assert {r[0] for r in clean} | {3, 4} == ids
        docs = out
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(tokens) == docs.count() and all(len(r.ids) == 4 * r.n_tokens for r in tokens)
    empty = documents(clean).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []

"""Main text of pages: the tree, the choice against brute force, held-out accuracy."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest

from flowstrata.llm import html_extract
from flowstrata.llm.html_extract import parse
from flowstrata.llm.page_maker import PageMaker


@pytest.fixture(scope="session")
def forest(spark):
    return html_extract.fit_forest(spark, pages=500, trees=25)


def texts(page):
    kept = np.ones(len(page.tags), bool)
    return html_extract.texts_of([page], kept)[0]


def shape(source):
    page = parse(source)
    return [(tag, page.parents[i]) for i, tag in enumerate(page.tags)][1:]


# --- the tree

def test_implied_ends():
    assert shape("<body><p>a<p>b<div>c</div>") == [("body", 0), ("p", 1), ("p", 1), ("div", 1)]
    assert shape("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [
        ("ul", 0), ("li", 1), ("ul", 2), ("li", 3), ("li", 3), ("li", 1)]
    assert shape("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>d</table><p>") == [
        ("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 5), ("table", 6), ("tr", 7), ("td", 8), ("p", 0)]
    assert shape("<dl><dt>a<dd>b<dt>c</dl>") == [("dl", 0), ("dt", 1), ("dd", 1), ("dt", 1)]
    # Stray ends close nothing they stand outside of.
    assert shape("<div></p></span><table><tr><td></div><p>x</table><p>y") == [
        ("div", 0), ("table", 1), ("tr", 2), ("td", 3), ("p", 4), ("p", 1)]
    assert shape("<div><b>a<p>b</b>c</p></div><p>d") == [("div", 0), ("p", 1), ("p", 0)]
    assert shape("<p><b class=x>a</b><i>b</i><p id='c'>") == [("p", 0), ("b", 1), ("p", 0)]


@pytest.mark.parametrize(("source", "wanted"), [
    ("a <b>b</b>c<br>d", "a bc d"), ("<p>a\n\t b&nbsp;c </p>\n<p>d</p>", "a b c d"), ("x&amp;y &lt;p&gt; &copy &am", "x&y <p> © &am"),
    ("<script>var t='</p>';</script>a<style>b</style><!-- c --><textarea>d</textarea><noscript>e</noscript>", "a"),
    ("<title>t</title><p>a", "a"), ("<head><title>t</title><p>a", "a"), ("<head>stray", "stray"), ("a<script>never ends", "a"),
    ("a<!-- never ends", "a"), ("a < b > c", "a < b > c"), ('<a title="x>y" href=z>k</a>', "k"), ("<p title='a>b</p>", "b"),
    ("<select><option>a<option>b</select>c<svg><text>d</text></svg>", "c"), ("", ""), ("<", "<"), ("</", "</"), ("<p", ""),
    ("<!DOCTYPE html><?x y?>a", "a"), ("a<!---->b<!-->c", "abc"), ("\x00\x1c퟿a", "\x00 ퟿a"),
])
def test_texts(source, wanted):
    assert texts(parse(source)) == wanted


def test_time_grows_with_length():
    for part in ("<div>", "<p><b>", "<li><ul>", "<a href=\"x", "<!--", "</div>", "<td><p><span>", "<", "<table><tr>", "<p a='", "<b></p>"):
        times = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            parse(part * n + "end")
            times.append(time.perf_counter() - began)
        assert times[1] < 12 * times[0] + 0.5, (part, times)


def test_names():
    assert html_extract.names_in(' class="MainMenu x" id=cookieBar') == 1 | 2 | 1 << 6
    assert html_extract.names_in(' href="/article" data-y="in"') == 0


# --- the choice

def test_choice_by_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(1, 8)
        parent = np.array([-1, *(rng.randrange(i) for i in range(1, n))])
        odds, weight = np.array([rng.uniform(-3, 3) for _ in range(n)]), np.array([rng.choice([0.1, 1, 2]) for _ in range(n)])
        best = None
        for state in itertools.product((0, 1, 2), repeat=n):
            moves = [(0 if p < 0 else state[p], s) for p, s in zip(parent, state, strict=True)]
            if any(m not in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2)) for m in moves):
                continue
            score = sum(weight[i] * odds[i] * (1 if s == 1 else -1) for i, s in enumerate(state))
            score -= 0.7 * sum(a != b for a, b in moves)
            best = score if best is None else max(best, score)
        kept = html_extract.decide(odds, weight, parent, html_extract._levels(parent), 0.7)
        state = []
        for i, p in enumerate(parent):
            above = 0 if p < 0 else state[p]
            state.append(1 if kept[i] else 0 if above == 0 else 2)
            assert not (kept[i] and above == 2)
        moves = [(0 if p < 0 else state[p], s) for p, s in zip(parent, state, strict=True)]
        score = sum(weight[i] * odds[i] * (1 if s == 1 else -1) for i, s in enumerate(state))
        assert score - 0.7 * sum(a != b for a, b in moves) == pytest.approx(best)


def test_forest_is_sparks_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    html_extract._FITTED.clear()
    forest = html_extract.fit_forest(spark, pages=40, trees=4, depth=3)
    nodes = html_extract.labelled_nodes(spark, 40, html_extract.SEED)
    model = GBTClassifier(maxIter=4, maxDepth=3, stepSize=html_extract.STEP, maxBins=html_extract.BINS, seed=html_extract.SEED).fit(
        nodes.select("label", array_to_vector("features").alias("features")))
    rows = nodes.withColumn("_raw", array_to_vector("features")).collect()
    mine = forest.odds(np.array([r["features"] for r in rows]))
    theirs = [model.predictRaw(r["_raw"])[1] for r in rows[:300]]
    assert np.allclose(mine[:300], np.array(theirs) * 2, atol=1e-9) or np.allclose(mine[:300], theirs, atol=1e-9)


def test_held_out_accuracy(forest):
    makers = [PageMaker(77_000_000 + i) for i in range(700)]
    made = [m.page() for m in makers]
    found = html_extract.main_texts([source for source, _ in made], forest)
    shares = []
    for maker, text, (_, wanted) in zip(makers, found, made, strict=True):
        if maker.naming != "bare":  # without any names the article is a matter of taste
            a, b = Counter(text.split()), Counter(wanted.split())
            shares.append((text == wanted, 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))))
    assert np.mean([s for s, _ in shares]) > 0.93
    assert np.mean([s for _, s in shares]) > 0.99


PAGE = """<!DOCTYPE html><html lang=en><head><title>No</title><script>track("</p>")</script></head><body>
<header class=masthead><a href="/">Paper of Record</a><form class=search><label>Find</label><input><button>Go</button></form></header>
<nav><ul><li><a href=/a>World</a><li><a href=/b>Sport</a></ul></nav>
<div class="cookie-consent"><p>We use cookies to make this page work better for you. Please accept them.</p></div>
<main><article class=story><h1>Rivers &amp; lakes</h1><p>Rain fell for days, and <a href=/r>rivers</a> rose over their banks.
<p>Some   towns were cut off&#46; Help came by boat.<div class="ad">Buy boots now, they are cheap.</div>
<ul><li>First aid</li><li>Food</li></ul><p>The water fell on Monday.</p>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I live there and it was awful, we lost it all.</p></div></section></article>
<aside class="sidebar"><h3>More</h3><p>Snow is on its way, say those who know such things.</p></aside></main>
<footer>&copy; Paper of Record. All rights are with us, and so on.</footer></body></html>"""


def test_a_page(spark, forest):
    wanted = ("Rivers & lakes Rain fell for days, and rivers rose over their banks. Some towns were cut off. Help came by boat. "
              "First aid Food The water fell on Monday.")
    df = spark.createDataFrame([(1, PAGE, "u", "x"), (1, PAGE, "u", "x"), (2, None, None, "x"), (None, "", "v", None)],
                               "page_id long, html string, url string, text string")
    rows = html_extract.extract(df, forest).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"]) for r in rows) == [
        (0, "v", ""), (1, "u", wanted), (1, "u", wanted), (2, "", "")]
    assert html_extract.extract(df, forest).columns == ["page_id", "html", "url", "text"]
    assert html_extract.extract(df, forest, into="main text").columns == ["page_id", "html", "url", "text", "main text"]
    assert html_extract.extract(df.where("false"), forest).collect() == []


def test_long_and_deep_pages(spark, forest):
    body = "".join(f"<p>Word{i} and more of it, here.</p>" for i in range(20_000))
    deep = "<div>" * 5_000 + "x" + "</div>" * 5_000
    pages = [f"<nav><a href=/>Menu</a></nav><article><h1>T</h1>{body}</article><footer>Foot</footer>", deep, "x" * 1_000_000]
    found = html_extract.main_texts(pages, forest)
    assert found[0] == "T " + " ".join(f"Word{i} and more of it, here." for i in range(20_000))
    assert found[1] in ("", "x") and found[2] in ("", "x" * 1_000_000)


def test_query_on_pages(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "fit_forest", lambda spark, fit=html_extract.fit_forest: fit(spark, pages=500, trees=25))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = html_extract.extract_pages(pages).collect()
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(sources)
    for r in rows:
        article = sources[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["text"] == texts(parse(article))
        assert r["n_chars"] == len(r["text"])

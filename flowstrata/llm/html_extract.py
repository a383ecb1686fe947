"""Main text of web pages: gradient-boosted trees over DOM nodes, then a hierarchical choice.

A page becomes a tree of its elements (implied ends, void and raw-text elements as browsers have them). Each node gets
features of its subtree, attribute names, place, siblings and ancestors; boosted trees give it odds of being main text.
The choice is made for the whole tree at once: along every path from the root, nodes are outside, then inside the main
text, then taken out again, with the best sum of odds. So nothing is kept below something that was taken out, and a weak
block stays where its surroundings do.

The trees are fitted by Spark on labelled pages (``page_maker``), a bounded number; they depend on the parameters alone
and not on the table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import bound_batches
from .page_maker import PageMaker

TRAINING_PAGES = 1_500  # bound of the labelled sample
TREES, DEPTH, STEP, BINS, SEED = 40, 5, 0.25, 64, 7
SWITCH = 0.5  # log odds that entering or leaving the main text costs

# Groups of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNREAD = RAW | frozenset("head noscript template svg math select datalist button audio video canvas object".split())
IN_HEAD = frozenset("meta link base basefont bgsound script style title noscript template noframes head html".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul dt dd".split()
)
BLOCKS = CLOSES_P | frozenset("html body caption colgroup label legend optgroup tbody td tfoot th thead tr".split())
KINDS = (
    ("article", "main"), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset", "label", "legend", "dialog"),
    ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"),
    ("table", "tbody", "thead", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption", "address", "details"),
    ("html", "body"),
)
# Parts of attribute values, by what they tell.
TOKENS = (
    "article content main post entry story body text blog single",
    "nav navigation navbar menu breadcrumb breadcrumbs toc pager pagination tabs topnav topbar skip",
    "header footer masthead logo copyright colophon bottom top foot head legal imprint banner contentinfo",
    "sidebar side aside widget related recommended recommendations teaser popular trending rail complementary more",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsbygoogle commercial",
    "comment comments commentlist disqus reply replies respond discussion feedback guestbook",
    "cookie cookies notice consent gdpr alert popup modal overlay dialog warning disclaimer newsletter subscribe signup paywall",
    "share sharing social tags byline meta author date toolbar tools print follow",
    "form search login input contact poll register",
)
_KIND = {tag: number for number, tags in enumerate(KINDS) for tag in tags}
_TOKEN = {token: 1 << number for number, group in enumerate(TOKENS) for token in group.split()}

_MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/([a-zA-Z][^\s/>]*+)[^>]*+>?"""
    r"""|([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>?)""", re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKED = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in page order, parents first. ``pieces``: node, block and text of each stretch of text, in page order."""

    tags: list[str]
    parents: list[int]
    attributes: list[str]
    elements: list[int]  # of each node's own, phrase elements without a name among them
    linked: list[int]  # characters in links
    pieces: list[tuple[int, int, str]]


def parse(source: str) -> Page:
    """The page's tree. Any text is a page; time and memory grow with its length."""
    tags, parents, attributes, elements, linked, pieces = ["html"], [-1], [""], [1], [0], []
    # Open elements: tag, node, unread, link, then the places of what an implied end may close, up to its scope:
    # p, li, dt or dd, cell, row; the scope of other ends, and the nearest block.
    stack, places, block, at = [("html", 0, False, False, -1, -1, -1, -1, -1, 0, 0)], {}, 0, 0

    def close(index: int) -> None:
        while len(stack) > index:
            places[stack.pop()[0]].pop()

    def read(text: str) -> None:
        if stack[-1][0] == "head" and text and not text.isspace():
            close(len(stack) - 1)
        node, unread, link = stack[-1][1:4]
        if text and not unread:
            text = html.unescape(text)
            if link:
                linked[node] += len(text)
            pieces.append((node, block, text))

    while True:
        found = _MARKUP.search(source, at)
        if not found:
            read(source[at:])
            break
        if found.start() > at:
            read(source[at : found.start()])
        at = found.end()
        ended, started, attribute = found.groups()
        if ended:
            tag = ended.lower()
            if tag in BLOCKS or tag == "br":
                block += 1
            if tag in ("html", "body") or not places.get(tag):
                continue
            index, top = places[tag][-1], stack[-1]
            if index >= (top[9] if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") else 0) and (
                    tag in BLOCKS or tag in UNREAD or index > top[10]):
                close(index)
            continue
        if not started:
            continue
        tag = started.lower()
        if tag in ("html", "body"):
            if tag == "body" and places.get("head"):
                close(places["head"][-1])
            if tag == "body" and places.get("body"):
                continue
            if tag == "html":
                attributes[0] = attributes[0] or attribute
                continue
        elif places.get("head") and stack[-1][0] == "head" and tag not in IN_HEAD:
            close(places["head"][-1])
        top = stack[-1]
        if tag in CLOSES_P and top[4] >= 0:
            close(top[4])
            top = stack[-1]
        target = {"li": top[5], "dt": top[6], "dd": top[6], "td": top[7], "th": top[7], "tr": top[8]}.get(tag, -1)
        if tag in ("tbody", "thead", "tfoot"):
            target = top[8]
        if target >= 0:
            close(target)
            top = stack[-1]
        boxed = tag in BLOCKS
        if boxed or tag == "br":
            block += 1
        node = top[1]
        if not top[2]:
            elements[node] += 1
            if boxed and tag != "hr" or tag not in VOID and tag not in UNREAD and _NAMES.search(attribute):
                node = len(tags)
                tags.append(tag)
                parents.append(top[1])
                attributes.append(attribute)
                elements.append(1)
                linked.append(0)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(source, at)
            if not end:
                break
            at = source.find(">", end.end()) + 1 or len(source)
            continue
        index = len(stack)
        places.setdefault(tag, []).append(index)
        p, li, d, cell, row, scope, nearest = top[4:]
        if tag in ("table", "td", "th", "caption"):
            p, li, d, scope = -1, -1, -1, index
        if tag == "table":
            cell, row = -1, -1
        elif tag in ("td", "th"):
            cell = index
        elif tag == "tr":
            cell, row = -1, index
        elif tag == "p":
            p = index
        elif tag in ("ul", "ol", "menu"):
            li = -1
        elif tag == "li":
            li = index
        elif tag == "dl":
            d = -1
        elif tag in ("dt", "dd"):
            d = index
        stack.append((tag, node, top[2] or tag in UNREAD, top[3] or tag == "a", p, li, d, cell, row, scope,
                      index if boxed else nearest))
    return Page(tags, parents, attributes, elements, linked, pieces)


def names_in(attributes: str) -> int:
    """Groups of ``TOKENS`` named in class, id, role and the like, as bits."""
    if not attributes:
        return 0
    bits = 0
    for value in _NAMES.findall(attributes):
        for part in _PART.findall("".join(value)):
            bits |= _TOKEN.get(part.lower(), 0)
    return bits


def _nodes(pages: list[Page]) -> dict[str, np.ndarray]:
    """Columns over the nodes of all pages, parents as positions among them."""
    sizes = np.array([len(p.tags) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.array([x for p in pages for x in p.parents], np.int64)
    parent = np.where(own < 0, -1, own + first)
    chars, words, marks, texts = (np.zeros(len(own)) for _ in range(4))
    base = 0
    for page in pages:
        for node, _, text in page.pieces:
            parts = text.split()
            if parts:
                chars[base + node] += sum(map(len, parts)) + len(parts) - 1
                words[base + node] += len(parts)
                marks[base + node] += len(_MARKED.findall(text))
                texts[base + node] += 1
        base += len(page.tags)
    return {
        "first": first, "parent": parent, "chars": chars, "words": words, "marks": marks, "texts": texts,
        "elements": np.array([x for p in pages for x in p.elements], float),
        "linked": np.array([x for p in pages for x in p.linked], float),
        "kind": np.array([_KIND.get(t, len(KINDS)) for p in pages for t in p.tags], np.int64),
        "names": np.array([names_in(a) for p in pages for a in p.attributes], np.int64),
    }


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth, the roots first."""
    level, levels = np.flatnonzero(parent < 0), []
    order = np.argsort(parent, kind="stable")
    bounds = np.searchsorted(parent[order], np.arange(len(parent) + 1))
    while len(level):
        levels.append(level)
        counts = bounds[level + 1] - bounds[level]
        place = np.repeat(bounds[level] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        level = order[place]
    return levels


def features(pages: list[Page]) -> tuple[np.ndarray, dict[str, np.ndarray], list[np.ndarray]]:
    """One row of numbers per node; the node columns; the nodes by depth."""
    n = _nodes(pages)
    parent, levels = n["parent"], _levels(n["parent"])
    up = np.maximum(parent, 0)
    sums = {k: n[k].copy() for k in ("chars", "words", "marks", "texts", "elements", "linked")}
    sums |= {f"kind{k}": (n["kind"] == k).astype(float) for k in (5, 8, 11)}
    sums["nodes"] = np.ones(len(parent))
    depth, kinds, names = np.zeros(len(parent)), np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
    for level in levels[:0:-1]:
        for column in sums.values():
            np.add.at(column, parent[level], column[level])
    for level in levels[1:]:
        above = parent[level]
        depth[level] = depth[above] + 1
        kinds[level] = kinds[above] | 1 << n["kind"][above]
        names[level] = names[above] | n["names"][above]
    # Siblings stand in page order: sort by parent, then place.
    order = np.argsort(parent, kind="stable")
    same = np.r_[False, parent[order][1:] == parent[order][:-1]] & (parent[order] >= 0)
    before, after = np.full(len(parent), -1), np.full(len(parent), -1)
    before[order[1:][same[1:]]] = order[:-1][same[1:]]
    after[order[:-1][same[1:]]] = order[1:][same[1:]]
    group = np.cumsum(~same) - 1
    head = np.flatnonzero(~same)
    place, siblings = np.empty(len(parent)), np.empty(len(parent))
    place[order] = np.arange(len(parent)) - head[group]
    siblings[order] = np.bincount(group)[group]

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    linked, length = ratio(sums["linked"], sums["chars"]), np.log1p(sums["chars"])
    whole = sums["chars"][n["first"]]
    columns = [
        length, np.log1p(n["chars"]), np.log1p(sums["words"]), linked, ratio(n["linked"], n["chars"]),
        np.log1p(sums["elements"]), np.log1p(ratio(sums["chars"], sums["elements"])), ratio(sums["marks"], sums["words"]),
        ratio(sums["chars"], whole), ratio(sums["words"], sums["texts"]), np.log1p(sums["kind8"]), np.log1p(sums["kind5"]),
        np.log1p(sums["kind11"]), depth, ratio(np.arange(len(parent)) - n["first"], sums["nodes"][n["first"]]),
        place, siblings, length[up] * (parent >= 0), linked[up] * (parent >= 0), ratio(sums["chars"], sums["chars"][up]),
    ]
    for other in (before, after):
        there, at = other >= 0, np.maximum(other, 0)
        columns += [np.where(there, length[at], -1), np.where(there, linked[at], -1), np.where(there, n["kind"][at] == n["kind"], False)]
    columns += [n["kind"] == k for k in range(len(KINDS) + 1)]
    columns += [kinds >> k & 1 for k in (0, 1, 2, 3, 4, 5)]
    columns += [(bits >> k) & 1 for bits in (n["names"], names) for k in range(len(TOKENS))]
    return np.stack([np.asarray(c, float) for c in columns], axis=1), n, levels


@dataclass(frozen=True)
class Forest:
    """Boosted trees as arrays, one row a tree: split feature (-1 at a leaf), threshold, children, prediction."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(len(self.feature)):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                split = self.feature[t][at]
                left = rows[every, np.maximum(split, 0)] <= self.threshold[t][at]
                at = np.where(split < 0, at, np.where(left, self.left[t][at], self.right[t][at]))
            total += self.value[t][at]
        return 2 * total


def _labels(page: Page) -> list[float]:
    found = []
    for parent, attribute in zip(page.parents, page.attributes, strict=True):
        inherited = found[parent] if parent >= 0 else 0.0
        found.append(1.0 if 'data-y="in"' in attribute else 0.0 if 'data-y="out"' in attribute else inherited)
    return found


def labelled_nodes(spark: SparkSession, pages: int, seed: int) -> DataFrame:
    """label and features of every node of ``pages`` made pages, built in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            if numbers:
                made = [parse(PageMaker(seed * 1_000_003 + number).page()[0]) for number in numbers]
                rows = features(made)[0]
                labels = [label for page in made for label in _labels(page)]
                yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(rows.tolist())], names=["label", "features"])

    return spark.range(0, pages, 1, 8).mapInArrow(run, "label double, features array<double>")


_FITTED: dict[tuple, Forest] = {}


def fit_forest(spark: SparkSession, pages: int = TRAINING_PAGES, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Trees fitted by Spark on ``pages`` labelled pages, some 40 nodes each; at most ``trees`` times ``2 ** depth`` leaves."""
    key = (pages, trees, depth, seed)
    if key not in _FITTED:
        nodes = labelled_nodes(spark, pages, seed).select("label", array_to_vector("features").alias("features"))
        booster = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=STEP, maxBins=BINS, seed=seed, cacheNodeIds=False)
        model = booster.fit(nodes)
        path = scratch_path(spark, "forest")
        model.write().save(path)
        stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*", "nodeData.split.*").collect()
        shape = (len(model.treeWeights), 1 + max(r["id"] for r in stored))
        feature, left, right = (np.full(shape, -1, np.int64) for _ in range(3))
        threshold, value = np.zeros(shape), np.zeros(shape)
        for r in stored:
            at = r["treeID"], r["id"]
            value[at] = r["prediction"] * model.treeWeights[r["treeID"]]
            if r["leftChild"] >= 0:
                feature[at], threshold[at] = r["featureIndex"], r["leftCategoriesOrThreshold"][0]
                left[at], right[at] = r["leftChild"], r["rightChild"]
        _FITTED[key] = Forest(feature, threshold, left, right, value, depth)
    return _FITTED[key]


def decide(odds: np.ndarray, weight: np.ndarray, parent: np.ndarray, levels: list[np.ndarray], switch: float = SWITCH) -> np.ndarray:
    """Which nodes are main text: the best of all choices that are outside, inside, then taken out along each path."""
    inside = weight * odds
    outside, out = -inside, -inside
    for level in levels[:0:-1]:
        above = parent[level]
        np.add.at(outside := outside.copy(), above, np.maximum(outside[level], inside[level] - switch))
        np.add.at(inside := inside.copy(), above, np.maximum(inside[level], out[level] - switch))
        np.add.at(out := out.copy(), above, out[level])
    state = np.zeros(len(odds), np.int8)  # 0 outside, 1 inside, 2 taken out
    for number, level in enumerate(levels):
        if not number:
            state[level] = inside[level] - switch > outside[level]
            continue
        above = state[parent[level]]
        enters = (above == 0) & (inside[level] - switch > outside[level])
        stays = (above == 1) & (inside[level] >= out[level] - switch)
        state[level] = np.where(enters | stays, 1, np.where(above == 0, 0, 2))
    return state == 1


def texts_of(pages: list[Page], kept: np.ndarray) -> list[str]:
    """The kept text of each page: white space in a block as one space, blocks joined by one space."""
    found, base = [], 0
    for page in pages:
        own, blocks = kept[base : base + len(page.tags)].tolist(), {}
        base += len(page.tags)
        for node, block, text in page.pieces:
            if own[node]:
                blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        found.append(" ".join(text for text in joined if text))
    return found


def main_texts(sources: list[str], forest: Forest, switch: float = SWITCH) -> list[str]:
    """The main text of each page."""
    pages = [parse(source) for source in sources]
    if not pages:
        return []
    rows, nodes, levels = features(pages)
    weight = np.where(nodes["chars"] > 0, 0.5 + np.log1p(nodes["chars"]) / 4, 0.1)
    return texts_of(pages, decide(forest.odds(rows), weight, nodes["parent"], levels, switch))


def extract(pages: DataFrame, forest: Forest, markup: str = "html", into: str = "text", switch: float = SWITCH) -> DataFrame:
    """Every row with its page's main text in column ``into`` (added last, or replaced): empty without any.

    Null and empty pages have no text. Rows are judged one by one, so repeated ones come back as often as they occur; an
    empty table gives no rows. Columns of any name and type pass through. No shuffle.
    """
    bound_batches(pages.sparkSession)
    kept = [F.col(f"`{c}`") for c in pages.columns if c != into]
    fields = [f for f in pages.schema if f.name != into]
    schema = pages.select(*kept).schema.add("__llm_text", "string") if fields else "__llm_text string"
    carried = pages.select(*kept, F.coalesce(F.col(f"`{markup}`"), F.lit("")).alias("__llm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for start in range(0, batch.num_rows, 200):
                raw = batch.column(batch.num_columns - 1).slice(start, 200).cast(pa.binary()).to_pylist()
                texts += main_texts([r.decode(errors="replace") for r in raw], forest, switch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    return carried.mapInArrow(run, schema).withColumnRenamed("__llm_text", into)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    forest = fit_forest(pages.sparkSession)
    found = extract(pages.select("page_id", "url", "html"), forest).drop("html")
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))

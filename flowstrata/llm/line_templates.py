"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: token count, then the leading tokens, then the constant part. Tokens with digits are
variable fields (``<*>``). Every line reaches the leaf of its whole masked text. A line of eight tokens or more reaches
two further leaves, one for each half, in which the other half may vary as far as the leaf shows it: the free half is
compared in segments, and only where at most one of them differs among the leaf's lines is the leaf a template. So most
tokens of a template are constant, and a common opening alone makes none.

A template is dropped where it recurs in several documents. Copies don't count as several: lines of one document that
meet the same first or last document elsewhere are a bundle, and a document that is mostly bundles of two lines or more
is a copy. One line that recurs counts however much of its documents it fills.

Leaves are aggregates: what a common line brings together is counted before the shuffle, and no leaf is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, null_safe_join, save

LEADING = 2  # tokens that are levels of the tree
GENERAL_FROM = 8  # tokens of a line that has leaves for its halves, too
SEGMENTS = 4  # parts of a free half, of which at most one may vary
EVIDENCE = 20  # constant tokens seen again beyond the first document
HALF_EVIDENCE = 40  # the same for a template with a varying segment, in its fixed half alone
COPIED = 0.5  # share of a document's words in bundles beyond which it is a copy
FIELD = "<*>"  # a token with a digit
_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
_PARTS = [f"_s{i}" for i in range(SEGMENTS)]


def _masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, FIELD)).otherwise(line)


def template_lines(docs: DataFrame, doc: list[str], text: str = "text") -> DataFrame:
    """One row per line with a word and leaf that has a fixed token: the ``doc`` columns, ``_doc`` (their hash), ``no``
    (0-based line), ``leaf``, ``half`` (a leaf of a half), ``constant`` (fixed tokens of the leaf, without fields), hashes of
    the free half's segments, ``_n`` and ``_total`` (tokens of line and document)."""
    numbered = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("no"), _masked(x).alias("line")))
    filled = F.filter(numbered, lambda s: F.btrim(s["line"], F.lit(_BLANKS)) != "")
    tokens = F.size(F.split(F.btrim(text, F.lit(_BLANKS)), _SPACE))
    # Counted before the lines are taken apart, else it would be counted for each of them.
    whole = docs.select(*doc, F.xxhash64(*doc).alias("_doc"), tokens.alias("_total"), filled.alias("_lines"))
    lines = whole.select(*doc, "_doc", "_total", F.inline("_lines"))
    bare = F.btrim("line", F.lit(_BLANKS))
    lines = lines.select(*doc, "_doc", "_total", "no", F.contains("line", F.lit(FIELD)).alias("_masked"),
                         F.split(bare, _SPACE).alias("_t")).withColumn("_n", F.size("_t"))
    first = LEADING + F.expr(f"(_n - {LEADING} + 1) div 2").cast("int")

    def parts(start: Column, size: Column) -> list[Column]:
        """Hashes of a half's segments."""
        step = F.ceil(size / SEGMENTS).cast("int")
        return [F.xxhash64(F.slice("_t", start + step * i, F.greatest(F.least(step, size - step * i), F.lit(0)))) for i in range(SEGMENTS)]

    def constant(tokens: Column, size: Column) -> Column:
        return F.when(F.col("_masked"), F.size(F.array_remove(tokens, FIELD))).otherwise(size)

    lead = F.slice("_t", 1, LEADING)
    # Every token is hashed once here; the leaves' keys are made from these hashes.
    lines = lines.select(
        *doc, "_doc", "_total", "no", "_n", F.xxhash64(lead).alias("_lead"),
        *[c.alias(f"_m{i}") for i, c in enumerate(parts(F.lit(LEADING + 1), first - LEADING))],
        *[c.alias(f"_b{i}") for i, c in enumerate(parts(first + 1, F.col("_n") - first))],
        F.when(F.col("_n") < GENERAL_FROM, F.xxhash64("_t")).alias("_short"),
        constant(F.col("_t"), F.col("_n")).alias("_all"),
        constant(F.slice("_t", F.lit(1), first), first).alias("_front"),
        constant(F.concat(lead, F.slice("_t", first + 1, F.col("_n"))), F.col("_n") - first + LEADING).alias("_back"),
    )
    leaf = f"struct<leaf:bigint,half:boolean,constant:int,{','.join(f'{p}:int' for p in _PARTS)}>"
    middle, back = ([f"_{half}{i}" for i in range(SEGMENTS)] for half in "mb")

    def of(kind: int, fixed: list[str], tokens: str, free: list[str] | None = None) -> Column:
        key = F.xxhash64(F.lit(kind), "_n", *fixed)
        varying = [F.lit(0)] * SEGMENTS if free is None else [F.expr(f"CAST({c} & 2147483647 AS INT)") for c in free]
        return F.struct(key, F.lit(free is not None), F.col(tokens), *varying).cast(leaf)

    alone = F.array(of(0, ["_short"], "_all"))
    halves = F.array(of(0, ["_lead", *middle, *back], "_all"), of(1, ["_lead", *middle], "_front", back),
                     of(2, ["_lead", *back], "_back", middle))
    leaves = F.when(F.col("_n") < GENERAL_FROM, alone).otherwise(halves)
    # Fields alone don't make lines alike: such leaves are none.
    return lines.select(*doc, "_doc", "_total", "no", "_n", F.inline(leaves)).where("constant > 0")


def recurring_lines(docs: DataFrame, doc: list[str], text: str = "text") -> DataFrame:
    """The ``doc`` columns and ``__llm_dropped``, the array of line numbers whose template recurs."""
    # Hashes and counts only, no text: read twice below, so that texts are taken apart once.
    lines = save(template_lines(docs, doc, text), "template-lines")
    # A cheap pass first: most leaves are met in one document only.
    met = lines.groupBy("leaf").agg(
        F.min("_doc").alias("_low"), F.max("_doc").alias("_high"), F.min(doc[0]).alias("_from"), F.max(doc[0]).alias("_to")
    )
    # Stored, so that joins with it have an exchange of their own on both sides, which adaptive execution can split.
    met = save(met.where("_low <> _high").select("leaf", "_from", "_to"), "leaves")
    shared = save(lines.join(met, "leaf"), "lines")
    originals = _originals(shared)
    varying = sum(F.when(F.min(p) != F.max(p), 1).otherwise(0) for p in _PARTS)
    counts = shared.join(originals, "_doc").groupBy("leaf").agg(
        F.countDistinct("_doc").alias("docs"), F.max("constant").alias("constant"), F.max("half").alias("half"),
        varying.alias("varying"),
    )
    again = (F.col("docs") - 1) * F.col("constant")
    recurs = F.when(~F.col("half"), again >= EVIDENCE).otherwise((again >= HALF_EVIDENCE) & (F.col("varying") <= 1))
    templates = save(counts.where(recurs).select("leaf"), "templates")
    found = shared.select(*doc, "no", "leaf").join(templates, "leaf")
    return found.groupBy(*doc).agg(F.collect_set("no").alias("__llm_dropped"))


def _originals(shared: DataFrame) -> DataFrame:
    """``_doc`` of the documents that are no copies.

    The first (last) document that a line meets is a min-wise sample of the documents that hold it: lines that came by
    the same copying mostly agree in one of the two, lines that recur each for itself seldom do.
    """
    once = shared.groupBy("_doc", "no").agg(
        F.max("_n").alias("_n"), F.max("_total").alias("_total"), F.min("_from").alias("_from"), F.max("_to").alias("_to")
    )
    with_from, with_to = Window.partitionBy("_doc", "_from"), Window.partitionBy("_doc", "_to")
    alike = F.greatest(F.count(F.lit(1)).over(with_from), F.count(F.lit(1)).over(with_to))
    held = once.withColumn("_alike", alike).groupBy("_doc").agg(
        F.sum(F.when(F.col("_alike") > 1, F.col("_n")).otherwise(0)).alias("_copied"), F.max("_total").alias("_total")
    )
    return held.where(F.col("_copied") <= F.col("_total") * COPIED).select("_doc")


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without their lines of recurring templates; adds ``n_lines`` and ``n_dropped`` (longs).

    A document that would be left without a word is returned as it is: all its lines recur, so it is a copy rather
    than text with boilerplate, and that is for document dedup to decide. Null text stays null (0 lines), empty text
    stays empty (1 line). Repeated rows count as one document and are treated alike. Columns of the added names are
    replaced; all others stay.
    """
    marked = docs.withColumn("__llm_hash", F.xxhash64(text))
    doc = [key, "__llm_hash"]
    dropped = recurring_lines(marked.select(*doc, text), doc, text)
    joined = null_safe_join(marked, dropped, doc, "left")
    lines = F.split(F.col(text), "\n", -1)
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__llm_dropped", i)), "\n")
    cut = F.col("__llm_dropped").isNotNull() & rest.rlike(WORD)
    return joined.withColumns({
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint"),
        "n_dropped": F.when(cut, F.size("__llm_dropped")).otherwise(F.lit(0)).cast("bigint"),
        text: F.when(cut, rest).otherwise(F.col(text)),
    }).drop("__llm_hash", "__llm_dropped")


def clean_documents(docs: DataFrame) -> DataFrame:
    """Every document's text after line dedup."""
    return drop_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")

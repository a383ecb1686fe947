"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger (append-only Parquet) holds one row
for each blob and rule version that was scanned. A run scans only blobs that the ledger lacks for the current rule
version, appends their findings, and joins the ledger back to all paths. A run that dies before its append is
committed leaves the ledger as it was; the next run scans the same blobs again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..files import make_dirs
from ..session import scratch_path
from .common import bound_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, group whose length counts, least length, strings of which one must occur.

    ``hints`` are compared with the text as it is, or lower-cased where ``fold`` is set; without hints every text
    is searched.
    """

    kind: str
    pattern: re.Pattern
    group: int
    least: int
    hints: tuple[str, ...]
    fold: bool = False


# The kinds of the data contract, in its order, then further ones.
RULES = (
    Rule("assign", re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    ), 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key"), fold=True),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16, ("AKIA",)),
    Rule("hex", re.compile(r"[0-9a-f]+"), 0, 32, ()),
    # Up to the closing line, with or without headers of an encrypted key; of a key cut off, the lines that are there.
    Rule("pem", re.compile(
        r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
        r"(?:(?:[^-]|-(?!----))*+-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{40,76}(?![A-Za-z0-9+/=]))*+)"
    ), 0, 1, ("PRIVATE KEY-----",)),
    Rule("jwt", re.compile(r"(?<![\w-])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", re.A), 0, 1, ("eyJ",)),
    Rule("forge", re.compile(r"(?<!\w)gh[pousr]_[A-Za-z0-9]{36,}", re.A), 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """A digest of all that a rule says, so that changed rules scan every blob anew."""
    said = [(r.kind, r.pattern.pattern, r.pattern.flags, r.group, r.least, r.hints, r.fold) for r in rules]
    return hashlib.sha256(repr(said).encode()).hexdigest()[:16]


RULE_VERSION = version_of(RULES)
SALTS = 32  # parts that the versions of one blob are dealt into
_BASE = ("assign", "access", "hex")
# Runs of the hex alphabet long enough; the same spans as the pattern of ``hex`` with its least length.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

LEDGER = (
    "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "spans string, findings array<struct<kind:string,start:long,end:long>>"
)


def find_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then by the order of the rules; code points, end exclusive."""
    lowered = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only
    found = []
    for number, rule in enumerate(rules):
        if (rule.pattern.pattern, rule.least) == ("[0-9a-f]+", 32):
            found += [(m.start(), number, m.end()) for m in _LONG_HEX.finditer(text)]
            continue
        within = lowered if rule.fold else text
        if rule.hints and not any(hint in within for hint in rule.hints):
            continue
        for match in rule.pattern.finditer(text):
            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                found.append((match.start(), number, match.end()))
    return [(start, end, rules[number].kind) for start, number, end in sorted(found)]


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan_blobs(blobs: DataFrame, rule_version: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of distinct blobs, in ledger form. ``blobs``: blob, text."""
    bound_batches(blobs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                spans = find_spans(text or "", rules)
                base = [s for s in spans if s[2] in _BASE]
                counts = [sum(s[2] == kind for s in base) for kind in _BASE]
                digest = hashlib.sha256(_listed(base).encode()).hexdigest()
                rows = [{"kind": kind, "start": start, "end": end} for start, end, kind in spans]
                for column, value in zip(columns, (*counts, digest, _listed(spans), rows), strict=True):
                    column.append(value)
            version = pa.array([rule_version] * batch.num_rows, pa.string())
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            kinds.append(pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), version, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"],
            )

    return blobs.mapInArrow(run, LEDGER)


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``blob``, the SHA-256 of the text's UTF-8 bytes; null text has the address of the empty text."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))


def read_ledger(spark, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per blob scanned with the rule version, also where two runs have scanned the same blob."""
    ledger = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == rule_version)
    return ledger.dropDuplicates(["blob"])


def update_ledger(versions: DataFrame, ledger_path: str, text: str = "text", rule_version: str | None = None,
                  rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the blobs that the ledger lacks for these rules, and appends them.

    Copies are dropped before the shuffle (one row for each blob and task crosses it), so a text that a third of all
    versions share is no hot key. ``ledger_path`` is a folder that exists, empty at first.
    """
    spark = versions.sparkSession
    rule_version = rule_version or version_of(rules)
    contents = address(versions.select(F.col(text).alias("text")))
    blobs = contents.groupBy("blob").agg(F.first("text").alias("text"))
    known = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == rule_version).select("blob")
    unseen = blobs.join(known, "blob", "left_anti")
    _scan_blobs(unseen.select("blob", "text"), rule_version, rules).write.mode("append").parquet(ledger_path)


def scan(versions: DataFrame, paths: list[str], ledger_path: str, text: str = "text",
         rule_version: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every version of every path: the path columns, ``blob`` and the ledger's columns.

    Null and empty texts have no findings; repeated rows come back as often as they occur; an empty table gives no
    rows. Columns beside the named ones are not read; a path column may not be named like one of the results. The rule
    version is the rules' digest unless one is given. Only blobs with findings are joined back, and the versions of a
    blob are dealt into ``SALTS`` parts, so a text that a third of all versions share is no hot key.
    """
    if clash := sorted({"blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"} & {*paths}):
        raise ValueError(f"path columns named like results: {', '.join(clash)}")
    rule_version = rule_version or version_of(rules)
    update_ledger(versions, ledger_path, text, rule_version, rules)
    ledger = read_ledger(versions.sparkSession, ledger_path, rule_version).drop("rule_version")
    found = ledger.where(F.size("findings") > 0)
    salted = found.withColumn("__llm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    carried = address(versions.select(*paths, F.col(text).alias("__llm_text")), "__llm_text").drop("__llm_text")
    carried = carried.withColumn("__llm_salt", F.pmod(F.xxhash64(*paths), F.lit(SALTS)).cast("int"))
    joined = carried.join(salted, ["blob", "__llm_salt"], "left")
    # Every blob is in the ledger by now; one without a row here has no findings.
    nothing = {
        "n_assign": F.lit(0).cast("bigint"), "n_access": F.lit(0).cast("bigint"), "n_hex": F.lit(0).cast("bigint"),
        "base_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": F.lit(""),
        "findings": F.array().cast(ledger.schema["findings"].dataType),
    }
    return joined.select("blob", *paths, *(F.coalesce(F.col(c), other).alias(c) for c, other in nothing.items()))


def scan_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Digest of the findings in documents, one row each; without a ledger, a new one."""
    path = ledger_path or scratch_path(docs.sparkSession, "ledger")
    make_dirs(docs.sparkSession, path)
    return scan(docs, ["doc_id"], path).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )

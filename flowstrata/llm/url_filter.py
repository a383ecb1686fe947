"""URL filter: ordered host rules, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Fixed values of the data contract: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Production vocabulary. One strict term rejects; soft terms reject from LIMIT distinct ones on.
STRICT = (
    "porn", "porno", "xxx", "hentai", "escorts", "casino", "casinos", "viagra", "cialis", "spam", "warez",
    "malware", "phishing",
)
SOFT = (
    "ad", "ads", "adult", "bet", "bets", "bonus", "cheap", "click", "coupon", "crack", "dating", "deal", "farm",
    "free", "gambling", "loan", "loans", "nude", "pills", "poker", "prize", "sex", "slots", "torrent", "track",
    "tracker", "win", "winner",
)
LIMIT = 2


@dataclass(frozen=True)
class Vocabulary:
    """Terms of ASCII letters and digits, lower case. The weight of a strict term is the limit, of a soft one 1."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    limit: int = LIMIT

    def weights(self) -> dict[str, int]:
        return dict.fromkeys(self.soft, 1) | dict.fromkeys(self.strict, self.limit)


def _is_word(char: str) -> bool:
    return char.isascii() and char.isalnum()


def _automaton(weights: dict[str, int]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term, weight in weights.items():
        machine.add_word(term, (term, weight))
    machine.make_automaton()
    return machine


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((at for at in map(rest.find, "/?#") if at >= 0), default=len(rest))
    host, tail = rest[:end].encode().lower().decode(), rest[end:]
    stop = min((at for at in map(tail.find, "?#") if at >= 0), default=len(tail))
    return host, tail[:stop]


def match_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest fitting rule as ``(rule, verdict)``; ``rules``: path and verdict by host."""
    best = None
    suffix = host
    while suffix:
        for prefix, verdict in rules.get(suffix, ()):
            found = (len(suffix) + len(prefix), suffix + prefix, verdict)
            if path.startswith(prefix) and (best is None or found > best):
                best = found
        suffix = suffix.partition(".")[2]
    return best and best[1:]


def _hits(text: str, machine) -> dict[str, int]:
    """Distinct terms with their weights, where neither neighbour is an ASCII letter or digit."""
    found = {}
    for last, (term, weight) in machine.iter(text):
        first = last - len(term) + 1
        if (first == 0 or not _is_word(text[first - 1])) and (last + 1 == len(text) or not _is_word(text[last + 1])):
            found[term] = weight
    return found


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Adds ``host, path, rule, verdict, strict_terms, soft_terms`` to every row; columns of these names are replaced.

    Null urls and urls without ``://`` have an empty host and path; no rule fits them. Without a fitting rule the
    vocabulary decides on the whole url (A-Z lower-cased): ``block`` when the weights of its distinct terms reach the
    limit, else ``allow``. Rules and vocabulary are small parameters that go with the tasks; nothing is shuffled.
    """
    bound_batches(pages.sparkSession)
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    weights = vocabulary.weights()

    @F.pandas_udf(
        "host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>"
    )
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = _automaton(weights)
        for urls in batches:
            rows = []
            for value in urls:
                value = value if isinstance(value, str) else ""
                host, path = split_url(value)
                terms = _hits(value.encode().lower().decode(), machine) if weights else {}
                strict = sorted(t for t, w in terms.items() if w >= vocabulary.limit)
                soft = sorted(t for t, w in terms.items() if w < vocabulary.limit)
                fitting = match_rule(host, path, by_host)
                rule, verdict = fitting or (
                    None, "block" if sum(terms.values()) >= vocabulary.limit else "allow"
                )
                rows.append((host, path, rule, verdict, strict, soft))
            yield pd.DataFrame(
                rows, columns=["host", "path", "rule", "verdict", "strict_terms", "soft_terms"]
            )

    judged = pages.withColumn("__llm_judged", judge(F.col(url)))
    names = ["host", "path", "rule", "verdict", "strict_terms", "soft_terms"]
    return judged.withColumns({name: F.col(f"__llm_judged.{name}") for name in names}).drop("__llm_judged")


def judge_pages(pages: DataFrame) -> DataFrame:
    """Digest over pages: one row per page."""
    judged = filter_urls(pages.select("page_id", "url"))
    return judged.select(
        "page_id", "host", "path", "rule", "verdict",
        F.array_join("strict_terms", ",").alias("strict_terms"), F.array_join("soft_terms", ",").alias("soft_terms"),
    )

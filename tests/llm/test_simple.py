"""URL filter, licence scan, secret scan, byte BPE and sharding, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from flowstrata.llm import bpe, license_scan, secret_scan, sharding, url_filter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- URL filter

def judged(spark, urls, **options):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return {r.page_id: r for r in url_filter.filter_urls(rows, **options).collect()}


def test_url_rules(spark):
    urls = [
        "http://a.NET/x", "https://www.example.net/en/1", "https://example.net/de/1", "http://example.com/de/1",
        "http://notexample.com/de/1", "http://x.org/fr/1?q", "http://net/", "http://a.net?x", "http://a.net:80/x",
    ]
    found = judged(spark, urls)
    assert [(found[i].rule, found[i].verdict) for i in range(len(urls))] == [
        ("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"),
        (None, "allow"), ("org/fr/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow"),
    ]
    assert (found[0].host, found[0].path) == ("a.net", "/x")
    assert (found[7].host, found[7].path) == ("a.net", "")


def test_url_terms(spark):
    urls = [
        "http://casino-win.com/", "http://occasino.com/", "http://cheap.com/", "http://cheap.com/cheap",
        "http://cheap-pills.com/", "http://x.com/ADULT?free=1", "", None, "no scheme spam",
    ]
    found = judged(spark, urls)
    assert [found[i].verdict for i in range(len(urls))] == [
        "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "block"
    ]
    assert found[4].soft_terms == ["cheap", "pills"] and found[0].strict_terms == ["casino"]
    assert (found[7].host, found[7].path, found[7].rule) == ("", "", None)


def test_url_table_shapes(spark):
    rows = spark.createDataFrame([(1, "http://spam.com/", 5)], "page_id long, url string, verdict int")
    assert url_filter.filter_urls(rows).first().verdict == "block"
    assert url_filter.judge_pages(rows.limit(0)).collect() == []


# --- licence scan

def test_license_rules(documents):
    mit = license_scan.SENTENCES["MitGrant"] + "\nThe above copyright notice and this permission notice shall be included" \
        " in all copies or substantial portions of the Software."
    found = license_scan.recognise(documents([
        (1, "Hello there. Licensed under the Apache License,\nVersion 2.0. Bye."),
        (2, "Prose.\n  released UNDER the MIT  License!\nAll rights reserved."),
        (3, mit), (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "All rights reserved"),
        (8, "All rights reserved. All rights reserved.\nLicensed under the Apache License, Version 2.0.\nx"),
    ], extra=["1 as licenses_old", "2 as __llm_left"]))
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in found.collect()}
    assert got[1] == ([], [])  # a line end inside a sentence cuts it
    assert got[2] == (["MitRef", "AllRights"], ["MIT", "Proprietary"])
    assert got[3] == (["MitGrant", "MitNotice"], ["MIT"])
    assert got[4] == (["CcByNcRef"], ["CC-BY-NC-4.0"])
    assert got[5] == got[6] == ([], [])
    assert got[7] == (["AllRights"], ["Proprietary"])
    assert got[8] == (["AllRights", "AllRights", "ApacheRef"], ["Apache-2.0", "Proprietary"])


APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file"""


def led(text, sign):
    return "\n".join(f"{sign} {line}".rstrip() for line in text.split("\n"))


def test_license_wrapped_headers(documents):
    texts = {"Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "MIT": MIT, "BSD-2-Clause": BSD, "MPL-2.0": MPL}
    rows, wanted = [], []
    for name, text in texts.items():
        shapes = [text, text.replace("\n", "\r\n"), *(led(text, sign) for sign in ("#", "//", " *", ";;", "--", "dnl", "REM"))]
        for shape in [*shapes, f"/*\n{led(text, ' *')}\n */", f"<!--\n{text}\n-->\nx"]:
            rows.append((len(rows), shape))
            wanted.append(name)
    n = len(rows)
    rows += [
        (n, "Licensed under the Apache License,\nVersion 2.0. Bye."), (n + 1, "Licensed under the Apache License,\n\nVersion 2.0."),
        (n + 2, "x\nLicensed under CC BY 4.0\nAll rights reserved\ny"), (n + 3, "All rights\nreserved by us. Not all rights reserved."),
    ]
    wanted += ["Apache-2.0", "", "CC-BY-4.0,Proprietary", ""]
    found = {r.doc_id: r for r in license_scan.scan_documents(documents(rows)).collect()}
    assert [found[i].licenses for i in range(len(rows))] == wanted
    assert found[0].sentence_ids == "ApacheRef,ApacheYou,ApacheGet,ApacheAsIs,ApacheSee"


def plain_sentences(text, wrapped):
    """Known sentences of a text by one regular expression of all wordings."""
    leader = r"[ .!?:;-]*(?:(?:dnl|rem) )?"
    line_end = rf" ?[.!?:; -]*\n{leader}" if wrapped else r"\A\b\Z"
    known = [*license_scan.SENTENCES.items(), *(w for w in license_scan.WORDINGS if wrapped or "\n" not in w[1])]
    patterns, names = [], {}
    for number, (name, sentence) in enumerate(sorted(known, key=lambda k: -len(k[1]))):
        paragraphs = []
        for part in sentence.split("\n\n"):
            words = re.sub(r"[^a-z0-9.!?:;+-]+", " ", part.lower()).strip(" .!?:;").split()
            gaps = [rf"(?: ?[.!?:;]+(?: |{line_end}))" if w[-1] in ".!?:;" else rf"(?: | ?\n{leader})" if wrapped else " "
                    for w in words[:-1]]
            bare = [re.escape(w.rstrip(".!?:;")) for w in words]
            paragraphs.append("".join(a + b for a, b in zip(bare, [*gaps, ""], strict=True)))
        patterns.append(f"(?P<s{number}>" + rf" ?\n{leader}\n{leader}".join(paragraphs) + ")")
        names[f"s{number}"] = name
    begin, close = rf"(?:(?:^|\n){leader}|[.!?:;]+ [ .!?:;]*)", r"(?=[ .!?:;-]*(?:\n|\Z)|[ .!?:;]*[.!?:;] )"
    low = re.sub(r"[^a-z0-9.!?:;+\n-]+", " ", text.lower())
    return [names[m.lastgroup] for m in re.finditer(begin + "(?:" + "|".join(patterns) + ")" + close, low)]


def test_license_sentences_by_brute_force():
    rng = random.Random(21)
    known = [*license_scan.SENTENCES.values(), *(s for _, s in license_scan.WORDINGS)]
    for wrapped in (False, True):
        listed = [*license_scan.SENTENCES.items(), *(w for w in license_scan.WORDINGS if wrapped or "\n" not in w[1])]
        recogniser = license_scan.Recogniser(listed, license_scan.RULES, wrapped)
        met = 0
        for _ in range(400):
            text = ""
            for _ in range(rng.randrange(1, 7)):
                sentence = rng.choice(known) if rng.random() < 0.7 else "Some words of nobody's licence"
                if rng.random() < 0.3:
                    at = rng.choice([i for i, c in enumerate(sentence) if c == " "])
                    sentence = sentence[:at] + rng.choice(["\n", "\n * ", "\n# ", "\n\n", " or ", "  "]) + sentence[at + 1 :]
                text += sentence + rng.choice([". ", ".\n", "\n", "\n\n", "; ", " and ", "\n// ", ".\n\n", ". . "])
            wanted = plain_sentences(text, wrapped)
            met += len(wanted)
            assert recogniser.sentence_ids(text) == wanted, text
        assert met > 300


def test_license_long_rows_of_signs_take_linear_time():
    recogniser = license_scan.Recogniser([*license_scan.SENTENCES.items()], license_scan.RULES, True)
    for part in (". ", ".", "; \n", "\n", "- ."):
        start = time.monotonic()
        assert recogniser.sentence_ids(part * 100_000) == []
        assert time.monotonic() - start < 2


def test_license_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    assert license_scan.scan_documents(docs).count() == len(odd_rows)
    assert license_scan.scan_documents(docs.limit(0)).collect() == []


# --- secret scan

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def plain_spans(text):
    spans = []
    for number, (kind, pattern, group, least) in enumerate(BASE):
        spans += [(m.start(), number, m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def secret_texts():
    rng = random.Random(5)
    parts = ["password", "Token", "API_KEY", "apikey", " ", "=", ":", "'", '"', "abcdef12", "0123456789abcdef" * 2, "AKIA",
             "ABCDEFGH12345678", "é", "\n", "x", "ſecret", "/+=", "short"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]


def test_secret_spans_by_brute_force():
    for text in secret_texts():
        spans = [s for s in secret_scan.find_spans(text) if s[2] in ("assign", "access", "hex")]
        assert secret_scan._listed(spans) == plain_spans(text)


def test_secret_documents(documents, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(secret_texts()[:60])]
    found = secret_scan.scan_documents(documents(rows)).collect()
    assert len(found) == len(rows)
    wanted = Counter((r[0], hashlib.sha256(plain_spans(r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in found) == wanted


def test_secret_ledger_scans_only_unseen(spark, documents, tmp_path):
    ledger = str(tmp_path / "ledger")
    (tmp_path / "ledger").mkdir()
    text = "token = abcdefgh12345678"
    secret_scan.scan(documents([(1, text), (2, text), (3, "clean")]), ["doc_id"], ledger).collect()
    assert spark.read.parquet(ledger).count() == 2
    again = secret_scan.scan(documents([(1, text), (4, text), (5, "new")]), ["doc_id"], ledger).collect()
    assert spark.read.parquet(ledger).count() == 3
    assert {r.doc_id: r.n_assign for r in again} == {1: 1, 4: 1, 5: 0}
    secret_scan.scan(documents([(1, text)]), ["doc_id"], ledger, rule_version="next").collect()
    assert spark.read.parquet(ledger).count() == 4
    assert secret_scan.scan(documents([(1, text)]).limit(0), ["doc_id"], ledger).collect() == []


def test_secret_further_kinds():
    kinds = [s[2] for s in secret_scan.find_spans(
        "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY----- ghp_" + "Zq" * 20
        + " eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    )]
    assert kinds == ["pem", "forge", "jwt"]
    encrypted = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\nMIIE\n-----END RSA PRIVATE KEY-----"
    assert secret_scan.find_spans("x " + encrypted + " y") == [(2, 2 + len(encrypted), "pem")]
    cut_off = "-----BEGIN PRIVATE KEY-----\n" + "Ab1+" * 16 + "\n" + "Zz/9" * 16
    assert secret_scan.find_spans(cut_off + "\nand then some prose") == [(0, len(cut_off), "pem")]


def test_secret_changed_rules_scan_anew(spark, documents, tmp_path):
    ledger = str(tmp_path / "ledger")
    (tmp_path / "ledger").mkdir()
    docs = documents([(1, "token = abcdefgh12345678"), (2, "token = abcdefgh12345678"), (3, "key K-77")])
    first = secret_scan.scan(docs, ["doc_id"], ledger).collect()
    more = (*secret_scan.RULES, secret_scan.Rule("own", re.compile("K-[0-9]+"), 0, 1, ()))
    assert secret_scan.version_of(more) != secret_scan.RULE_VERSION
    second = secret_scan.scan(docs, ["doc_id"], ledger, rules=more).collect()
    assert {r.doc_id: r.spans for r in first} == {1: "assign:0:24", 2: "assign:0:24", 3: ""}
    assert {r.doc_id: r.spans for r in second} == {1: "assign:0:24", 2: "assign:0:24", 3: "own:4:8"}
    assert spark.read.parquet(ledger).count() == 4
    with pytest.raises(ValueError, match="spans"):
        secret_scan.scan(docs.withColumn("spans", F.lit(1)), ["doc_id", "spans"], ledger)


# --- byte BPE

def test_bpe_tree_equals_library(library):
    ranks, plain = library
    rng = random.Random(3)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, leaf=3, window=1)
    parts = ["a", "'", "re", "s", " ", "  ", "\n", "\t", "\x1c", "é", "!", "1", " ", "　", "日", "ll", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        ids = codec.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_documents(documents, odd_rows, library):
    plain = library[1]
    docs = documents(odd_rows, extra=["cast(1 as int) as ids", "map('a', 1) as m"])
    found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert [r.text or "" for r in bpe.decode(found, RANKS, public_tokenizers.PATTERN).collect()] == [r[1] or "" for r in odd_rows]
    for row in found.collect():
        ids = plain.encode_ordinary(row.text or "")
        assert row.n_tokens == len(ids) and row.m == {"a": 1}
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


# --- sharding

def jump(key, shards):
    last, at = -1, 0
    while at < shards:
        last = at
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        at = int(float(last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


@pytest.mark.parametrize("shards", [1, 8, 1000])
def test_jump_by_brute_force(spark, shards):
    ids = [*range(300), -1, 2**63 - 1, -(2**63)]
    rows = sharding.assign(spark.createDataFrame([(i,) for i in ids], "doc_id long"), ["doc_id"], shards).collect()
    for row in rows:
        key = xxhash.xxh64_intdigest(struct.pack("<q", row.doc_id), 42)
        assert (row.shard, row.grown_shard) == (jump(key, shards), jump(key, shards + 1))


def test_shard_documents(documents, odd_rows):
    rows = odd_rows + [(9, "same")] * 500 + [(i, "x") for i in range(20, 400)]
    found = sharding.shard_documents(documents(rows)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in found if r.doc_id == 9}) == 1
    assert all(r.grown_shard in (r.shard, 8) for r in found)
    again = sharding.shard_documents(documents(rows[::-1])).collect()
    assert Counter(again) == Counter(found)
    assert sharding.shard_documents(documents(rows).limit(0)).collect() == []


def test_write_shards(spark, documents, tmp_path):
    docs = documents([(i, f"text {i}") for i in range(50)], extra=["'x' as shard"])
    sharding.write_shards(docs, str(tmp_path / "out"), ["doc_id"], 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.where(F.col("shard") >= 4).isEmpty()

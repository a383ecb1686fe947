"""Licence recognition by sentences: known sentences become identifiers, ordered rules match identifier sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Identifier -> sentence, as licences word it. Compared in normal form (see ``Recogniser``).
SENTENCES = {
    "AgplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
                " Affero General Public License as published by the Free Software Foundation, either version 3 of the"
                " License, or (at your option) any later version",
    "AllRights": "All rights reserved",
    "ApacheRef": "Licensed under the Apache License, Version 2.0",
    "ApacheYou": "you may not use this file except in compliance with the License",
    "ApacheGet": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ApacheAsIs": "Unless required by applicable law or agreed to in writing, software distributed under the License"
                  " is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express"
                  " or implied",
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License",
    "BoostRef": "Distributed under the Boost Software License, Version 1.0",
    "BoostGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the"
                  " software and accompanying documentation covered by this license (the \"Software\") to use,"
                  " reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works"
                  " of the Software, and to permit third-parties to whom the Software is furnished to do so, all"
                  " subject to the following:",
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted"
                " provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and"
                 " the following disclaimer",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
                 " and the following disclaimer in the documentation and/or other materials provided with the"
                 " distribution",
    "BsdNames": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
                " promote products derived from this software without specific prior written permission",
    "Cc0Waive": "To the extent possible under law, the author has dedicated all copyright and related and neighboring"
                " rights to this software to the public domain worldwide",
    "CcByLong": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CcByNcLong": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CcBySaLong": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CcByRef": "Licensed under CC BY 4.0",
    "CcByNcRef": "Licensed under CC BY-NC 4.0",
    "CcBySaRef": "Licensed under CC BY-SA 4.0",
    "EplTerms": "This program and the accompanying materials are made available under the terms of the Eclipse Public"
                " License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Gpl2Free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU"
                " General Public License as published by the Free Software Foundation; either version 2 of the License,"
                " or (at your option) any later version",
    "GplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
               " General Public License as published by the Free Software Foundation, either version 3 of the"
               " License, or (at your option) any later version",
    "GplNoWarranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
                     " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "GplCopy": "See the GNU General Public License for more details",
    "Gpl3Ref": "This work is licensed under the GNU General Public License, version 3",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
                " hereby granted, provided that the above copyright notice and this permission notice appear in all"
                " copies",
    "LgplFree": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU"
                " Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the"
                " License, or (at your option) any later version",
    "MitRef": "Released under the MIT License",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
                " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
                " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
                " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
                " furnished to do so, subject to the following conditions:",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or"
                 " substantial portions of the Software",
    "Mpl2Ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at"
               " https://mozilla.org/MPL/2.0/",
    "SpdxAgpl3": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "SpdxApache2": "SPDX-License-Identifier: Apache-2.0",
    "SpdxBoost": "SPDX-License-Identifier: BSL-1.0",
    "SpdxBsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "SpdxBsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "SpdxCc0": "SPDX-License-Identifier: CC0-1.0",
    "SpdxEpl2": "SPDX-License-Identifier: EPL-2.0",
    "SpdxGpl2Only": "SPDX-License-Identifier: GPL-2.0-only",
    "SpdxGpl2": "SPDX-License-Identifier: GPL-2.0-or-later",
    "SpdxGpl3Only": "SPDX-License-Identifier: GPL-3.0-only",
    "SpdxGpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SpdxIsc": "SPDX-License-Identifier: ISC",
    "SpdxLgpl21": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "SpdxMit": "SPDX-License-Identifier: MIT",
    "SpdxMpl2": "SPDX-License-Identifier: MPL-2.0",
    "SpdxUnlicense": "SPDX-License-Identifier: Unlicense",
    "SpdxZlib": "SPDX-License-Identifier: Zlib",
    "UnlicenseDomain": "This is free and unencumbered software released into the public domain",
    "UnlicenseFree": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either"
                     " in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and"
                     " by any means",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty",
    "ZlibLiable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial"
                 " applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
# Ordered rules: an earlier one takes its sentences away from the later ones.
RULES = (
    ("GPL-3.0-or-later", ("GplFree", "GplNoWarranty", "GplCopy")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("Apache-2.0", ("ApacheRef", "ApacheYou", "ApacheGet", "ApacheAsIs", "ApacheSee")),
    ("GPL-2.0-or-later", ("Gpl2Free", "GplNoWarranty", "GplCopy")),
    ("GPL-2.0-or-later", ("Gpl2Free",)),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("LGPL-2.1-or-later", ("LgplFree",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("ISC", ("IscGrant",)),
    ("Zlib", ("ZlibAsIs", "ZlibLiable", "ZlibGrant")),
    ("Unlicense", ("UnlicenseDomain", "UnlicenseFree")),
    ("Unlicense", ("UnlicenseDomain",)),
    ("BSL-1.0", ("BoostRef",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitRef",)),
    ("MPL-2.0", ("Mpl2Ref", "MplCopy")),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("EPL-2.0", ("EplTerms",)),
    ("CC0-1.0", ("Cc0Waive",)),
    ("CC-BY-NC-4.0", ("CcByNcRef",)),
    ("CC-BY-SA-4.0", ("CcBySaRef",)),
    ("CC-BY-4.0", ("CcByRef",)),
    ("CC-BY-NC-4.0", ("CcByNcLong",)),
    ("CC-BY-SA-4.0", ("CcBySaLong",)),
    ("CC-BY-4.0", ("CcByLong",)),
    ("AGPL-3.0-or-later", ("SpdxAgpl3",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("BSL-1.0", ("SpdxBoost",)),
    ("BSD-2-Clause", ("SpdxBsd2",)),
    ("BSD-3-Clause", ("SpdxBsd3",)),
    ("CC0-1.0", ("SpdxCc0",)),
    ("EPL-2.0", ("SpdxEpl2",)),
    ("GPL-2.0-only", ("SpdxGpl2Only",)),
    ("GPL-2.0-or-later", ("SpdxGpl2",)),
    ("GPL-3.0-only", ("SpdxGpl3Only",)),
    ("GPL-3.0-or-later", ("SpdxGpl3",)),
    ("ISC", ("SpdxIsc",)),
    ("LGPL-2.1-or-later", ("SpdxLgpl21",)),
    ("MIT", ("SpdxMit",)),
    ("MPL-2.0", ("SpdxMpl2",)),
    ("Unlicense", ("SpdxUnlicense",)),
    ("Zlib", ("SpdxZlib",)),
    ("Proprietary", ("AllRights",)),
)
# Further wordings of known sentences, as real headers have them; the address stands in a paragraph of its own.
WORDINGS = (
    ("ApacheRef", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("ApacheGet", "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheGet", "You may obtain a copy of the License at\n\nhttps://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheGet", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
)
# Signs outside these become one space; an end sign before white space, or a line end, can end a sentence.
_OTHER = r"[^a-z0-9.!?:;+\n-]+"
_SIGNS = " .!?:;"
_LEADER = re.compile(r"(?:dnl|rem) ")  # what is left of comment signs at the start of a line
_END = re.compile(r" ?(?<![.!?:;])[.!?:;]++ [ .!?:;]*+")
_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# What may stand between two pieces of a sentence: white space, an end sign, a blank line.
_SPACE, _SIGN, _BLANK = " ", ".", "\n"


def _plain(sentence: str) -> str:
    """A dictionary sentence in the normal form that texts get."""
    text = re.sub(_OTHER, " ", sentence.lower())
    return text.strip(_SIGNS)


def pieces(text: str) -> Iterator[tuple[str, str, bool]]:
    """The normalised pieces between end signs and line ends: piece, what follows it, whether a line ends there.

    What follows is an end sign or none, then a blank line or white space; a single line end counts as white space, as a
    sentence may run on over it. Takes time in proportion to the text.
    """
    held = None
    for line in re.sub(_OTHER, " ", text.translate(_CAPITALS)).split("\n"):
        body = line.strip(" .!?:;-")
        body = _LEADER.sub("", body, count=1) if _LEADER.match(body) else body
        if not body:
            if held:
                yield held[0], held[1] + _BLANK, True
                held = None
            continue
        if held:
            yield held[0], held[1] + _SPACE, True
        *inner, last = _END.split(body)
        for piece in inner:
            yield piece, _SIGN + _SPACE, False
        held = last, _SIGN if line.rstrip(" -")[-1] in _SIGNS else ""
    if held:
        yield held[0], held[1] + _BLANK, True


class Recogniser:
    """Looks normalised sentences up in a dictionary, and identifier sequences in ordered rules.

    A sentence is one piece of the text or several in a row. Pieces are joined as long as what they make up begins a
    known sentence, and the longest known sentence counts; the next one begins behind it.
    """

    def __init__(self, sentences: list[tuple[str, str]], rules, wrapped: bool):
        self.rules, self.wrapped = rules, wrapped
        self.book: dict[str, str] = {}
        self.begins: set[str] = set()
        for name, sentence in sentences:
            key = ""
            for piece, gap, _ in pieces(sentence):
                for word in piece.split(" "):
                    key += word
                    self.begins.add(key)
                    key += " "
                key = key[:-1] + gap
            self.book.setdefault(key.rstrip(_SIGNS + _BLANK), name)

    def sentence_ids(self, text: str) -> list[str]:
        found: list[str] = []
        parts = list(pieces(text))
        at = 0
        while at < len(parts):
            key, best, after = "", None, at + 1
            for to in range(at, len(parts)):
                piece, gap, line_ends = parts[to]
                key += piece
                if key not in self.begins:
                    break
                if key in self.book:
                    best, after = self.book[key], to + 1
                if line_ends and not self.wrapped:
                    break
                key += gap
            if best:
                found.append(best)
            at = after
        return found

    def licenses(self, ids: list[str]) -> list[str]:
        """Names of the rules that fit, each once; a rule takes its occurrences away before the next is tried."""
        names: list[str] = []
        left = list(ids)
        for name, sequence in self.rules:
            if not left:
                break
            wanted, rest, at = list(sequence), [], 0
            if wanted[0] not in left:
                continue
            while at < len(left):
                if left[at : at + len(wanted)] == wanted:
                    at += len(wanted)
                    if name not in names:
                        names.append(name)
                else:
                    rest.append(left[at])
                    at += 1
            left = rest
        return names


def recognise(docs: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES,
              wrapped: bool = False, wordings=WORDINGS) -> DataFrame:
    """Adds ``sentence_ids`` (in text order) and ``licenses`` (rule order, each once) to every row.

    A known sentence begins and ends at an end sign or a line end. With ``wrapped`` it may also run over single line
    breaks, with or without comment signs at the line starts; blank lines end it, unless its wording has one there.
    Without, every line end does. Sentences that the dictionary lacks are passed over, so known ones may be apart in
    the text. Rules apply in order: each takes all its occurrences in the sequence away, and what is left is offered to
    the next. Null and empty texts have neither. Columns of these names are replaced; nothing is shuffled, and a text
    takes time in proportion to its length.
    """
    bound_batches(docs.sparkSession)
    known = [*sentences.items(), *((name, s) for name, s in wordings if name in sentences and (wrapped or "\n" not in s))]
    rules = list(rules)

    @F.pandas_udf("sentence_ids array<string>, licenses array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        recogniser = Recogniser(known, rules, wrapped)
        for batch in batches:
            ids = [recogniser.sentence_ids(value or "") for value in batch]
            yield pd.DataFrame({"sentence_ids": ids, "licenses": [recogniser.licenses(found) for found in ids]})

    found = docs.withColumn("__llm_found", scan(F.col(text)))
    return found.withColumns({
        "sentence_ids": F.col("__llm_found.sentence_ids"), "licenses": F.col("__llm_found.licenses"),
    }).drop("__llm_found")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Licences of every document, as comma-joined text; sentences may be wrapped over lines."""
    found = recognise(docs.select("doc_id", "text"), wrapped=True)
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
    )

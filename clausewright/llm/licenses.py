"""License scans by conditional compression.

Around every word that speaks of licensing lie candidate blocks, for each template as long as it is with the
words it may gain. Each is compressed alone and with the template as zstandard raw dictionary. Templates that
take away half of what they take away from themselves are the winners; the largest reduction in bytes takes its
words first, if the exact words in which text and template differ confirm it. Nothing else proposes a place.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: License notices and texts as their publishers word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache": "Licensed under the Apache License, Version 2.0.",
    "Apache-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "GFDL": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 "
        "or any later version published by the Free Software Foundation."
    ),
    "BSD-2-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Boost": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely"
    ),
    "CC-BY": "Licensed under CC BY 4.0.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0": "Licensed under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Licenses by the names that stand beside the word license, and by names that hold it.
SHORT_NAMES = {
    "MIT-name": ("MIT",),
    "Apache-name": ("Apache",),
    "GPL-name": ("GPL", "GPLv", "GNU GPL"),
    "AGPL-name": ("AGPL", "AGPLv", "GNU AGPL"),
    "LGPL-name": ("LGPL", "LGPLv", "GNU LGPL"),
    "MPL-name": ("MPL",),
    "BSD-name": ("BSD", "BSD Clause"),
    "ISC-name": ("ISC",),
    "CC-BY-name": ("CC BY",),
    "CC-BY-SA-name": ("CC BY-SA",),
    "CC-BY-NC-name": ("CC BY-NC",),
    "CC-BY-ND-name": ("CC BY-ND",),
    "CC0-name": ("CC0", "CC Zero"),
}
FULL_NAMES = {
    "GPL-name": ("GNU General Public License",),
    "AGPL-name": ("GNU Affero General Public License",),
    "LGPL-name": ("GNU Lesser General Public License",),
    "GFDL-name": ("GNU Free Documentation License",),
    "MPL-name": ("Mozilla Public License",),
    "EPL-name": ("Eclipse Public License",),
    "Boost-name": ("Boost Software License",),
    "CC-BY-name": ("Creative Commons Attribution",),
    "CC-BY-SA-name": ("Creative Commons Attribution-ShareAlike",),
    "CC-BY-NC-name": ("Creative Commons Attribution-NonCommercial",),
    "CC-BY-ND-name": ("Creative Commons Attribution-NoDerivatives",),
    "CC-BY-NC-SA-name": ("CC BY-NC-SA", "Creative Commons Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-name": ("CC BY-NC-ND", "Creative Commons Attribution-NonCommercial-NoDerivatives"),
}
#: How a short name stands beside the word license.
PHRASES = ("{} license", "{} licence", "license {}", "licence {}", "licensed under {}", "licensed under the {}")
#: What a block must speak of to be a candidate.
TRIGGERS = ("licens", "licence", "permission", "redistribut", "copyright", "creative commons", "public domain", "cc by", "cc-by")
#: Words that tell one license from another or turn a statement round. Text and template never differ by one.
DECISIVE = frozenset(
    "affero lesser documentation sa nc nd sharealike noncommercial noderivatives noderivs zero not never no nor neither isn wasn aren".split()
)
#: Words that, before a notice in its clause, deny it.
DENIALS = frozenset("not never no nor neither isn wasn aren".split())
#: The share of a template's words that a place may lack, and as many may be put between; the share of a template's own
#: reduction that a block must reach; words in a row by which a winner is laid on its block.
#: With a share of LEEWAY missing and as many put between, at least ROW words of ten or more stay in a row.
LEEWAY, REACHED, ROW = 0.1, 0.5, 3
SCHEMA = (
    "doc_id long, block_start long, block_end long, license string, version string, size_alone int, size_with int, gain double, "
    "template_words int, missing_words int, extra_words int"
)
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_VERSION = re.compile(
    r"(?:version|\bv\.?|gplv|apache[\s-]*(?:licen[sc]e)?,?|(?:public|software) licen[sc]e,?|attribution(?:-[a-z]+)*|cc[\s-]?(?:by)?(?:[\s-][a-z]{2})*0?[\s-]*)"
    r"\s*(\d+(?:\.\d+)*)",
    re.IGNORECASE,
)
_TAIL = re.compile(r"(?:[,\s-]{0,3}(?:version|v\.?)?[^\w\n]{0,3}\d+(?:\.\d+)*)?[^\w\s]*", re.IGNORECASE)
_STOP = re.compile(r"[.!?;:\n](?!\d)|\d")
_CLAUSE = re.compile(r"[.!?;:,\n](?!\d)")
_BREAK = re.compile(r"[.!?;](?!\d)\s|\n\s*\n")
_TRIGGER = re.compile("|".join(TRIGGERS), re.IGNORECASE)


def plain_words(text: str) -> list[str]:
    """Lower-case words; numbers, which licenses fill in, are left out."""
    return [w for w in _WORDS.findall(text.lower()) if not w[0].isdigit()]


def wordings(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(license, words) of every template: the notices and texts, then the names."""
    out = [(k, plain_words(t)) for k, t in templates.items()]
    out += [(k, plain_words(p.format(n))) for k, names in SHORT_NAMES.items() for n in names for p in PHRASES]
    out += [(k, plain_words(n)) for k, names in FULL_NAMES.items() for n in names]
    return out


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the places of a whole text that speak of licensing: candidate blocks lie around them."""
    return [m.span() for m in _TRIGGER.finditer(text)]


class Scanner:
    """Templates ready to compress with. Numbers count templates: several are of one license."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names, self.words = (list(x) for x in zip(*wordings(templates), strict=True))
        plain = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = [
            zstandard.ZstdCompressor(**plain, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for w in self.words
        ]
        self.own = [self.sizes(n, tuple(w)) for n, w in enumerate(self.words)]

    def sizes(self, template: int, block: tuple[str, ...]) -> tuple[int, int]:
        """Bytes of a block compressed alone and with a template."""
        data = " ".join(block).encode()
        return len(self.alone.compress(data)), len(self.given[template].compress(data))

    def confirmed(self, template: int, part: list[str]) -> tuple[int, int, int, int] | None:
        """(first, last, missing, extra) of the template's words in part, None if they differ by too much or by a decisive word."""
        want = self.words[template]
        allowed = int(LEEWAY * len(want))
        same = [m for m in difflib.SequenceMatcher(None, want, part, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        first, last = same[0].b, same[-1].b + same[-1].size - 1
        in_want = {i for m in same for i in range(m.a, m.a + m.size)}
        in_part = {i for m in same for i in range(m.b, m.b + m.size)}
        missing = [w for i, w in enumerate(want) if i not in in_want]
        extra = [w for i, w in enumerate(part[first : last + 1], first) if i not in in_part]
        if max(len(missing), len(extra)) > allowed or DECISIVE.intersection(missing) or DECISIVE.intersection(extra):
            return None
        return first, last, len(missing), len(extra)

    def windows(self, template: int, n_words: int, marks: list[int]) -> set[tuple[int, int]]:
        """(begin, end) of the blocks that hold a marked word. Any place of the template, with the words it may gain, lies whole in one."""
        length = len(self.words[template])
        step = max(length // 8, 1)
        size = length + int(LEEWAY * length) + step - 1
        starts = {s * step for t in marks for s in range(max(-(-(t - size + 1) // step), 0), t // step + 1)}
        return {(s, min(s + size, n_words)) for s in starts}

    def laid(self, template: int, block: tuple[str, ...]) -> set[tuple[int, int, int, int]]:
        """(first, last, missing, extra) of a template's confirmed places in a block, by rows of words that both have."""
        want = self.words[template]
        allowed, row = int(LEEWAY * len(want)), min(ROW, len(want))
        at: dict[tuple[str, ...], list[int]] = {}
        for p in range(len(want) - row + 1):
            at.setdefault(tuple(want[p : p + row]), []).append(p)
        out = set()
        for start in {q - p for q in range(len(block) - row + 1) for p in at.get(block[q : q + row], ())}:
            begin = max(start - allowed, 0)
            if found := self.confirmed(template, list(block[begin : start + len(want) + allowed])):
                out.add((begin + found[0], begin + found[1], *found[2:]))
        return out

    def places(self, words: list[str], marks: list[int] | None = None) -> list[tuple]:
        """(license, first, last, missing, extra, size alone, size with, gain, template) of confirmed winners, largest reduction first.

        marks: words that blocks must hold one of; all, if not given. Equal blocks are compressed once a template.
        """
        marks = list(range(len(words))) if marks is None else marks
        out = []
        for template, (own_alone, own_with) in enumerate(self.own):
            judged: dict[tuple[str, ...], tuple] = {}
            best: dict[tuple[int, int], tuple] = {}
            for begin, end in self.windows(template, len(words), marks):
                block = tuple(words[begin:end])
                if block not in judged:
                    alone, size = self.sizes(template, block)
                    won = alone - size >= REACHED * (own_alone - own_with)
                    judged[block] = (alone, size, self.laid(template, block) if won else ())
                alone, size, found = judged[block]
                for first, last, missing, extra in found:
                    key = (begin + first, begin + last)
                    best[key] = min(best.get(key, (math.inf,)), (missing + extra, size - alone, alone, size, missing, extra))
            # Of one template's places that share a word, the one with the fewest differences stays.
            taken: set[int] = set()
            for (first, last), (_, _, alone, size, missing, extra) in sorted(best.items(), key=lambda f: (f[1], f[0])):
                if taken.isdisjoint(range(first, last + 1)):
                    taken.update(range(first, last + 1))
                    out.append((self.names[template], first, last, missing, extra, alone, size, (alone - size) / alone, template))
        return sorted(out, key=lambda f: (f[6] - f[5], f[3] + f[4], f[8], f[1]))

    def scan(self, text: str) -> list[tuple]:
        """(start, end, license, version, sizes, gain, words, missing, extra) of each confirmed place.

        Places inside that of a larger reduction are left out: a notice's first sentence inside its full text.
        """
        spans = blocks(text)
        if not spans:
            return []
        hits = [m for m in _WORDS.finditer(text) if not m[0][0].isdigit()]
        words, ends = [m[0].lower() for m in hits], [m.end() for m in hits]
        marks = [i for a, b in spans for i in range(bisect_right(ends, a), bisect_left(ends, b) + 1) if i < len(hits)]
        denied = denied_words(text, hits)
        kept: list[tuple] = []
        over: dict[int, list[tuple]] = {}
        for found in self.places(words, marks):
            name, first, last = found[:3]
            inside = any(last <= other[2] for other in over.get(first, ()))
            if inside or any(name == other[0] for i in range(first, last + 1) for other in over.get(i, ())):
                continue
            if not self._spoilt(text, hits, words, denied, first, last, len(self.words[found[8]])):
                kept.append(found)
                for i in range(first, last + 1):
                    over.setdefault(i, []).append(found)
        out = []
        for name, first, last, missing, extra, alone, size, gain, template in sorted(kept, key=lambda f: f[1:3]):
            begin, end = hits[first].start(), _TAIL.match(text, hits[last].end()).end()
            version = _VERSION.search(text, begin, end)
            out.append((begin, end, name, version[1] if version else None, alone, size, gain, len(self.words[template]), missing, extra))
        return out

    @staticmethod
    def _spoilt(text: str, hits: list[re.Match], words: list[str], denied: list[bool], first: int, last: int, length: int) -> bool:
        """Whether the words around a place make it another license or deny it: BY-NC before -SA, ``not`` before a notice.

        Two words before a notice deny it past a comma too, those further before only in its own clause. A wording of fewer
        words than LEEWAY speaks of is a name, and stands in one sentence.
        """
        if last + 1 < len(words) and words[last + 1] in DECISIVE - DENIALS and not _STOP.search(text, hits[last].end(), hits[last + 1].start()):
            return True
        if length * LEEWAY < 1 and any(_BREAK.search(text, hits[i].end(), hits[i + 1].start()) for i in range(first, last)):
            return True
        near = range(max(first - 2, 0), first)
        return denied[first] or any(words[i] in DENIALS and not _STOP.search(text, hits[i].end(), hits[first].start()) for i in near)


def denied_words(text: str, hits: list[re.Match]) -> list[bool]:
    """For every word of a text whether a denial stands before it in its clause; a comma or ``but`` ends a clause."""
    out, denied = [], False
    for i, hit in enumerate(hits):
        word = hit[0].lower()
        if i and denied and (word == "but" or _CLAUSE.search(text, hits[i - 1].end(), hit.start())):
            denied = False
        out.append(denied)
        denied = denied or word in DENIALS
    return out


_SCANNERS: list[Scanner] = []


def scan_licenses(docs: DataFrame) -> DataFrame:
    """SCHEMA: a row for every place in docs (doc_id, text) that words a known license.

    block_start and block_end are characters of the text, around the license's own words. Texts are read whole, however long; null
    and empty ones have no blocks. A notice that a decisive word changes (Affero, Lesser, SA, NC, ND), or that "not" denies, is no place of
    the plainer license; bare "CC BY" or "CC BY-SA" is none, being too short to compress. size_alone, size_with and gain are of the candidate block. Repeated rows are scanned each, ids may be null, other columns
    aren't read, an empty table gives an empty result. Of templates that hold a
    place equally well the first by name counts. Words of other letters are compared like any; numbers (versions, years) aren't compared.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for rows in batches:
            found = [(i, *x) for i, t in zip(rows["doc_id"], rows["text"], strict=True) for x in _SCANNERS[0].scan(t or "")]
            yield pd.DataFrame(found, columns=names).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(scan, SCHEMA)


def op9_conditional_licenses(spark, sf_dir: str) -> DataFrame:
    """Licenses worded in any document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

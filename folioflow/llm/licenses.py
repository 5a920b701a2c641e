"""License scans by patience alignment.

Every template is aligned with the stretch of the text that holds most of its words: words
that occur once in both are anchors, the longest increasing subsequence of the anchors'
places is kept, and the gaps between them are aligned in the same way; a gap without
anchors is aligned word by word from both ends. Coverage is the share of the template's
words that are aligned; ``LEAST`` of them make a find, if those that name the license, its
version or its terms are among them. Terms that leave this open (a BSD header without its
conditions, a license without its version) name none.

A text is aligned only with templates that could reach that coverage, as told by the
distinct words that both have; this holds back no possible find.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

LEAST, STRETCH = 0.8, 1.5
#: Name -> notices by which the license is known. What stands in [[ ]] names the license, its version
#: or its terms and must be found as it is, word after word.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the [[MIT License]].",
        "Licensed under the [[MIT License]].",
        "[[Permission is hereby granted]], free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "[[Permission is hereby granted]], free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "Apache-2.0": [
        "[[Apache License Version 2.0]], January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License "
        "shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "Licensed under the [[Apache License, Version 2.0]].",
        "Licensed under the [[Apache License, Version 2.0]]; you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    # the conditions, as they end and go on, tell how many they are
    "BSD-2-Clause": [
        "Licensed under the [[BSD 2-Clause]] License.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials [[provided with the distribution. THIS SOFTWARE IS PROVIDED BY]]",
    ],
    "BSD-3-Clause": [
        "Licensed under the [[BSD 3-Clause]] License.",
        *(
            f"and/or other materials [[provided with the distribution. {n}Neither the name]] of the copyright holder nor the names of its contributors may be used to "
            "[[endorse or promote products]] derived from this software without specific prior written permission"
            for n in ("", "3. ")
        ),
    ],
    "ISC": [
        "Licensed under the [[ISC License]].",
        "Permission to [[use, copy, modify, and/or distribute this software for any purpose with or without fee]] is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
        "Permission to [[use, copy, modify, and/or distribute this software for any purpose with or without fee]] is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MPL-2.0": [
        "[[Mozilla Public License Version 2.0]] 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns "
        "Covered Software.",
        *(f"This Source Code Form is subject to the terms of the [[Mozilla Public License, {v} 2.0]]." for v in ("v.", "version")),
    ],
    "EPL-2.0": [
        *(f"made available under the terms of the [[Eclipse Public License {v}]]" for v in ("2.0", "v2.0", "v. 2.0", "version 2.0")),
        "[[Eclipse Public License - v 2.0]] THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR "
        "DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has dedicated all copyright and related rights to the [[public domain]].",
        "[[CC0 1.0 Universal]] CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN "
        "ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN AS-IS BASIS.",
    ],
    "Unlicense": [
        "This is free and [[unencumbered software released into the public domain]].",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "[[dedicate any and all copyright interest]] in the software to the public domain.",
    ],
    "0BSD": [
        "[[Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED]] AS IS AND THE "
        "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. [[Permission is granted to anyone to use this software for any purpose, including commercial applications]], and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "BSL-1.0": [
        "[[Distributed under the Boost Software License, Version 1.0]].",
        "[[Boost Software License - Version 1.0]] - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "WTFPL": [
        "[[DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE]] Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of this license "
        "document, and changing it is allowed as long as the name is changed.",
    ],
    "Artistic-2.0": ["[[The Artistic License 2.0]] Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "proprietary": ["All rights reserved."],
}
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
for _name, _title, _n, _dated in (
    ("GPL-2.0", "General", "2", "June 1991 Copyright (C) 1989, 1991"), ("GPL-3.0", "General", "3", "29 June 2007 Copyright (C) 2007"),
    ("LGPL-2.1", "Lesser General", "2.1", "February 1999 Copyright (C) 1991, 1999"), ("LGPL-3.0", "Lesser General", "3", "29 June 2007 Copyright (C) 2007"),
    ("AGPL-3.0", "Affero General", "3", "19 November 2007 Copyright (C) 2007"),
):
    _versions = [f"{v}{n}" for v in ("version ", "v") for n in dict.fromkeys((_n, _n if "." in _n else f"{_n}.0"))]
    TEMPLATES[_name] = [
        *(f"This {what} is licensed under the [[GNU {_title} Public License, {v}]]." for what in ("work", "library") for v in _versions),
        *(f"Licensed under the [[GNU {_title} Public License, {v}]]." for v in _versions),
        f"This program is free software: you can redistribute it and/or modify it under the terms of the [[GNU {_title} Public License]] as published by the "
        f"Free Software Foundation, either [[version {_n}]] of the License, or any later version.",
        f"[[GNU {_title} Public License Version {_n}]], {_dated} Free Software Foundation, Inc. {_VERBATIM}",
    ]
for _terms, _long in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _n, _where in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"CC-{_terms}-{_n}"] = [
            f"Licensed under [[CC {_terms} {_n}]].",
            f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this [[Creative Commons {_long} {_n} {_where} "
            "Public License]] (Public License).",
            *(f"This work is licensed under a [[Creative Commons {x} {_n}]] {_where} License." for x in dict.fromkeys((_long, _long.replace("NoDerivatives", "NoDerivs")))),
        ]
for _name, _notices in TEMPLATES.items():
    if _name != "proprietary":
        _notices.append(f"Licensed under the [[{_name}]] License.")
        _forms = (_name, f"{_name}-only", f"{_name}-or-later", f"{_name}+") if "GPL" in _name else (_name,)
        _notices += [f"[[SPDX-License-Identifier: {x}]]" for x in _forms]
_NAMED = re.compile(r"\[\[(.*?)\]\]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def norm(word: str) -> str:
    return _EDGES.sub("", word).lower()


def words(text: str | None) -> list[str]:
    return [w for x in (text or "").split() if (w := norm(x))]


def marked(notice: str) -> tuple[list[str], list[range]]:
    """The words of a notice, and the places of those that stand in [[ ]]."""
    out, named = [], []
    for k, part in enumerate(_NAMED.split(notice)):
        own = words(part)
        if k % 2:
            named.append(range(len(out), len(out) + len(own)))
        out += own
    return out, named


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending in the first place) that ascends in the second too."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tails, y)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[p], at[p] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Patience alignment of words a[a0:a1] with b[b0:b1]: pairs of places, ascending in both."""
    a1, b1 = len(a) if a1 is None else a1, len(b) if b1 is None else b1
    head, tail = [], []
    while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
        head.append((a0, b0))
        a0, b0 = a0 + 1, b0 + 1
    while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
        tail.append((a1, b1))
    inner: list[tuple[int, int]] = []
    if a0 < a1 and b0 < b1:
        once_a, once_b = ({w: k for w, k, n in _counted(x, i, j) if n == 1} for x, i, j in ((a, a0, a1), (b, b0, b1)))
        anchors = _increasing(sorted((k, once_b[w]) for w, k in once_a.items() if w in once_b))
        i, j = a0, b0
        for x, y in [*anchors, (a1, b1)] if anchors else ():
            inner += align(a, b, i, x, j, y)
            if x < a1 and y < b1:
                inner.append((x, y))
            i, j = x + 1, y + 1
    return head + inner + tail[::-1]


def _counted(x: list[str], i: int, j: int) -> list[tuple[str, int, int]]:
    seen: dict[str, list[int]] = {}
    for k in range(i, j):
        seen.setdefault(x[k], [k, 0])[1] += 1
    return [(w, k, n) for w, (k, n) in seen.items()]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], least: float = LEAST):
        self.least = least
        self.names, notices = zip(*((name, marked(t)) for name, each in templates.items() for t in each))
        self.texts, self.named = zip(*notices)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.member = np.zeros((len(self.texts), len(self.vocabulary)), np.float32)
        for k, t in enumerate(self.texts):
            self.member[k, [self.vocabulary[w] for w in t]] = 1
        short = np.array([int((1 - least) * len(t) + 1e-9) for t in self.texts])
        self.need = self.member.sum(axis=1) - short  # distinct words that a sufficient coverage implies
        self.known: dict[str, int] = {}

    def entry(self, word: str) -> int:
        """The word's number in the templates' vocabulary, -1 outside it, -2 if it is no word."""
        w = norm(word)
        return self.vocabulary.get(w, -1) if w else -2

    def scan(self, texts: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """Per text the licenses found: (name, coverage, first word, words)."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        entry = np.array([self.entry(w) for w in coded.dictionary.to_pylist()], np.int64)
        each = entry[coded.indices.to_numpy()] if len(entry) else np.empty(0, np.int64)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        have = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        have[doc[each >= 0], each[each >= 0]] = 1
        enough = have @ self.member.T >= self.need - 0.5
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in range(len(texts))]
        for k in np.flatnonzero(enough.any(axis=1)):
            own = each[bounds[k] : bounds[k + 1]]
            out[k] = self._best(own[own > -2], np.flatnonzero(enough[k]))
        return out

    def _names(self, pairs: list[tuple[int, int]], t: int) -> bool:
        """Whether what names the license is aligned, without words put in."""
        at = {y: x for x, y in pairs}
        return all(y in at and at[y] - at[each[0]] == y - each[0] for each in self.named[t] for y in each)

    def _best(self, own: np.ndarray, able: np.ndarray) -> list[tuple[str, float, int, int]]:
        found: dict[str, tuple[float, int, int, int]] = {}
        for t in able:
            template = [self.vocabulary[w] for w in self.texts[t]]
            hits = np.flatnonzero(self.member[t][np.maximum(own, 0)] * (own >= 0))
            width = int(STRETCH * len(template)) + 2
            last = np.searchsorted(hits, hits + width)
            dense = last - np.arange(len(hits))
            done, top = -1, (0.0, 0, 0, 0)
            for k in np.flatnonzero(dense >= self.least * len(template) - 1e-9):
                if hits[k] <= done:
                    continue
                # the stretch that begins at the first of the hits that could hold it all, and its overlaps
                start = int(hits[k])
                stretch = own[start : start + 2 * width].tolist()
                pairs = align(stretch, template)
                coverage = len(pairs) / len(template)
                if coverage >= self.least and self._names(pairs, t):
                    a, b = pairs[0][0], pairs[-1][0]
                    top = max(top, (coverage, len(template), -(start + a), b - a + 1))
                    done = start + b
            if top[0] and top > found.get(self.names[t], (0.0,)):
                found[self.names[t]] = top
        kept: list[tuple[str, float, int, int]] = []
        for name, (c, _, s, n) in sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
            if all(-s + n <= y[2] or y[2] + y[3] <= -s for y in kept):  # of overlapping stretches the best counts
                kept.append((name, c, -s, n))
        return kept


def licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per document: ``doc_id, license, coverage, first_word, n_words, licenses``.

    ``license`` is the one with the highest coverage (then the longest template, then the
    first by name), null if none is found; ``first_word`` and ``n_words`` give its stretch in words of the text that hold a letter or digit;
    ``licenses`` names all whose stretches do not overlap a better one. Null and empty texts hold none; a null doc_id is
    carried; repeated rows give repeated results; very long texts are taken one by one; other columns are not read; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast((templates or TEMPLATES, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*held.value)
        for whole in batches:
            for batch in portions(whole):
                got = scanner.scan(batch.column(1))
                best = [x[0] if x else (None,) * 4 for x in got]
                name, coverage, first, n = (list(x) for x in zip(*best))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(name, pa.string()), pa.array(coverage, pa.float64()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array([[y[0] for y in x] for x in got], pa.list_(pa.string()))],
                    ["doc_id", "license", "coverage", "first_word", "n_words", "licenses"],
                )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, license string, coverage double, first_word int, n_words int, licenses array<string>")

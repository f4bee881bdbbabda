"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A window of a text matches a template if twice the bigrams they share (each counted as often as both have it) is at least
`dice` of the bigrams of both. Size bounds prune: a window may have between dice / (2 - dice) and (2 - dice) / dice times
the template's bigrams, and must share at least dice / (2 - dice) of them, so a template whose bigrams a text shows too few
of is left at once, and so is each start whose longest window does. Of overlapping matches the best is kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICE = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

#: Notices and openings of well-known licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "proprietary": "All rights reserved.",
}

_GRANT = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_GNU = [("gpl", "General Public License", ("1", "2", "3")), ("lgpl", "Lesser General Public License", ("2.1", "3")), ("lgpl", "Library General Public License", ("2",)), ("agpl", "Affero General Public License", ("1", "3")), ("gfdl", "Free Documentation License", ("1.1", "1.2", "1.3"))]
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_PORTS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_2 = TEMPLATES["bsd"] + ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Notices of the other families and versions, so that the nearest sibling wins, and whole texts of the short licences.
MORE = {
    **{f"{k}-{v if '.' in v else v + '.0'}{end}": f"{start} the GNU {name}, version {v}." for k, name, versions in _GNU for v in versions for start, end in (("This work is licensed under", ""), ("Licensed under", "-short")) if (k, v, end) != ("gpl", "3", "")},
    **{f"cc-{k}-{v}{'-long' if (k, v) == ('by-nc', '4.0') else ''}": f"This work is licensed under a Creative Commons {name} {v} {port} License." for k, name in _CC.items() for v, port in _PORTS.items() if (k, v) != ("by", "4.0")},
    **{f"cc-{k}-{v}-short": f"Licensed under CC {k.upper()} {v}." for k in _CC for v in _PORTS if (k, v) != ("by-nc", "4.0")},
    "gpl-2.0-header": _GRANT.format("program", ";", "General Public License", ";", "2"),
    "lgpl-2.0-header": _GRANT.format("library", ";", "Library General Public License", ";", "2"),
    "lgpl-2.1-header": _GRANT.format("library", ";", "Lesser General Public License", ";", "2.1"),
    "lgpl-3.0-header": _GRANT.format("program", ":", "Lesser General Public License", ",", "3"),
    "agpl-3.0-header": _GRANT.format("program", ":", "Affero General Public License", ",", "3"),
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1.0-notice": "This work is licensed under CC0 1.0 Universal.",
    "cc0-1.0-short": "CC0 1.0 Universal Public Domain Dedication",
    "apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "mpl-1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "epl-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    **{f"{k}-notice": f"Released under the {name} License." for k, name in (("apache", "Apache"), ("bsd", "BSD"), ("isc", "ISC"), ("zlib", "zlib"))},
    "mit-whole": TEMPLATES["mit-text"] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software." + _AS_IS,
    "bsd-2-clause": _BSD_2 + _BSD_END,
    "bsd-3-clause": _BSD_2 + _BSD_3 + _BSD_END,
    "isc-whole": TEMPLATES["isc"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}


def normalised(text: str) -> list[str]:
    """Words in lower case; punctuation and white space don't count."""
    return WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str], dice: float = DICE):
        if not 0 < dice <= 1:
            raise ValueError("dice must be above 0 and at most 1")
        self.dice, least = dice, dice / (2 - dice)
        self.templates = []
        for name, text in sorted(templates.items()):
            words = normalised(text)
            counts = Counter(zip(words, words[1:]))  # noqa: B905
            n = sum(counts.values())
            if not n:
                raise ValueError(f"template {name} has fewer than two words")
            self.templates.append((name, dict(counts), frozenset(counts), n, int(np.ceil(least * n - 1e-9)), int(np.floor(n / least + 1e-9))))
        self.known = {b for _, counts, *_ in self.templates for b in counts}

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """start, end (code points), template, Dice of the matches, in order."""
        words = normalised(text or "")
        met = self.known.intersection(zip(words, words[1:]))  # noqa: B905
        if not met:
            return []
        # A template's bigrams that a text shows, each as often as the template has it, must be enough: sets find them from the smaller side.
        pairs, found = None, []
        for name, counts, own, n, least, longest in self.templates:
            if sum(map(counts.__getitem__, own & met)) < least:
                continue
            pairs = pairs or [*zip(words, words[1:])]  # noqa: B905
            shared = np.fromiter((b in counts for b in pairs), bool, len(pairs))
            sums = np.concatenate([[0], np.cumsum(shared)])
            for start in np.flatnonzero(shared):
                if sums[min(len(pairs), start + longest)] - sums[start] < least:
                    continue
                left, common = dict(counts), 0
                for end in range(start, min(len(pairs), start + longest)):
                    if left.get(pairs[end], 0) > 0:
                        left[pairs[end]] -= 1
                        common += 1
                        size = end - start + 1
                        if size >= least and 2 * common >= self.dice * (size + n) - 1e-9:
                            found.append((2 * common / (size + n), int(start), int(end) + 2, name))
        if not found:
            return []
        kept, starts, ends = [], [], []  # what is taken, in order; none of it overlaps, so only the last that starts before b can
        for score, a, b, name in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
            k = bisect_left(starts, b)
            if k == 0 or ends[k - 1] <= a:
                starts.insert(k, a)
                ends.insert(k, b)
                kept.append((a, b, name, score))
        places = [m.span() for m in WORD.finditer(text.lower())] if len(text.lower()) == len(text) else _places(text)
        return [(places[a][0], places[b - 1][1], name, score) for a, b, name, score in sorted(kept)]


def _places(text: str) -> list[tuple[int, int]]:
    """Spans of the words in text where lower-casing changes its length."""
    low, back = [], []
    for i, c in enumerate(text):
        part = c.lower()
        low.append(part)
        back += [i] * len(part)
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer("".join(low))]


def licence_scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, n_matches, licences (names, sorted, comma-joined), spans (name:start:end, comma-joined), best (greatest Dice, 0 without a match).

    Without templates, TEMPLATES and MORE are looked for. Null and empty texts match nothing. Rows that repeat are all returned, each by itself; columns besides doc_id
    and text aren't read; an empty table gives an empty result.
    """
    scanner = Scanner(TEMPLATES | MORE if templates is None else templates, dice)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = scanner.scan(text.as_py())
                rows.append((len(found), ",".join(sorted({n for *_, n, _ in found})), ",".join(f"{n}:{a}:{b}" for a, b, n, _ in found), max((s for *_, s in found), default=0.0)))
            columns = [*zip(*rows, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.string(), pa.float64()], strict=True)]], ["doc_id", "n_matches", "licences", "spans", "best"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_matches long, licences string, spans string, best double")

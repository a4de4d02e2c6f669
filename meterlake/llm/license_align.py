"""License scan by patience alignment.

Text and template are words (letters and digits, lower case). Words that occur once in both are anchors; the longest
increasing subsequence of their places is kept, and the gaps between anchors are aligned in the same way; where a gap
has no such word, equal words at its ends are matched. Coverage is the share of the template's words that are
matched; a template is reported where a stretch of the text covers at least ``coverage`` of it.

A license is a stretch of the text of at most ``spread`` words for each of the template's (so up to that many less one
may stand between any two on average) that covers enough of the template. All stretches that don't overlap are
reported: the best first, then what lies before and behind it. A template that occurs twice has no unique words in the
whole text, so the text is cut into windows around its rarest words. If the stretch covers 0.8 of the words, at least
one of any fifth-and-one of them is in it, so windows around that many of the rarest miss nothing.

One pass over the texts, no shuffle. Cases: a null or empty text holds no license; texts are read whole; of equal
coverage the shorter stretch counts, then the earlier one; repeated rows are scanned as often as they occur; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

# License notices and texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
}
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rising(places: list[int]) -> list[int]:
    """The indexes of a longest increasing subsequence."""
    tails, ends, before = [], [], []
    for i, x in enumerate(places):
        k = bisect_left(tails, x)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[k], ends[k] = x, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places at which ``a`` and ``b`` are matched, rising in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        unique = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at]
        anchors = [unique[k] for k in rising([j for _, j in unique])]
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, spread: int = 5):
        self.coverage, self.spread, self.templates = coverage, spread, [(name, words(x), Counter(words(x))) for name, x in templates.items() if words(x)]
        self.vocabulary = {w for _, x, _ in self.templates for w in x}

    def find(self, text: str) -> list[tuple[float, str, int, int]]:
        """(coverage, template, first word, behind the last) of each template's stretches, the best first."""
        own = words(text)
        at: dict[str, list[int]] = {w: [] for w in self.vocabulary.intersection(own)}
        if not at:
            return []
        for i, w in enumerate(own):
            if w in at:
                at[w].append(i)
        out = []
        for name, template, counts in self.templates:
            if sum(n for w, n in counts.items() if w in at) < self.coverage * len(template):
                continue
            rare = sorted((w for w in counts if w in at), key=lambda w: (len(at[w]), w))[: math.floor((1 - self.coverage) * len(template)) + 1]
            reach, windows = self.spread * len(template), []
            for p in sorted(p for w in rare for p in at[w]):
                low, high = max(0, p - reach), min(len(own), p + reach + 1)
                if windows and low <= windows[-1][1]:  # windows that touch are one
                    windows[-1][1] = high
                else:
                    windows.append([low, high])
            while windows:
                low, high = windows.pop()
                picked = self.stretches(own, low, high, template, counts, rare)
                out += [(share, name, a, b) for share, a, b in picked]
                if picked:  # what crossed one of them may still lie before, between or behind them
                    windows += [[a, b] for a, b in zip([low, *(x[2] for x in picked)], [*(x[1] for x in picked), high])]
        return sorted(out, key=lambda x: (-x[0], x[3] - x[2], x[1], x[2]))

    def stretches(self, own: list[str], low: int, high: int, template: list[str], counts: Counter, rare: list[str]) -> list[tuple[float, int, int]]:
        """(coverage, first word, behind the last) of stretches of own[low:high] that cover enough, apart, in their order."""
        need, reach = self.coverage * len(template), self.spread * len(template)
        if sum(min(n, m) for w, m in Counter(own[low:high]).items() if (n := counts.get(w))) < need:
            return []
        part, found, seen = own[low:high], set(), Counter()
        # how many of the template's words each stretch of the longest length holds
        enough, held = [False] * len(part), 0
        for i in range(len(part) + reach):
            if i < len(part) and part[i] in counts:
                held += seen[part[i]] < counts[part[i]]
                seen[part[i]] += 1
            gone = i - reach
            if gone >= 0 and part[gone] in counts:
                seen[part[gone]] -= 1
                held -= seen[part[gone]] < counts[part[gone]]
            if 0 <= i - reach + 1 < len(part):
                enough[i - reach + 1] = held >= need
        for start in self.starts(part, template, rare):
            if not enough[start] and len(part) > reach:
                continue
            pairs = align(template, part[start : start + reach])
            share = len(pairs) / len(template)
            if pairs and len(pairs) >= need:
                found.add((-share, pairs[-1][1] - pairs[0][1], start + pairs[0][1], start + pairs[-1][1] + 1))
        picked: list[tuple[float, int, int]] = []  # in the order of their places
        for share, _, a, b in sorted(found):
            at = bisect_left(picked, (low + a,), key=lambda x: (x[1],))
            if (at == 0 or picked[at - 1][2] <= low + a) and (at == len(picked) or picked[at][1] >= low + b):
                picked.insert(at, (-share, low + a, low + b))
        return picked

    def starts(self, part: list[str], template: list[str], rare: list[str]) -> list[int]:
        """Where a stretch may begin: as far before each rare word as the template has it, at any of its places there, and the part's start."""
        places = {w: [i for i, x in enumerate(template) if x == w] for w in rare}
        slack = len(template) - math.ceil(self.coverage * len(template))
        return sorted({0, *(max(0, i - k - d) for i, w in enumerate(part) if w in places for k in places[w] for d in (0, slack, k * (self.spread - 1)))})


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, spread: int = 5) -> DataFrame:
    """Rows (doc_id, n_licenses, license, coverage, spans), one an input row: the best, and all as name:first:behind."""
    templates = TEMPLATES if templates is None else templates
    schema = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("spans", pa.string())])

    def run(batches):
        scanner = Scanner(templates, coverage, spread)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = scanner.find(text or "")
                out.append({"doc_id": doc, "n_licenses": len(found), "license": found[0][1] if found else None, "coverage": found[0][0] if found else 0.0, "spans": ",".join(f"{n}:{a}:{b}" for _, n, a, b in found)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_licenses long, license string, coverage double, spans string")

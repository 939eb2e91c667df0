"""License scans by patience alignment.

A template is aligned with a stretch of the text by anchoring on words that occur once in both, taking the longest
increasing subsequence of their positions, growing each anchor over equal neighbours and aligning the gaps in the
same way.  Coverage is the share of the template's words that are aligned.

Candidate stretches: a telling word (once in the template, rare in prose) says where in the text its template would
start; a stretch of the template's length with slack on both sides is aligned from there, so a notice that occurs
twice is found twice although none of its words is unique in the whole text.  Stretches that hold too few of the
template's words to reach the wanted coverage are not aligned.

Defined results: null and empty texts have no matches.  Of equal coverages the longer template, then the smaller name
wins.  Repeated rows are scanned each for itself.  Other columns pass through; the result column takes a free name.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import fresh

COVERAGE = 0.75

# Public notices and licence texts, as their stewards word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
}

# Words too common in prose to point at a licence.
COMMON = frozenset(
    "a above an and any any appear as at be but by can copy do either even file following for free from general hope if in is it its later may more "
    "new no not of on option or other out person see shall terms that the this to under use used useful version whom will with without work you your".split()
)

WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")

Match = dict


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words and their places; dots, hyphens and slashes inside a word belong to it."""
    found = [(m.group().lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def rising(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    piles, heads, back = [], [], []
    for i, p in enumerate(places):
        k = bisect.bisect_left(piles, p)
        back.append(heads[k - 1] if k else -1)
        if k == len(piles):
            piles.append(p)
            heads.append(i)
        else:
            piles[k], heads[k] = p, i
    out, i = [], heads[-1] if heads else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned positions of two word lists, by patience."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal ends need no anchor
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        once = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in at]
        if not once:
            continue
        anchors = [once[i] for i in rising([j for _, j in once])]
        pairs.extend(anchors)
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo.extend((x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]) if u > x + 1 and v > y + 1)
    return sorted(pairs)


class Scanner:
    """Templates prepared for scanning."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = []
        self.telling: dict[str, list[int]] = {}
        for k, (name, text) in enumerate(sorted(templates.items())):
            words, _ = words_of(text)
            have = Counter(words)
            self.templates.append((name, words, have, {w: i for i, w in enumerate(words)}))
            once = {w for w, n in have.items() if n == 1}
            for w in once - COMMON or once or have:
                self.telling.setdefault(w, []).append(k)

    def windows(self, words: list[str], places: list[int], at: dict[str, int], size: int, have: Counter) -> list[tuple[int, int]]:
        """Stretches that start where a telling word's place in the template says, and hold enough of its words."""
        slack, out, begin = max(2, size // 4), [], None
        for start in sorted({i - at[words[i]] for i in places}):
            if begin is None or start > begin + slack:  # starts closer than the slack share a stretch
                begin = start
                out.append((max(0, start - slack), min(len(words), start + size + 2 * slack)))
        need = self.coverage * size
        return [(a, b) for a, b in out if sum(min(n, have[w]) for w, n in Counter(w for w in words[a:b] if w in have).items()) >= need]

    def scan(self, text: str) -> tuple[int, list[Match]]:
        """The number of words, and the matches of all templates that reach the coverage, best first."""
        words, spans = words_of(text)
        places: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for k in self.telling.get(w, ()):
                places.setdefault(k, []).append(i)
        out = []
        for k, at in places.items():
            name, template, have, index = self.templates[k]
            for a, b in self.windows(words, at, index, len(template), have):
                pairs = align(words[a:b], template)
                if pairs and len(pairs) >= self.coverage * len(template):
                    first, last = a + pairs[0][0], a + pairs[-1][0]
                    out.append({"license": name, "coverage": len(pairs) / len(template), "matched": len(pairs), "word_from": first, "word_to": last + 1,
                                "char_from": spans[first][0], "char_to": spans[last][1]})
        out.sort(key=lambda m: (-m["coverage"], -m["matched"], m["license"], m["word_from"]))
        seen, kept = set(), []
        for m in out:
            if (m["license"], m["word_from"]) not in seen:
                seen.add((m["license"], m["word_from"]))
                kept.append(m)
        return len(words), kept


_MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("word_from", pa.int32()), ("word_to", pa.int32()),
                    ("char_from", pa.int32()), ("char_to", pa.int32())])
_FOUND = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(_MATCH))])
_FOUND_SQL = ("struct<n_words:bigint,matches:array<struct<license:string,coverage:double,matched:int,word_from:int,word_to:int,"
              "char_from:int,char_to:int>>>")


def _each(templates: dict[str, str], coverage: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            yield pa.array([dict(zip(("n_words", "matches"), scanner.scan(t or ""))) for t in batch.to_pylist()], _FOUND)

    return run


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, out: str = "licenses") -> tuple[DataFrame, str]:
    """Add a struct column: ``n_words`` and ``matches``, best first.  Returns the frame and the column's name.

    The templates travel with the function; they are a parameter of bounded size.
    """
    name = fresh(docs, out)[0]
    find = F.arrow_udf(_each(dict(templates), coverage), _FOUND_SQL).asNondeterministic()
    return docs.withColumn(name, find(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))), name

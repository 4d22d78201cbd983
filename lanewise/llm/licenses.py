"""License scans by patience alignment.

Word seeds of the templates say where in a text a template may begin: the seed's place in
the text less its place in the template, so that each of several copies has a beginning
of its own. There, text and template are aligned: words that occur once in both are anchors, the longest increasing
subsequence of the anchors is kept, and each gap between two anchors is aligned again
in the same way, down to gaps without anchors, whose equal beginnings and ends still
count. Coverage is the share of the template's words that are aligned; words that tell a
template from its kin (names, version numbers) must be among them. Short notices are aligned in
the same way as long texts, from seeds of two words instead of three.

Templates are few and fixed, tasks share them; documents are scanned where they are
read, whole, and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import read_table
from lanewise.llm.seeds import Passages, words_of

#: License texts and notices in common use.
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AS_IS = (
    '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    + _NO_WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS " + _AS_IS,
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS " + _AS_IS,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "GPL-2.0": _GNU.format("General Public License", "2"),
    "GPL": _GNU.format("General Public License", "3"),
    "LGPL-3.0": _GNU.format("Lesser General Public License", "3"),
    "AGPL-3.0": _GNU.format("Affero General Public License", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    **{f"{name}-notice": f"This work is licensed under the GNU {full}, version {version}." for name, full, version in (("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3), ("LGPL-3.0", "Lesser General Public License", 3), ("AGPL-3.0", "Affero General Public License", 3))},
    **{f"CC-{terms}-4.0-notice": f"Licensed under CC {terms} 4.0." for terms in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")},
    "CC0-notice": "Licensed under CC0 1.0 Universal.",
    "All-rights-reserved": "All rights reserved.",
}
#: Words that tell templates from their kin and must be aligned.
TELLING = frozenset("mit isc apache mozilla gnu lesser affero general public cc by sa nd nc cc0 2 3 4 neither endorse universal".split())
#: Words of a seed, of templates of at most SHORT words and of longer ones; least coverage of a template.
SHORT, SHORT_SEED, SEED_WORDS, COVERAGE = 12, 2, 3, 0.8


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p], at[p] = v, i
        back.append(at[p - 1] if p else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Aligned (place in text, place in template), increasing in both.

    Gaps are kept on a list, not the call stack, so inputs may be long.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once: dict = {}
        for j in range(c, d):
            once[template[j]] = -1 if template[j] in once else j
        where: dict = {}
        for i in range(a, b):
            if once.get(text[i], -1) >= 0:
                where[text[i]] = -1 if text[i] in where else i
        anchors = [(i, once[w]) for w, i in where.items() if i >= 0]
        if not anchors:
            continue
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        for (i, j), (e, f) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
            if i >= a:
                out.append((i, j))
            todo.append((i + 1, e, j + 1, f))
    return sorted(out)


def _copies(hashes: np.ndarray, template: np.ndarray, telling: list[set[int]], at: np.ndarray, begin: np.ndarray, coverage: float) -> list[tuple]:
    """(first, last, aligned words, first, last) of the copies of a template, by what is aligned and by what the whole template would take; beginnings with the most seeds are aligned first.

    A copy is aligned within some third of the template's length around its place, but not
    beyond copies that are already found or other beginnings with many seeds; failing
    that, at its very place. Of each of ``telling``, the places of a telling word, one must be aligned.
    """
    m, words = len(template), np.unique(template)
    slack = min((m + 1) // 2, 4 + m // 3)
    by_begin = np.argsort(begin, kind="stable")
    at = at[by_begin]
    begins, where, seeds = np.unique(begin[by_begin], return_index=True, return_counts=True)
    strong = begins[seeds >= max(2, m // 4)].tolist()
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []  # the copies' first and last words, in order; copies don't overlap
    for k in np.argsort(-seeds, kind="stable").tolist():
        s = int(begins[k])
        if all((i := bisect_right(taken, (p, len(hashes)))) and taken[i - 1][1] >= p for p in at[where[k] : where[k] + seeds[k]].tolist()):
            continue
        i = bisect_left(taken, (s + m // 2,))  # copies that begin before the middle of this one
        least, most = max((e + 1 for _, e in taken[max(0, i - 1) : i]), default=0), taken[i][0] if i < len(taken) else len(hashes)
        j, k = bisect_right(strong, s - coverage * m) - 1, bisect_left(strong, s + coverage * m)
        before, after = min(strong[j] + m, s) if j >= 0 else 0, strong[k] if k < len(strong) else len(hashes)
        for lo, hi in ((max(s - slack, before), min(s + m + slack, after)), (s, s + m)):
            lo, hi = max(lo, least), min(hi, most)
            if hi - lo < coverage * m or np.isin(hashes[lo:hi], words).sum() < coverage * m:
                continue
            pairs = patience(hashes[lo:hi].tolist(), template.tolist())
            if len(pairs) >= coverage * m and pairs[-1][0] - pairs[0][0] < m + slack and all(not t.isdisjoint(j for _, j in pairs) for t in telling):
                first, last = lo + pairs[0][0], lo + pairs[-1][0]
                out.append((first, last, len(pairs), first - pairs[0][1], last + m - 1 - pairs[-1][1]))
                insort(taken, (first, last))
                break
    return out


class Templates:
    """Templates by the length of their seeds, with the places of each of their telling words."""

    def __init__(self, templates: dict[str, str]):
        telling = np.concatenate([words_of(w)[0] for w in sorted(TELLING)])
        size = {k: len(words_of(t)[0]) for k, t in templates.items()}
        self.groups = []
        for n, keys in ((SHORT_SEED, [k for k in templates if size[k] <= SHORT]), (SEED_WORDS, [k for k in templates if size[k] > SHORT])):
            passages = Passages(keys, [templates[k] for k in keys], n)
            self.groups.append((passages, [[set(np.flatnonzero(w == t).tolist()) for t in telling[np.isin(telling, w)]] for w in passages.words]))


def find_licenses(text: str, templates: Templates, coverage: float = COVERAGE) -> list[tuple[str, int, int, float]]:
    """(template, start, end, coverage) in code points, by start; of templates on the same words the one with more aligned words."""
    hashes, starts, ends = words_of(text)
    found = []
    for passages, telling in templates.groups:
        at, row = passages.hits(hashes)
        item, begin = passages.item[row], at - passages.place[row]
        for i in np.unique(item).tolist():
            template, mine = passages.words[i], item == i
            copies = _copies(hashes, template, telling[i], at[mine], begin[mine], coverage)
            found += [(passages.keys[i], first, last, n / len(template), n, *whole) for first, last, n, *whole in copies]
    found.sort(key=lambda x: (-x[4], x[1], x[0]))
    kept: list[tuple] = []
    taken: list[tuple[int, int]] = []
    whole: list[tuple[int, int]] = []  # a notice in the unaligned end of a longer copy is that copy's
    for f in found:
        i, j = bisect_left(taken, (f[2] + 1,)), bisect_left(whole, ((f[1] + f[2]) // 2 + 1,))
        if (i == 0 or taken[i - 1][1] < f[1]) and (j == 0 or whole[j - 1][1] < (f[1] + f[2]) // 2):
            kept.append(f)
            insort(taken, (f[1], f[2]))
            insort(whole, (f[5], f[6]))
    raw = text.encode("utf-8", "replace")
    point = (lambda byte: byte) if len(raw) == len(text) else lambda byte: len(raw[:byte].decode("utf-8", "replace"))
    return [(k[0], point(int(starts[k[1]])), point(int(ends[k[2]])), k[3]) for k in sorted(kept, key=lambda k: k[1])]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licenses array of (license, start, end, coverage)) for every row of ``docs``.

    Words are lower-cased (A-Z) and freed of ASCII punctuation. Null and wordless texts
    have no licenses; repeated rows have rows of their own; null ids stay; an empty table
    gives an empty result; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for b in batches:
            found = [[dict(zip(("license", "start", "end", "coverage"), f, strict=True)) for f in find_licenses(t, known, coverage)] if t else [] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, kind)], ["doc_id", "licenses"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, licenses array<struct<license: string, start: int, end: int, coverage: double>>")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and notices in every document; one row for each document."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"]))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)), 6).alias("best_coverage"),
        F.array_join(listed, ",").alias("spans"),
    )

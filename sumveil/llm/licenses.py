"""License scans: Dice coefficient over word bigrams, in DataFrame expressions only.

A text is cut into pieces at line ends and after full stops, colons, semicolons, question
and exclamation marks before a blank.  A span is a run of whole pieces, so a license is
found in one line, wrapped over lines, in paragraphs parted by blank lines, behind comment
marks and inside a longer paragraph.  It is normalised to lower-case words of letters and
digits and becomes a set of bigrams, by hash.  With sizes a and b the coefficient is at
most ``2 * min(a, b) / (a + b)``: a template is compared with runs only whose number of
word pairs lies within bounds of its size, and a text or a stretch of it is left out where
it shares fewer bigrams with the template than any such run needs.  Most texts share none
and are read once.

From each piece on, the run that is most like a template (of equals the shortest) counts.
Runs are taken in order of start, name and template: one that begins before the run held
so far ends replaces it if it has a greater coefficient and is left out otherwise; one that begins
later opens the next place.  So a notice that resembles two licenses gives the nearer one.

Null and empty texts have no license.  Rows are judged one by one: repeated rows repeat
their result, and no other column than ``doc_id`` and ``text`` is read.  A tie between
templates goes to the name that comes first.  An empty table gives no row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Coefficient from which a run carries a license.
DICE = 0.8

# Statements, notices and short license texts by which texts name their license.
# Long licenses are known by the notice or the opening that their texts hold.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "{it} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or "
    "(at your option) any later version. {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with {this}"
)
_GNU_WEB = ". If not, see https://www.gnu.org/licenses/."
_GNU_MAIL = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_PROGRAM, _LIBRARY = {"it": "This program", "this": "this program"}, {"it": "This library", "this": "this library"}
TEMPLATES = {
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License v3.0.",
        _GNU.format(**_PROGRAM, colon=":", name=_AGPL, version="3") + _GNU_WEB,
    ],
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": ["Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "bsd-2-clause": [_BSD + _BSD_END],
    "bsd-3-clause": [_BSD + _BSD_NAMES + _BSD_END],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License "
        '("Public License").',
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public "
        'License ("Public License").',
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public "
        'License ("Public License").',
    ],
    "cc0-1.0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "
        '"owner") of an original work of authorship and/or a database (each, a "Work").',
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0.",
        _GNU.format(**_PROGRAM, colon=";", name=_GPL, version="2") + _GNU_MAIL,
        _GNU.format(**_PROGRAM, colon=";", name=_GPL, version="2") + _GNU_WEB,
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        _GNU.format(**_PROGRAM, colon=":", name=_GPL, version="3") + _GNU_WEB,
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        _GNU.format(**_LIBRARY, colon=";", name=_LGPL, version="2.1") + _GNU_MAIL,
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License v3.0.",
        _GNU.format(**_LIBRARY, colon=":", name=_LGPL, version="3") + _GNU_WEB,
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions "
        "listed below.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution.",
    ],
}

#: Names that are no identifiers of a license list; all others are known by their tag too.
UNTAGGED = ("all-rights-reserved", "bsd")
TEMPLATES = {name: texts + [f"SPDX-License-Identifier: {name}"] * (name not in UNTAGGED) for name, texts in TEMPLATES.items()}


def bigrams(text: str) -> list[tuple[str, str]]:
    """The bigrams of a text, each once, in order."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return list(dict.fromkeys(zip(words, words[1:])))


def bounds(size: int, dice: float = DICE) -> tuple[int, int]:
    """Fewest and most bigrams of a span that can reach the coefficient with a template of this size."""
    fits = [n for n in range(1, int(size * (2 - dice) / dice) + 3) if 2 * min(n, size) >= dice * (n + size)]
    return fits[0], fits[-1]


def needed(size: int, dice: float = DICE) -> int:
    """Fewest bigrams that a span must share with a template of this size."""
    low, _ = bounds(size, dice)
    return next(n for n in range(1, size + 1) if 2.0 * n / (low + size) >= dice)


_RUNS = "array<struct<s:int,name:string,k:int,dice:double,e:int>>"
_PLACES = "struct<e:int,dice:double,name:string,n:bigint,names:array<string>,best:struct<d:double,name:string>>"


def _known(templates: dict[str, list[str]], dice: float) -> Column:
    """The templates as an array of (name, k, n, low, high, need, g)."""
    rows = []
    for name, texts in sorted(templates.items()):
        for k, t in enumerate(map(bigrams, texts)):
            low, high = bounds(len(t), dice)
            numbers = [F.lit(v).alias(c) for c, v in (("k", k), ("n", len(t)), ("low", low), ("high", high), ("need", needed(len(t), dice)))]
            rows.append(F.struct(F.lit(name).alias("name"), *numbers, F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in t]).alias("g")))
    return F.array(*rows)


def _pairs(n: Column, word) -> Column:
    """Hashes of the n - 1 pairs of neighbouring words, by position."""
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(word(i - 1), word(i)))).otherwise(F.array().cast("array<long>"))


def _candidates(text: Column, known: Column, templates: dict[str, list[str]], dice: float) -> Column:
    """Templates of which the whole text shares as many bigrams as a span needs."""
    every = list(dict.fromkeys(g for texts in templates.values() for t in texts for g in bigrams(t)))
    fewest = min(needed(len(bigrams(t)), dice) for texts in templates.values() for t in texts)
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(0))
    shared = let(words, lambda w: F.filter(_pairs(F.size(w), lambda i: w[i]), lambda g: g.isin([F.xxhash64(F.lit(a), F.lit(b)) for a, b in every])))
    enough = lambda found: F.filter(known, lambda t: F.size(F.array_intersect(t["g"], found)) >= t["need"])
    return let(shared, lambda g: F.when(F.size(g) >= fewest, enough(g)).otherwise(F.filter(known, lambda t: F.lit(False))))


def _words(text: Column) -> Column:
    """Words in order, each with a mark whether a piece begins with it."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+|\n|[.!?:;][ \t])"), F.lit(0))
    is_word = lambda w: w.rlike("^[a-z0-9]")
    first = lambda t, i: (i == 0) | ~is_word(F.get(t, i - 1))
    return let(tokens, lambda t: F.filter(F.transform(t, lambda w, i: F.struct(w.alias("w"), first(t, i).alias("first"))), lambda x: is_word(x["w"])))


def _runs(text: Column, candidates: Column, dice: float) -> Column:
    """Runs that reach a candidate, the best from each piece on, by start, name and template.

    ``s`` is the number of a run's first word, ``e`` that of the first word after it.
    """

    def from_start(m: Column, g: Column, t: Column, s: Column) -> Column:
        n = F.size(m)
        ends = F.filter(F.sequence(s + t["low"] + 1, F.least(s + t["high"] + 1, n)), lambda e: (e == n) | F.get(m, e)["first"])
        share = lambda a: 2.0 * F.size(F.array_intersect(t["g"], a)) / (F.size(a) + t["n"])
        tries = F.transform(ends, lambda e: F.struct(let(F.array_distinct(F.slice(g, s + 1, e - s - 1)), share).alias("dice"), (-e).alias("e")))
        best = F.array_max(F.when(s + t["low"] + 1 <= n, tries))
        return let(best, lambda b: F.struct(s.alias("s"), t["name"].alias("name"), t["k"].alias("k"), b["dice"].alias("dice"), (-b["e"]).alias("e")))

    def of_template(m: Column, g: Column, starts: Column, t: Column) -> Column:
        hopeful = F.filter(starts, lambda s: F.size(F.array_intersect(t["g"], F.slice(g, s + 1, t["high"]))) >= t["need"])
        return F.filter(F.transform(hopeful, lambda s: from_start(m, g, t, s)), lambda r: r["dice"] >= dice)

    def of_words(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i)["first"])
        each = lambda g: let(starts, lambda p: F.flatten(F.transform(candidates, lambda t: of_template(m, g, p, t))))
        return let(_pairs(F.size(m), lambda i: m[i]["w"]), each)

    return F.when(F.size(candidates) > 0, F.array_sort(let(_words(text), of_words)).cast(_RUNS)).otherwise(F.array().cast(_RUNS))


def _places(runs: Column) -> Column:
    """Runs to places that do not overlap: their number, their names and the best of them."""

    def closed(a: Column) -> list[Column]:
        held = a["e"].isNotNull()
        better = held & (a["best"]["d"].isNull() | (a["dice"] > a["best"]["d"]) | ((a["dice"] == a["best"]["d"]) & (a["name"] < a["best"]["name"])))
        return [
            F.when(held, a["n"] + 1).otherwise(a["n"]).alias("n"),
            F.when(held, F.array_union(a["names"], F.array(a["name"]))).otherwise(a["names"]).alias("names"),
            F.when(better, F.struct(a["dice"].alias("d"), a["name"].alias("name"))).otherwise(a["best"]).alias("best"),
        ]

    def step(a: Column, r: Column) -> Column:
        hold = [r["e"].alias("e"), r["dice"].alias("dice"), r["name"].alias("name")]
        instead = F.struct(*hold, a["n"].alias("n"), a["names"].alias("names"), a["best"].alias("best"))
        overlap = F.coalesce(r["s"] < a["e"], F.lit(False))
        return F.when(overlap & (r["dice"] > a["dice"]), instead.cast(_PLACES)).when(overlap, a).otherwise(F.struct(*hold, *closed(a)).cast(_PLACES))

    none = F.struct(F.lit(None).alias("e"), F.lit(None).alias("dice"), F.lit(None).alias("name"), F.lit(0).alias("n"), F.array().alias("names"), F.lit(None).alias("best"))
    return F.aggregate(runs, none.cast(_PLACES), step, lambda a: F.struct(*closed(a)))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """Per row: doc_id, licenses (the names found, sorted, with commas between), n_spans (places
    where one was found), best_license and best_dice (the greatest coefficient; null if none)."""
    text, known = F.coalesce(F.col("text"), F.lit("")), _known(templates, dice)
    found = let(_candidates(text, known, templates, dice), lambda c: _places(_runs(text, c, dice)))
    rows = docs.select("doc_id", found.alias("_found"))
    names = F.array_join(F.array_sort("_found.names"), ",")
    best = F.col("_found.best")
    return rows.select("doc_id", names.alias("licenses"), F.col("_found.n").alias("n_spans"), best["name"].alias("best_license"), best["d"].alias("best_dice"))


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    sized = [(name, k, bigrams(t)) for name, texts in sorted(TEMPLATES.items()) for k, t in enumerate(texts)]
    rows = ", ".join(f"({q(name)}, {k}, {q(a + ' ' + b)})" for name, k, t in sized for a, b in t)
    sizes = ", ".join("({}, {}, {}, {}, {})".format(q(name), k, len(t), *bounds(len(t))) for name, k, t in sized)
    return rf"""
WITH RECURSIVE t(name, k, g) AS (VALUES {rows}), ts(name, k, b, low, high) AS (VALUES {sizes}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[.!?:;][ \t]', chr(10), 'g'), '[a-z0-9]+|\n') AS x FROM documents),
x AS (SELECT row, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM d),
y AS (SELECT row, w, i, coalesce(lag(w) OVER (PARTITION BY row ORDER BY i), chr(10)) = chr(10) AS first FROM x),
w AS (SELECT row, w, first, row_number() OVER (PARTITION BY row ORDER BY i) - 1 AS i FROM y WHERE w <> chr(10)),
g AS (SELECT row, i, w || ' ' || lead(w) OVER (PARTITION BY row ORDER BY i) AS g FROM w),
c AS (SELECT row, name, k FROM g JOIN t USING (g) JOIN ts USING (name, k) GROUP BY row, name, k, b HAVING 2 * count(DISTINCT g) >= {DICE} * b),
p AS (SELECT row, i FROM w WHERE first AND row IN (SELECT row FROM c) UNION ALL SELECT row, max(i) + 1 FROM w WHERE row IN (SELECT row FROM c) GROUP BY row),
r AS (SELECT c.row, c.name, c.k, ts.b, s.i AS s, e.i AS e FROM c JOIN ts USING (name, k) JOIN p s ON s.row = c.row JOIN p e ON e.row = c.row AND e.i - s.i - 1 BETWEEN ts.low AND ts.high),
a AS (SELECT r.row, r.name, r.k, r.b, r.s, r.e, count(DISTINCT g.g) AS a, count(DISTINCT t.g) AS shared
      FROM r JOIN g ON g.row = r.row AND g.i >= r.s AND g.i < r.e - 1 LEFT JOIN t ON t.name = r.name AND t.k = r.k AND t.g = g.g GROUP BY ALL),
h AS (SELECT *, 2.0::DOUBLE * shared / (a + b) AS dice FROM a WHERE dice >= {DICE} QUALIFY row_number() OVER (PARTITION BY row, name, k, s ORDER BY dice DESC, e) = 1),
o AS (SELECT row, name, s, e, dice, row_number() OVER (PARTITION BY row ORDER BY s, name, k) AS j FROM h),
f AS (SELECT row, j, s, e, dice, name, 1 AS place FROM o WHERE j = 1
      UNION ALL
      SELECT o.row, o.j, CASE WHEN o.s >= f.e OR o.dice > f.dice THEN o.s ELSE f.s END, CASE WHEN o.s >= f.e OR o.dice > f.dice THEN o.e ELSE f.e END,
             CASE WHEN o.s >= f.e OR o.dice > f.dice THEN o.dice ELSE f.dice END, CASE WHEN o.s >= f.e OR o.dice > f.dice THEN o.name ELSE f.name END,
             f.place + CASE WHEN o.s >= f.e THEN 1 ELSE 0 END
      FROM f JOIN o ON o.row = f.row AND o.j = f.j + 1),
l AS (SELECT row, place, name, dice FROM f QUALIFY row_number() OVER (PARTITION BY row, place ORDER BY j DESC) = 1),
z AS (SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_spans, first(name ORDER BY dice DESC, name) AS best_license, max(dice) AS best_dice FROM l GROUP BY row)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_spans, 0)::BIGINT AS n_spans, best_license, best_dice FROM d LEFT JOIN z USING (row)"""


SQL = _sql()

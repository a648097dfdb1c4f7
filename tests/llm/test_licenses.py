"""License scan against plain Python, and the layouts licenses come in."""

import re
import textwrap

import pytest
from sumveil.llm import licenses as li

SCHEMA = "doc_id long, text string, licenses string, best string, n int"
MIT = li.TEMPLATES["mit"][2]
APACHE = li.TEMPLATES["apache-2.0"][1]
GPL3 = li.TEMPLATES["gpl-3.0"][2]


def wrapped(text, width=72, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def paragraphs(text, *ends):
    """The text wrapped, with a blank line after each of these endings."""
    for end in ends:
        text = text.replace(end + " ", end + "\n\n", 1)
    return "\n\n".join(wrapped(p) for p in text.split("\n\n"))


MIT_FILE = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + paragraphs(MIT, "following conditions:", "portions of the Software.")
APACHE_HEADER = "Copyright 2020 Some Body\n\n" + paragraphs(APACHE, '"License");', "LICENSE-2.0") + "\n\nimport os\n"
LAYOUTS = [
    (MIT_FILE, "mit"),
    (wrapped(MIT, mark=" * "), "mit"),
    (APACHE_HEADER, "apache-2.0"),
    ("This module reads files. It was written long ago. " + APACHE + " And the text goes on here without a break", "apache-2.0"),
    (wrapped("This module reads files. It was written long ago. " + APACHE + " And the text goes on. " * 9), "apache-2.0"),
    (paragraphs(GPL3, "any later version.", "more details."), "gpl-3.0"),
    (wrapped(li.TEMPLATES["gpl-2.0"][2], mark="// "), "gpl-2.0"),
    (wrapped(li.TEMPLATES["lgpl-2.1"][1], mark="# "), "lgpl-2.1"),
    (wrapped(li.TEMPLATES["lgpl-3.0"][2]), "lgpl-3.0"),
    (wrapped(li.TEMPLATES["agpl-3.0"][2]), "agpl-3.0"),
    ("Copyright (c) 2020, Some Body\n\n" + paragraphs(li.TEMPLATES["bsd-2-clause"][0], "are met:", "the following disclaimer.", "with the distribution."), "bsd-2-clause"),
    (paragraphs(li.TEMPLATES["bsd-3-clause"][0], "are met:", "the following disclaimer.", "with the distribution.", "written permission."), "bsd-3-clause"),
    (paragraphs(li.TEMPLATES["isc"][1], "in all copies."), "isc"),
    (wrapped(li.TEMPLATES["zlib"][0]), "zlib"),
    (wrapped(li.TEMPLATES["mpl-2.0"][0]), "mpl-2.0"),
    (MIT_FILE + "\n\n" + APACHE_HEADER, "apache-2.0,mit"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os", "gpl-2.0"),
    ("// SPDX-License-Identifier: BSD-3-Clause\r\n\r\nint main", "bsd-3-clause"),
]
TEXTS = [
    None, "", "\n\n \n", "Some text.\nReleased under the MIT License.", "released UNDER the mit license", "Released under the license.",
    "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.\nMore text here.",
    "Copyright somebody\n\n" + "\n".join(MIT[i : i + 70] for i in range(0, len(MIT), 70)) + "\n\nTail of it", MIT.replace("deal", "trade").replace("merge", "join"),
    "MIT License " * 40, "one two " * 60_000, "a", "Licensed under CC BY-NC 4.0.\r\nx", "é Licensed under the Apache License, Version 2.0. é",
    "All rights reserved. All rights reserved.\nAll rights reserved", "Released under the MIT License.\n" * 300, "All rights\nreserved. Released\n\nunder the\nBSD License",
    *[t for t, _ in LAYOUTS],
]


def brute(text):
    words, first, fresh = [], [], True
    for token in re.findall(r"[a-z0-9]+|\n|[.!?:;][ \t]", (text or "").lower()):
        if token[0].isalnum():
            words.append(token)
            first.append(fresh)
        fresh = not token[0].isalnum()
    starts = [i for i, f in enumerate(first) if f]
    pairs = list(zip(words, words[1:]))
    runs = []
    for name, texts in li.TEMPLATES.items():
        for k, t in enumerate(texts):
            b = set(li.bigrams(t))
            if not b & set(pairs):
                continue
            low, high = li.bounds(len(b))
            for s in starts:
                tries = []
                for e in [*starts, len(words)]:
                    if low <= e - s - 1 <= high:
                        a = set(pairs[s : e - 1])
                        tries.append((-2.0 * len(a & b) / (len(a) + len(b)), e))
                if tries and -min(tries)[0] >= 0.8:
                    runs.append((s, name, k, -min(tries)[0], min(tries)[1]))
    places = []
    for run in sorted(runs):
        if not places or run[0] >= places[-1][4]:
            places.append(run)
        elif run[3] > places[-1][3]:
            places[-1] = run
    best = min(((-p[3], p[1]) for p in places), default=None)
    return ",".join(sorted({p[1] for p in places})), len(places), best and best[1], best and -best[0]


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, "x", None, 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "", "", 0), (3, TEXTS[3], "", "", 0)], SCHEMA)
    got = li.scan(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        t = TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[3]
        assert (r.licenses, r.n_spans, r.best_license, r.best_dice) == brute(t), r
    found = {r.doc_id: r for r in got}
    for i, (_, names) in enumerate(LAYOUTS, len(TEXTS) - len(LAYOUTS)):
        assert found[i].licenses == names, (TEXTS[i], found[i])
    assert found[TEXTS.index("Released under the MIT License.\n" * 300)].n_spans == 300
    plan = li.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert li.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_finds_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs = spark.createDataFrame([(i, t, "x", None, 1) for i, t in enumerate(TEXTS)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert sorted(con.execute(li.SQL).fetchall()) == sorted(tuple(r) for r in li.scan(docs).collect())


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "x. One two three four. y"), (2, "one two four")], "doc_id long, text string")
    got = li.scan(docs, {"mine": ["one two three four"], "other": ["two four"]}, 0.9).orderBy("doc_id").collect()
    assert [(r.licenses, r.n_spans) for r in got] == [("mine", 1), ("", 0)]


def test_bounds_prune_no_match():
    for size in (1, 2, 7, 40):
        low, high = li.bounds(size)
        for n in range(1, 3 * size):
            assert (low <= n <= high) == (2 * min(n, size) / (n + size) >= 0.8)
            if low <= n <= high:
                reach = [s for s in range(min(n, size) + 1) if 2.0 * s / (n + size) >= 0.8]
                assert min(reach) >= li.needed(size)

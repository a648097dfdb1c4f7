"""Spelling variants against comparing all words with all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from sumveil.llm import kd_spelling as kd
from sumveil.llm.queries import op12_spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    forms, rows = {}, []
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v)) if others else None
        forms[w] = best if best and counts[best] >= ratio * n else None
        rows.append((w, forms[w], n, len(others), counts[forms[w]] if forms[w] else None))
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return sorted((w, f, root(w), n, k, m) for w, f, n, k, m in rows)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def some_words(rng, n, letters):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n // 4)]
    words = Counter()
    for _ in range(n):
        w = rng.choice(base)
        k = rng.randrange(len(w))
        w = rng.choice([w, w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], "".join(rng.sample(w, len(w)))])
        if w:
            words[w] += rng.choice([1, 2, 3, 4, 8, 16, 40])
    return words


SIZES = [(48, 8192, 1 << 18, 400_000), (2, 16, 1 << 18, 400_000), (2, 16, 8, 60)]


@pytest.mark.parametrize("leaf, cell, queries, sample", SIZES)
@pytest.mark.parametrize("letters", ["ab", "abcdeé", "aàÿ×zñ漢字ΩAZ😀"])
def test_equals_all_pairs(spark, monkeypatch, leaf, cell, queries, sample, letters):
    for name, value in (("LEAF", leaf), ("CELL", cell), ("QUERIES", queries), ("SAMPLE", sample), ("FEWEST", 4)):
        monkeypatch.setattr(kd, name, value)
    counts = some_words(random.Random(len(letters) + leaf), 300, letters)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    if cell == 16:
        tops, blocks = kd.fit_tops(df)
        assert any(t.n_cells > 1 for t in tops.values())
        assert bool(blocks) == (queries == 8)
    assert got(kd.variants(df)) == brute(counts)


def test_search_finds_all_within_reach():
    rng = np.random.default_rng(5)
    points, queries = rng.integers(0, 3, (400, kd.DIMS)) * (rng.random((400, kd.DIMS)) < 0.2), rng.integers(0, 3, (300, kd.DIMS)) * (rng.random((300, kd.DIMS)) < 0.2)
    queries[:100] = points[:100]
    for ups, downs in ((1, 1), (1, 0)):
        queries[100:200] = points[100:200]
        for i in range(100, 200):
            queries[i, rng.integers(kd.DIMS)] += downs
            queries[i, np.flatnonzero(queries[i] > 0)[:1]] -= 1
        want = {(i, j) for i in range(300) for j in range(400) if (np.maximum(points[j] - queries[i], 0).sum() <= ups) and (np.maximum(queries[i] - points[j], 0).sum() <= downs)}
        pairs = {(a, b) for i, j in kd.search(points, queries, ups, downs) for a, b in zip(i.tolist(), j.tolist())}
        assert want and want <= pairs
    top = kd.Top(points, 100.0)
    cells = top.cells_of(points)
    assert top.n_cells > 4 and len(cells) == 400
    rows, reached = top.reach(queries, 1, 1)
    reach = set(zip(rows.tolist(), reached.tolist()))
    assert all((i, cells[j]) in reach for i in range(300) for j in range(400) if np.maximum(points[j] - queries[i], 0).sum() <= 1 and np.maximum(queries[i] - points[j], 0).sum() <= 1)


def test_one_edit_checks_letter_order():
    words = ["".join(x) for x in ("abc", "acb", "abd", "bcd", "aaa", "aab")]
    longer = ["abcd", "abdc", "aaab", "aaaa", "bbcd"]
    for a in words:
        for b in words + longer:
            if len(b) >= len(a):
                x, y = kd.codes_of([a]).reshape(1, -1), kd.codes_of([b]).reshape(1, -1)
                assert kd.one_edit(x, y)[0] == near(a, b)


def test_chains_and_ties(spark):
    rows = [("aaaaaa", 3), ("aaaaab", 6), ("aaaabb", 12), ("aaabbb", 24), ("zzzzz", 3), ("zzzzy", 6), ("zzzzx", 6), ("lonely", 9), (None, 5), ("nothing", None), ("split", 2), ("split", 2)]
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in kd.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert out["aaaaaa"] == ("aaaaab", "aaabbb", 3, 1, 6) and out["aaabbb"] == (None, "aaabbb", 24, 1, None)
    assert out["zzzzz"] == ("zzzzx", "zzzzx", 3, 2, 6) and out["zzzzx"] == (None, "zzzzx", 6, 2, None)
    assert out["lonely"] == (None, "lonely", 9, 0, None) and out["split"] == (None, "split", 4, 0, None)
    assert len(out) == 9


def test_empty_long_and_extra_columns(spark):
    empty = spark.createDataFrame([], "word string, n long, form string")
    assert kd.variants(empty).count() == 0
    long = "ab" * 3000
    rows = [(long, 1, "x", 7), (long[1:], 4, "x", 7), (long + "b", 2, None, None)]
    out = got(kd.variants(spark.createDataFrame(rows, "word string, n long, form string, _w int")))
    assert out == brute({w: n for w, n, *_ in rows})


def brute_documents(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return brute({w: n for w, n in counts.items() if n >= 3})


def test_documents(spark):
    rng = random.Random(8)
    words = ["Straße", "STRASSE", "colour", "Color", "colours", "naïve", "Naive", "naives", "ÉTUDE", "étude", "x", "a" * 9000]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(400)] + [(None, "colour colour"), (5, None), (6, ""), (7, "1 2 3 ..."), (5, "colour")] * 2
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, run string, word string")
    out = got(kd.variants(kd.frequent(kd.with_slips(kd.letter_runs(docs)))))
    assert out == brute_documents(rows) and len(out) > 20


def test_query_equals_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got(op12_spelling(spark, "/root/testdata/sf0.001")) == brute_documents(rows)

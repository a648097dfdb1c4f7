"""Periodic runs against trying every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from sumveil.llm import periodic_runs as pr
from sumveil.llm.queries import op13_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every stretch that equals itself one period on, shorter periods first."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and j > i and not any(a <= s and e <= b for a, b, _ in out):
                out.append((s, e, q))
            i = j + 1
    return sorted((s, e, q) for s, e, q in out)


def collapsed(w, runs):
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    return [x for i, x in enumerate(w) if i not in drop]


def pieces(rng, n, kinds):
    w = []
    while len(w) < n:
        part = [rng.randrange(kinds) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13]))]
        if rng.random() < 0.5:
            part = part * rng.randrange(2, 9) + part[: rng.randrange(len(part) + 1)]
        if rng.random() < 0.1:
            part = (part + [rng.randrange(kinds)]) * 5
        w += part
    return w[:n]


@pytest.mark.parametrize("kinds", [1, 2, 3, 10])
def test_runs_of_random_words(kinds):
    rng = random.Random(kinds)
    for _ in range(60):
        docs = [pieces(rng, rng.choice([0, 1, 5, 6, 7, 30, 80, 200]), kinds) for _ in range(rng.randrange(1, 6))]
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        codes = np.array([x for d in docs for x in d], np.int64)
        want = [[s + b, e + b, q] for d, b in zip(docs, bounds) for s, e, q in brute(d)]
        assert pr.find_runs(codes, bounds).tolist() == want


def test_every_short_text_of_two_words():
    for n in range(4, 15):
        for k in range(1 << n):
            w = [k >> i & 1 for i in range(n)]
            if k % 7 == 0 or n < 12:
                assert [tuple(r) for r in pr.find_runs(np.array(w), np.array([0, n])).tolist()] == brute(w)


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, pr.PRIME, (2, 3, 64)).astype(np.uint64)
    assert (pr.inverse_ntt(pr.ntt(a)) == a).all()
    product = pr.inverse_ntt(pr.ntt(a) * pr.ntt(b) % np.uint64(pr.PRIME))
    for r in range(3):
        want = [sum(int(a[r, j]) * int(b[r, (k - j) % 64]) for j in range(64)) % pr.PRIME for k in range(64)]
        assert product[r].tolist() == want


@pytest.mark.parametrize("block", [1, 2, 8, 64])
def test_convolution_finds_all_equal_blocks(block):
    x = np.concatenate([np.random.default_rng(block).integers(0, 2 if block < 8 else 1 + block // 64, 40 * block), np.full(3 * block, 9)])
    at = np.arange(0, 38 * block, block)
    got = set(zip(*(v.tolist() for v in pr.zero_mismatches(x, at, block))))
    assert got == {(s, d) for s in at.tolist() for d in range(block, 2 * block) if (x[s : s + block] == x[s + d : s + d + block]).all()}


def test_multiples_of_the_prime_are_rejected(monkeypatch):
    real = pr.zero_mismatches
    everything = lambda x, at, block: tuple(np.array([(s, d) for s in range(len(x) - 3 * block) for d in range(block, 2 * block)], np.int64).reshape(-1, 2).T)
    w = pieces(random.Random(4), 120, 3)
    monkeypatch.setattr(pr, "zero_mismatches", everything)
    with_all = pr.find_runs(np.array(w), np.array([0, len(w)])).tolist()
    monkeypatch.setattr(pr, "zero_mismatches", real)
    assert with_all == pr.find_runs(np.array(w), np.array([0, len(w)])).tolist() == [list(r) for r in brute(w)]


def test_long_texts_take_little_work():
    n = 400_000
    for w in (np.zeros(n, np.int64), np.arange(n) % 7, np.arange(n) % 50_000, np.arange(n), (np.arange(n) % 11 == 0) * 1):
        found = pr.find_runs(w, np.array([0, n])).tolist()
        period = next((q for q in (1, 7, 11, 50_000) if (w[q:] == w[:-q]).all()), None)
        zeros = [[a, min(a + 10, n), 1] for a in range(1, n, 11) if min(a + 10, n) - a >= 6] if period == 11 else []
        assert found == sorted(([[0, n, period]] if period else []) + zeros)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def planted(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def expected(i, text, runs_of=brute):
    w = planted(i, text)
    runs = runs_of(w)
    top = None
    for s, e, q in runs:
        if top is None or (e - s) * top[2] > top[1] * q:
            top = (s, e - s, q)
    start, length, period = top or (None, None, None)
    return (i, len(runs), start, length, period, 1000 * length // period if top else None, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(collapsed(w, runs))))


ODD = [
    (None, "a a a a a a", "x", 1),
    (None, None, "x", 1),
    (3, None, None, 1),
    (1, "", "x", 1),
    (4, " \t\n\x0b\x0c\r ", "x", 1),
    (2, "\x1c\xa0x y\x0bx y x\ty x y z", "x", None),
    (2, "\x1c\xa0x y\x0bx y x\ty x y z", "x", None),
    (6, "one", "x", 1),
    (9, "word " * 30_000, "x", 1),
    *((i, " ".join(f"w{k * k % (7 + i)}" for k in range(i % 90)), "x", 1) for i in range(10, 200)),
]


@pytest.mark.parametrize("slice_bytes", [32, 4 << 20])
def test_operator(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(pr, "SLICE_BYTES", slice_bytes)
    docs = spark.createDataFrame(ODD, "doc_id long, text string, runs string, collapsed int")
    got = [tuple(r) for r in pr.digests(pr.runs(pr.with_loops(docs))).collect()]
    fast = lambda w: [(0, len(w), 1)] if len(w) > 10_000 else brute(w)
    want = [expected(i, t, fast) for i, t, *_ in ODD]
    key = lambda r: (r[0] or -1, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(want, key=key)
    texts = {r.doc_id: r.collapsed for r in pr.runs(docs).collect() if r.doc_id}
    assert texts[9] == "word" and texts[2] == "\x1c\xa0x y x y x y x y z"
    assert pr.runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_are_split_at_blanks_and_controls_only():
    texts = ["", " a  b\tc\n", "\x1c\x85 ​", "\r\x0b\x0c", "é漢　x y"]
    got, bounds = pr.text_words(pa.array(texts))
    assert [got.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:])] == [WORD.findall(t) for t in texts]


def test_query_equals_trying_every_period(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {r.doc_id: expected(r.doc_id, r.text) for r in rows if len(r.text or "") < 12_000}
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows) and {i: got[i] for i in want} == want
    assert sum(r[1] > 0 for r in got.values()) > len(rows) // 20

"""SimHash groups and components against brute force."""

import random

import numpy as np
import pytest
from sumveil.llm import simhash
from sumveil.llm.graph import components
from xxhash import xxh64_intdigest


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 260)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    want = union(300, pairs)
    got = {r.id: r.component for r in components(spark.createDataFrame([*pairs, *pairs[:9]], "a long, b long")).collect()}
    assert got == {i: want[i] for a, b in pairs for i in (a, b) if a != b} | {i: want[i] for i in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def prints():
    rng = random.Random(5)
    out = {0, (1 << 64) - 1}
    for _ in range(25):
        center = rng.getrandbits(64)
        for _ in range(12):
            x = center
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    half = rng.getrandbits(32)
    out |= {half << 32 | rng.getrandbits(32) for _ in range(40)}
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("parts, crowded", [(2, 1000), (2, 3), (4, 1000)])
def test_links_find_all_groups(spark, parts, crowded):
    fp = prints()
    near = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2]
    want = union(len(fp), near)
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = [(at[r.a], at[r.b]) for r in simhash.links(frame, parts, crowded).collect()]
    assert set(map(frozenset, got)) <= set(map(frozenset, near))
    assert union(len(fp), got) == want


def test_thresholds_add_up_and_cost_least():
    rng = np.random.default_rng(1)
    g = rng.integers(-(1 << 63), 1 << 63, 200)
    hist = np.stack([np.bincount(x, minlength=256) for x in g.astype("<i8").view(np.uint8).reshape(-1, 8).T]).astype(float)
    t = simhash.thresholds(g, simhash._at_distance(hist, 2), 200.0, 2, 2)
    assert set(t.sum(1).tolist()) == {1} and t.min() >= -1


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


SCHEMA = "doc_id long, text string, digest string, fp int, source string"


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = ["", None, " \t", "One", "one", "A b", base, base.upper().lower(), base + " end", "É É É x", "a b c a b c " * 9000]
    rows = [(i, t, "x", None, "s") for i, t in enumerate(texts)] + [(6, base, "x", 1, "s"), (6, "other text with this id", "x", 1, "s"), (None, "no id here", "", 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted(((i if i is not None else -1) or -1, f"{brute_print(t):016x}") for i, t, *_ in rows)
    fps = [int(r.fingerprint, 16) for r in got]
    group = union(len(got), [(i, j) for i in range(len(got)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for i, r in enumerate(got):
        ids = [got[j].doc_id for j in range(len(got)) if group[j] == group[i] and got[j].doc_id is not None]
        assert r.component_id == min(ids, default=None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0

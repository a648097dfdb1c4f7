"""Mixing against a plain computation in Python."""

import hashlib
import math
import random
import re

import pytest
from sumveil.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def share(sizes, weights=(5.0, 2.0, 1.0), total=1.5, most=2.0):
    """Targets by giving shares again until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = total * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def brute(rows):
    """(doc_id, size, source_size, taken) sorted."""
    docs = []
    for i, source, text, *_ in rows:
        digest = hashlib.md5(f"0:{'null' if i is None else i}".encode()).hexdigest()
        u = (int(digest[:12], 16) + 0.5) / (1 << 48)
        noise = len(re.findall(mixing.NOISE, text or "")) / max(1, len(text or ""))
        weight = max(mixing.LEAST_WEIGHT, 1 - 10 * noise) if text is not None else mixing.LEAST_WEIGHT
        docs.append((source, -math.log(u) / weight, i, len(WORD.findall(text or ""))))
    sizes = {}
    for s, _, _, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    target, out = share(sizes), []
    for s, total in sizes.items():
        epochs = int(target[s] // total) if total else 0
        left = math.floor(target[s] + 1e-9) - epochs * total
        for _, _, i, n in sorted((d for d in docs if d[0] == s), key=lambda d: (d[1], -1 if d[2] is None else d[2], d[3])):
            part = max(0, min(n, left))
            left -= part
            out.append((i, n, total, epochs * n + part))
    return sorted(out, key=str)


def texts(rng, n, noisy=0.0):
    return [" ".join("#$%" if rng.random() < noisy else "word" for _ in range(rng.randrange(1, 40))) for _ in range(n)]


CLASHES = "doc_id long, source string, text string, n_chars long, part int, epochs string, _d int, _s int, _row int, _words int, _k int, size int, target int"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, None if t is None else len(t), 1, "e", 2, 3, 4, 5, 6, 7, 8) for i, s, t in rows], CLASHES)


def cases():
    rng = random.Random(2)
    plain = [(i, rng.choice(["a", "a", "a", "b", "c", None, ""]), t) for i, t in enumerate(texts(rng, 300))]
    odd = [(None, "a", "x y z"), (None, "a", "x y"), (1, "a", None), (2, "b", ""), (3, "b", " \t\n"), (3, "b", "same row"), (3, "b", "same row"), (4, None, "w " * 5000), (5, "empty", None)]
    noisy = [(i, "only", t) for i, t in enumerate(texts(rng, 400, 0.6))] + [(1000 + i, "z", t) for i, t in enumerate(texts(rng, 100))]
    equal = [(7, "a", "one two three")] * 50 + [(8, "b", "four")] * 20
    return {"plain": plain, "odd": plain[:60] + odd, "noisy": noisy, "equal": equal, "one": [(1, "a", "x")]}


@pytest.mark.parametrize("edge", [50_000, 20])
@pytest.mark.parametrize("name", list(cases()))
def test_equals_brute_force(spark, monkeypatch, name, edge):
    monkeypatch.setattr(mixing, "EDGE", edge)
    rows = cases()[name]
    df = frame(spark, rows)
    got = mixing.taken(mixing.mix(df)).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in got), key=str) == want
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    assert {round(r.target, 6) for r in got} == {round(v, 6) for v in share(sizes).values()}
    assert all(r.taken <= 2 * r.size for r in got)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text or ""))
        assert r.n_chars == (None if r.text is None else len(r.text)) and (r.part, r.epochs, r._d, r._row) == (1, "e", 2, 4)
    taken = {}
    for i, _, _, n in want:
        taken[i] = taken.get(i, 0) + n
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in taken.items() if n}


def test_edge_bucket_of_noisy_texts_is_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE", 30)
    seen = []
    real = mixing._dealt
    monkeypatch.setattr(mixing, "_dealt", lambda rows, edges: seen.append(real(rows, edges)) or seen[-1])
    df = frame(spark, cases()["noisy"])
    mixing.mix(df, total=0.9)
    sizes = [d.filter("_case = 'edge' and source = 'only'").count() for d in seen]
    assert len(sizes) > 1 and sizes[0] > 100 and sizes[-1] <= 30


def test_empty_table(spark):
    df = frame(spark, [])
    assert mixing.taken(mixing.mix(df)).count() == 0 and mixing.mixed_documents(df).count() == 0

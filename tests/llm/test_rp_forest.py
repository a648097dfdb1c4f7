"""Forest links against brute force."""

import numpy as np
import pandas as pd
from sumveil.llm import rp_forest

SCHEMA = "vec_id long, embedding array<float>, label int, node string, weight int"


def table(seed=0, n=300, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((i, rng.standard_normal(dim).astype(np.float32).tolist(), i % 3))
    for i in range(150):  # near copies, some at the threshold
        base = np.array(rows[int(rng.integers(40))][1])
        rows.append((n + i, (base + rng.standard_normal(dim) * rng.choice([0.02, 0.15, 0.2])).astype(np.float32).tolist(), int(rng.integers(3))))
    center = rng.standard_normal(dim)
    rows += [(2000 + i, (center + rng.standard_normal(dim) * 0.01).astype(np.float32).tolist(), 1) for i in range(90)]  # cannot be split
    rows += [(3000 + i, rows[5][1], 2) for i in range(50)]  # copies
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(4000 + i, v, 0) for i, v in enumerate(bad)] + [(4010, rows[5][1], None), (4011, [1.0] * 5, 0), (4012, [1.0] * 5, 0), (4012, [1.0] * 5, 0), (None, [1.0] * 5, 0)]
    return rows


def brute(rows):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links, parent = [set() for _ in rows], list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            (_, a, k), (_, b, m) = rows[i], rows[j]
            if k is not None and k == m and ok(a) and ok(b) and len(a) == len(b):
                a, b = np.array(a, np.float64), np.array(b, np.float64)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
                    parent[find(i)] = find(j)
    out = []
    for i in range(n):
        c = min((rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), c, rows[i][0] == c))
    return sorted(out, key=str)


def test_links_and_components(spark):
    rows = table()
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    want = brute(rows)
    got = sorted((tuple(r) for r in rp_forest.near_duplicates(frame, leaf=40, block=32).collect()), key=str)
    assert len(got) == len(want)
    linked = sum(w[1] for w in want)
    assert sum(g[1] for g in got) <= linked and sum(g[1] for g in got) >= 0.99 * linked
    assert sum(a != b for a, b in zip(got, want)) <= 0.01 * len(want)
    assert [g for g in got if g[0] is None or g[0] >= 4000] == [w for w in want if w[0] is None or w[0] >= 4000]
    assert rp_forest.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chains_and_stars_stay_whole(spark):
    """Groups that are no cliques, whatever the order of their classes in a leaf or block."""
    rng, rows = np.random.default_rng(3), []
    around = lambda base, cosine: cosine * base + np.sqrt(1 - cosine**2) * (lambda v: v / np.linalg.norm(v))((v := rng.standard_normal(32)) - (v @ base) * base)
    for _ in range(12):  # each copy links to the base only
        base = around(np.eye(32)[0], 0.0)
        rows += [(len(rows) + k, v.tolist(), len(rows) % 2) for k, v in enumerate([base, *(around(base, 0.985) for _ in range(15))])]
    for k in range(24):  # each step links to the next only
        rows.append((1000 + k, [float(np.cos(0.15 * k)), float(np.sin(0.15 * k))] + [0.0] * 30, 5))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA.replace("float", "double"))
    want = brute(rows)
    assert any(w[1] == 1 for w in want) and any(w[1] == 15 for w in want)
    for block in (2048, 40):
        assert sorted((tuple(r) for r in rp_forest.near_duplicates(frame, block=block).collect()), key=str) == want


def test_compare_joins_paths():
    # path a-p-q-b with ids 0, 2, 3, 1
    angle = {0: 0.0, 2: 0.15, 3: 0.30, 1: 0.45}
    rows = pd.DataFrame({"cid": list(angle), "weight": 1, "vector": [[np.cos(t), np.sin(t)] for t in angle.values()], "leaves": [[7]] * 4})
    got = rp_forest._compare(7, rows, None, 0.98)
    assert dict(zip(got["cid"], got["low"])) == dict.fromkeys(angle, 0) and list(got["links"]) == [1, 2, 2, 1]


def test_dense_cluster_of_different_vectors(spark):
    rng, n, dim = np.random.default_rng(5), 3000, 64
    base = np.eye(dim)[0]
    around = rng.standard_normal((n, dim)) * (1 - base)
    x = np.sqrt(0.981) * base + np.sqrt(1 - 0.981) * around / np.linalg.norm(around, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(n + i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((n, dim)))]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA.replace("float", "double"))
    got = {r.vec_id: r for r in rp_forest.near_duplicates(frame).collect()}
    links = np.array([got[i].n_links for i in range(2 * n)])
    assert want.sum() > 2_000_000 and (links <= want).all() and links.sum() >= 0.9999 * want.sum()
    assert all(got[i].component_id == 0 for i in range(n))

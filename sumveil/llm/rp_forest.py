"""Embedding near-duplicates with a forest of random-projection trees.

Vectors are compared within a label.  Equal vectors become one class with a count first,
so copies cost nothing later.  Every tree splits its points by random directions near
the median projection; points close to the split go to both sides (spill).  Nodes that
are still too large are split again, round by round: a round fits small subtrees on a
bounded sample of each large node, in parallel, and moves that node's points down; finished
leaves stay where they were written.  In a leaf all
pairs are compared in double precision.  A pair that meets in several leaves counts in
the first that both share, so no pair is ever written: a leaf gives each of its classes
a number of links and the smallest class of the group it is part of within the leaf, and
the union of those is taken over the table of classes.

The overlap of a split is as wide as needed for a pair at the threshold to be cut with a
probability of LOSS at most, given how dense the points lie there.  A node so dense that
too many points would go to both sides is not split; if it is larger than a leaf, its
pairs are dealt in blocks over several tasks, and all are compared.  A pair is missed only
if every tree cuts it; the density is estimated on a sample, so the bound is a mean.

Null labels, null, empty or zero vectors and vectors with null, infinite or undefined
parts link with nothing: 0 links, their own component.  Vectors of different lengths are
not compared.  Rows with equal ids and null ids are rows like any other; a component's
id is its smallest id that is not null.  An empty table gives no row.
Only vec_id,
label and embedding are read; other columns may have any names.
"""

from __future__ import annotations

from functools import reduce
from math import erfc, exp, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .graph import components

COSINE = 0.98
TREES = 8
#: Points of a leaf; points sampled from a node to fit its splits; levels of splits a round.
LEAF, SAMPLE, LEVELS = 512, 4000, 6
#: Probability with which a split may cut a pair at the threshold; it sets the width of the overlap.
LOSS = 0.02
#: A split that leaves more than this share of the points on one side is not made.
STUCK = 0.7
#: Vectors in a block of a leaf that could not be split.
BLOCK = 2048
#: Rows of a frame of moved points.
MOVED = 20_000


def _direction(node: int, k: int, dim: int) -> np.ndarray:
    v = np.random.default_rng([node & (2**63 - 1), k]).standard_normal(dim)
    return v / np.linalg.norm(v)


#: Widths of an overlap, in standard deviations of the projected distance of a pair at the threshold, and the mean distance beyond them.
_WIDTHS = np.linspace(0, 4, 401)
_BEYOND = np.array([2 * (exp(-c * c / 2) / sqrt(2 * pi) - c * erfc(c / sqrt(2)) / 2) for c in _WIDTHS])


def _margin(p: np.ndarray, middle: float, dim: int, cosine: float) -> float:
    """Half the width of the overlap at ``middle`` of the projections ``p``."""
    deviation = sqrt((2 - 2 * cosine) / dim)
    dense = np.count_nonzero(np.abs(p - middle) <= deviation) / len(p) / 2
    return deviation * float(_WIDTHS[np.argmax(_BEYOND * dense <= LOSS)]) / 2 if _BEYOND[-1] * dense <= LOSS else 2 * deviation


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors, np.float64) if not isinstance(vectors, np.ndarray) else vectors
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(node: int, x: np.ndarray, levels: int, cosine: float, leaf_share: float) -> tuple[list[float], list[float]]:
    """Thresholds of a subtree in heap order, NaN where it ends, and half the widths of their overlaps."""
    out, margins, n = [float("nan")] * (2**levels - 1), [0.0] * (2**levels - 1), len(x)
    todo = [(0, np.arange(n))]
    while todo:
        k, at = todo.pop()
        if k >= len(out) or len(at) < 8 or len(at) <= leaf_share * n:
            continue
        p = x[at] @ _direction(node, k, x.shape[1])
        middle = float(np.median(p))
        margin = _margin(p, middle, x.shape[1], cosine)
        left, right = at[p < middle + margin], at[p >= middle - margin]
        if max(len(left), len(right)) > STUCK * len(at):
            continue
        out[k], margins[k] = middle, margin
        todo += [(2 * k + 1, left), (2 * k + 2, right)]
    return out, margins


def descend(node: int, x: np.ndarray, thresholds: list[float], margins: list[float]) -> list[tuple[int, np.ndarray, bool]]:
    """(place in the heap, rows, whether the subtree ended early) of all leaves that hold rows."""
    todo, out = [(0, np.arange(len(x)))], []
    while todo:
        k, at = todo.pop()
        if not len(at):
            continue
        if k >= len(thresholds) or np.isnan(thresholds[k]):
            out.append((k, at, k < len(thresholds)))
            continue
        p = x[at] @ _direction(node, k, x.shape[1])
        todo += [(2 * k + 1, at[p < thresholds[k] + margins[k]]), (2 * k + 2, at[p >= thresholds[k] - margins[k]])]
    return out


def _child(node: int, place: int) -> int:
    """A node's id from its parent's: 64 well-mixed bits."""
    z = (node + 0x9E3779B97F4A7C15 * (place + 1)) & (2**64 - 1)
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & (2**64 - 1)
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


_POINTS = "node long, shut boolean, cid long, weight long, vector array<double>"


def forest(classes: DataFrame, trees: int = TREES, leaf: int = LEAF, cosine: float = COSINE) -> DataFrame:
    """``classes(cid, weight, space, vector)`` dealt to leaves: node, cid, weight, vector."""
    roots = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    points = classes.select("space", "cid", "weight", "vector", roots).select(F.xxhash64("tree", "space").alias("node"), F.lit(False).alias("shut"), "cid", "weight", "vector")
    points, done = materialize(points, "forest"), []
    while True:
        sizes = materialize(points.filter("not shut").groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > leaf), "forest-sizes")
        if sizes.isEmpty():
            return reduce(DataFrame.unionByName, done, points)
        share = F.pmod(F.xxhash64("cid", "node"), F.lit(1 << 30)) / float(1 << 30)
        sample = points.filter("not shut").join(sizes, "node").filter(share < SAMPLE / F.col("n")).select("node", "n", "vector")

        def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            n = int(group["n"].iloc[0])
            levels = max(1, min(LEVELS, int(np.ceil(np.log2(n / leaf)))))
            splits, margins = fit(int(key[0]), _unit(np.stack(group["vector"])), levels, cosine, leaf / n)
            return pd.DataFrame({"node": [key[0]], "splits": [splits], "margins": [margins]})

        models = materialize(sample.groupBy("node").applyInPandas(learn, "node long, splits array<double>, margins array<double>"), "forest-models")

        def move(frames):
            for frame in frames:
                vectors, splits, margins = (frame[c].to_numpy() for c in ("vector", "splits", "margins"))
                picked, nodes, shut = [], [], []
                for node, rows in frame.groupby("node", sort=False).indices.items():
                    x = _unit(np.stack(vectors[rows]))
                    for place, at, ended in descend(int(node), x, list(splits[rows[0]]), list(margins[rows[0]])):
                        picked.append(rows[at])
                        nodes.append(np.full(len(at), _child(int(node), place), np.int64))
                        shut.append(np.full(len(at), ended and place == 0))
                picked, nodes, shut = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (picked, nodes, shut))
                for k in range(0, len(picked), MOVED):
                    rows = frame.iloc[picked[k : k + MOVED]]
                    yield pd.DataFrame(
                        {"node": nodes[k : k + MOVED], "shut": shut[k : k + MOVED], "cid": rows["cid"].to_numpy(), "weight": rows["weight"].to_numpy(), "vector": rows["vector"].to_numpy()}
                    )

        # Leaves are done where they were written; only points of nodes with a model move on.
        done.append(points.join(models.select("node"), "node", "left_anti"))
        points = materialize(points.join(models, "node").mapInPandas(move, _POINTS), "forest")


def _join(group: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Groups (each row's smallest row) after the groups of p and q are joined pair by pair."""
    while True:
        a, b = group[p], group[q]
        apart = a != b
        if not apart.any():
            return group
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = group[group]
            if (up == group).all():
                break
            group = up


def _compare(leaf: int, a: pd.DataFrame, b: pd.DataFrame | None, cosine: float):
    """Links between the rows of a and b (or within a): (cid, links, smallest cid of the linked group)."""
    both = a if b is None else pd.concat([a, b], ignore_index=True)
    x, n = _unit(np.stack(both["vector"])), len(a)
    cid, weight = both["cid"].to_numpy(np.int64), both["weight"].to_numpy(np.int64)
    width = max(map(len, both["leaves"]))
    leaves = np.full((len(both), width), leaf, np.int64)
    for i, v in enumerate(both["leaves"]):
        leaves[i, : len(v)] = v
    links, order = np.zeros(len(both), np.int64), np.argsort(cid)
    rank, group = np.argsort(order), np.arange(len(both))
    # Rows that meet in an earlier leaf anyway are not compared with each other here.
    earlier, counts = np.unique(leaves[leaves < leaf], return_counts=True)
    met = (leaves == earlier[counts.argmax()]).any(1) if len(earlier) else np.zeros(len(both), bool)
    rows = np.arange(len(both))
    here, there = rows[:n], rows[:n] if b is None else rows[n:]
    todo = [(here[~met[here]], there)] if b is None else [(here[~met[here]], there), (here[met[here]], there[~met[there]])]
    for side, others, at in ((s, o, at) for s, o in todo if len(o) for at in range(0, len(s), 1024)):
        some = side[at : at + 1024]
        i, j = np.nonzero(x[some] @ x[others].T >= cosine)
        i, j = some[i], others[j]
        if b is None:
            once = (i < j) | met[j]
            i, j = i[once], j[once]
        for k in range(0, len(i), 20_000):
            p, q = i[k : k + 20_000], j[k : k + 20_000]
            if len(earlier):
                shared = (leaves[p][:, :, None] == leaves[q][:, None, :]).any(2)
                mine = np.where(shared, leaves[p], leaf).min(1) == leaf
                p, q = p[mine], q[mine]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            group = _join(group, rank[p], rank[q])
    out = pd.DataFrame({"cid": cid, "links": links, "low": cid[order[group[rank]]]})
    return out[out["links"] > 0]


def linked(points: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Per class and leaf with a link: cid, links (weighted), low (smallest class of its group there)."""
    homes = points.groupBy("cid").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    # A leaf whose rows all share an earlier one has no pair of its own.
    first = homes.select(F.explode("leaves").alias("node"), F.col("leaves")[0].alias("first")).groupBy("node")
    sizes = first.agg(F.count("*").alias("n"), F.min("first").alias("least"), F.max("first").alias("most")).filter("n > 1 and (least <> most or least = node)").select("node", "n")
    rows = points.join(homes, "cid").join(sizes, "node").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).select("node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cid", "weight", "vector", "leaves")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = (int(k) for k in key)
        if i == j:
            return _compare(leaf, group.reset_index(drop=True), None, cosine)
        a, b = group[group["part"] == i], group[group["part"] == j]
        if a.empty or b.empty:
            return pd.DataFrame({"cid": [], "links": [], "low": []}).astype("int64")
        return _compare(leaf, a.reset_index(drop=True), b.reset_index(drop=True), cosine)

    return rows.groupBy("node", "i", "j").applyInPandas(run, "cid long, links long, low long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    ship(vectors.sparkSession)
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = raw.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite, F.lit(False)))
    rows = materialize(rows.select("vec_id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.transform("vector", lambda v: v + 0.0)).alias("vector")), "vectors")
    classes = rows.filter("ok").groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    points = forest(classes.select("cid", "weight", F.xxhash64("label", F.size("vector")).alias("space"), "vector"), trees, leaf, cosine)
    found = materialize(linked(points, cosine, block), "vector-links")
    degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")).filter("a <> b"), "vector-links")
    named = classes.join(groups, classes["cid"] == groups["id"], "left").select("cid", "label", "vector", "weight", "least", F.coalesce("component", "cid").alias("c"))
    ids = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "c").join(degree, "cid", "left").select(F.col("label").alias("_l"), F.col("vector").alias("_v"), "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(named, (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v")), "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

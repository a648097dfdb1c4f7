"""Spelling variants by k-d trees over letter-count vectors.

An inserted or deleted letter changes one letter count by one; a replaced letter lowers one
and raises another.  So words one edit apart lie within L1 distance two of each other, and
more closely: per length pair, at most one count up and one down (same length) or one
count up (one letter longer).  Words of one length are the points of one k-d tree whose
nodes split a letter's count.  A range search leaves out every box that would need more
ups or downs than allowed; what remains is compared by squared distance, and pairs that
pass are verified letter by letter.

The top of each tree is fitted on a bounded sample and shipped to the tasks: it only deals
words into cells of similar size, and a word is sent as a query to the cells its range
touches, so no pair is lost whatever the sample.  A cell that the sample shows to be heavy
(many words of nearly the same letters, or many queries) is dealt in blocks, every query block meeting
every point block.  The tree goes on inside each cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_partitions, ship

#: Dimensions of a vector: a-z, U+00C0 to U+00FF, and six that all other characters share.
DIMS = 96
#: Points of a cell, queries of a block, and points of a leaf inside a cell.
CELL, QUERIES, LEAF = 8192, 1 << 18, 48
#: Words that fit the tops of the trees at most; nodes of fewer sampled words are not split.
SAMPLE, FEWEST = 1 << 17, 32
#: A split leaves at least this share on either side.
SHARE = 1 / 16
#: Letters of the words searched at a time, and comparisons of one product.
LETTERS, PRODUCT = 1 << 18, 1 << 22

_DIM = (90 + np.arange(0x110000) % 6).astype(np.int16)
_DIM[ord("a") : ord("z") + 1] = np.arange(26)
_DIM[0xC0:0x100] = 26 + np.arange(64)


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of words in a row."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(at: np.ndarray, length: int):
    """Words of one length in groups of bounded memory."""
    step = max(1, LETTERS // max(length, 8))
    return (at[k : k + step] for k in range(0, len(at), step))


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, one row per word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), DIMS), np.int16 if lengths.max(initial=0) < 1 << 15 else np.int32)
    for at in chunks(np.arange(len(words)), int(lengths.max(initial=0))):
        rows = np.repeat(np.arange(len(at)), lengths[at])
        out[at] = np.bincount(rows * DIMS + _DIM[codes_of(words[at[0] : at[-1] + 1])], minlength=len(at) * DIMS).reshape(-1, DIMS)
    return out


def best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """(dimension, value): the most even split into counts up to the value and above it."""
    n, best = len(counts), None
    top = counts.max(0)
    for value in range(int(min(top.max(), 8))):
        above = (counts > value).sum(0)
        d = int(np.abs(above - n / 2).argmin())
        if min(above[d], n - above[d]) >= max(1, SHARE * n) and (best is None or abs(above[d] - n / 2) < best[0]):
            best = abs(above[d] - n / 2), d, value
    return best and best[1:]


class Top:
    """Top of the tree of one length: cells are its leaves."""

    def __init__(self, counts: np.ndarray, weight: float):
        """``counts`` of sampled words, each standing for ``weight`` words."""
        self.dim, self.value, self.below, self.above, self.cell = [], [], [], [], []
        self.n_cells = 0
        self._grow(counts, weight)

    def _grow(self, counts: np.ndarray, weight: float) -> int:
        at = len(self.dim)
        for x in (self.dim, self.value, self.below, self.above, self.cell):
            x.append(-1)
        split = best_split(counts) if len(counts) * weight > CELL and len(counts) >= FEWEST else None
        if split is None:
            self.cell[at] = self.n_cells
            self.n_cells += 1
            return at
        d, v = split
        up = counts[:, d] > v
        self.dim[at], self.value[at] = d, v
        self.below[at], self.above[at] = self._grow(counts[~up], weight), self._grow(counts[up], weight)
        return at

    def cells_of(self, counts: np.ndarray) -> np.ndarray:
        """Cell each word lies in."""
        return self.reach(counts, 0, 0)[1]

    def reach(self, counts: np.ndarray, ups: int, downs: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, cell) pairs for all cells within so many counts up and down of a word."""
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = len(counts)
        todo = [(0, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), {})]
        while todo:
            node, idx, up, down, box = todo.pop()
            if self.dim[node] < 0:
                rows.append(idx)
                cells.append(np.full(len(idx), self.cell[node]))
                continue
            todo += [(child, *rest) for child, rest in zip((self.below[node], self.above[node]), halves(counts, self.dim[node], self.value[node], idx, up, down, box, ups, downs), strict=True) if len(rest[0])]
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(rows, kind="stable")
        return rows[order], cells[order]


def halves(counts, dim, value, idx, up, down, box, ups, downs):
    """The queries, with the ups and downs they need, that reach each half of a split box."""
    c = counts[idx, dim]
    low, high = box.get(dim, (0, None))
    was_up, was_down = np.maximum(0, low - c), (np.maximum(0, c - high) if high is not None else 0)
    out = []
    for lo, hi in ((low, value), (value + 1, high)):
        u = up + np.maximum(0, lo - c) - was_up
        d = down + (np.maximum(0, c - hi) if hi is not None else 0) - was_down
        keep = (u <= ups) & (d <= downs)
        out.append((idx[keep], u[keep], d[keep], box | {dim: (lo, hi)}))
    return out


def search(points: np.ndarray, queries: np.ndarray, ups: int, downs: int):
    """Pairs (query, point) whose vectors differ by at most so many counts up and down."""
    kind = np.float32 if points.sum(1).max(initial=0) < 2000 else np.float64
    most = ups + downs
    used = points.any(0)  # letters that no point has count against the query, in its norm
    p, q = points[:, used].astype(kind), queries[:, used].astype(kind)
    pp, qq = (p * p).sum(1), (queries.astype(kind) ** 2).sum(1)
    n = len(queries)
    todo = [(np.arange(len(points)), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), {})]
    while todo:
        at, idx, up, down, box = todo.pop()
        split = best_split(points[at]) if len(at) > LEAF else None
        if split is None:
            step = max(1, PRODUCT // max(1, len(at)))
            for k in range(0, len(idx), step):
                part = idx[k : k + step]
                near = qq[part][:, None] + pp[at][None, :] - 2 * (q[part] @ p[at].T) <= most
                i, j = np.nonzero(near)
                yield part[i], at[j]
            continue
        d, v = split
        above = points[at, d] > v
        for keep, rest in zip((~above, above), halves(queries, d, v, idx, up, down, box, ups, downs), strict=True):
            if len(rest[0]):
                todo.append((at[keep], *rest))


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Row by row: whether two words (code points) of one length differ in one place, or
    whether the longer one has one letter more."""
    n = shorter.shape[1]
    if n == longer.shape[1]:
        return (shorter != longer).sum(1) == 1
    prefix = np.cumprod(shorter == longer[:, :n], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    suffix = np.cumprod((shorter == longer[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return prefix + suffix >= n


def _summary(mine, other, rank, n):
    """Per word of ``mine``: how many others, and the most frequent of them, first by code point."""
    order = np.lexsort((rank[other], -n[other], mine))
    mine, other = mine[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
    return mine[first], np.diff(np.append(first, len(mine))), other[first]


def _in_cell(group):
    """Near words of one block of a cell: role 0 are points, 1 queries of the same length, 2 queries one letter shorter."""
    role, n_all = group["role"].to_numpy(), group["n"].to_numpy()
    names_all = group["word"].to_pylist()
    out = []
    point_at = np.flatnonzero(role == 0)
    points = [names_all[i] for i in point_at.tolist()]
    if points:
        length = len(points[0])
        p_counts, p_codes, p_n = vectors(points), codes_of(points).reshape(-1, length), n_all[point_at]
        p_rank = np.argsort(np.argsort(np.array(points)))
        for kind, downs in ((1, 1), (2, 0)):
            query_at = np.flatnonzero(role == kind)
            found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at in chunks(query_at, length):
                words = [names_all[i] for i in at.tolist()]
                codes = codes_of(words).reshape(-1, length - (kind == 2))
                for i, j in search(p_counts, vectors(words), 1, downs):
                    good = np.concatenate([np.zeros(0, bool), *(one_edit(codes[i[k]], p_codes[j[k]]) for k in chunks(np.arange(len(i)), length))])
                    found_q.append(at[i[good]])
                    found_p.append(j[good])
            q, p = np.concatenate(found_q), np.concatenate(found_p)
            w, near, best = _summary(q, p, p_rank, p_n)
            out.append(([names_all[i] for i in w.tolist()], near, [points[i] for i in best.tolist()], p_n[best]))
            if kind == 2 and len(q):
                shorter, q = np.unique(q, return_inverse=True)
                names = [names_all[i] for i in shorter.tolist()]
                w, near, best = _summary(p, q, np.argsort(np.argsort(np.array(names))), n_all[shorter])
                out.append(([points[i] for i in w.tolist()], near, [names[i] for i in best.tolist()], n_all[shorter][best]))
    columns = [[x for part in out for x in part[0]], np.concatenate([np.zeros(0, np.int64), *(x[1] for x in out)]), [x for part in out for x in part[2]], np.concatenate([np.zeros(0, np.int64), *(x[3] for x in out)])]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "near", "form", "form_n"])


def fit_tops(words: DataFrame) -> tuple[dict[int, Top], dict[tuple[int, int], tuple[int, int]]]:
    """The top of a tree per length, from at most about SAMPLE words, and the numbers of
    point and query blocks of the cells that need several."""
    sizes = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    every = max(1, -(-total // SAMPLE))
    sample = words.filter(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").toArrow()["word"].to_pylist() if total > CELL else []
    by_length: dict[int, list[str]] = {}
    for w in sorted(sample):
        by_length.setdefault(len(w), []).append(w)
    counts = {length: vectors(by_length[length]) if length in by_length else np.zeros((0, DIMS), np.int64) for length in sizes}
    tops = {length: Top(counts[length], every) for length in sizes}
    blocks: dict[tuple[int, int], tuple[int, int]] = {}
    for length, top in tops.items():
        held = every * np.bincount(top.cells_of(counts[length]), minlength=top.n_cells)
        asked = sum(every * np.bincount(top.reach(c, 1, downs)[1], minlength=top.n_cells) for c, downs in ((counts[length], 1), (counts.get(length - 1, counts[length][:0]), 0)))
        for cell in range(top.n_cells):
            by = max(1, int(-(-held[cell] // (4 * CELL)))), max(1, int(-(-asked[cell] // QUERIES)))
            if by != (1, 1):
                blocks[length, cell] = by
    return tops, blocks


def _dealer(tops, blocks):
    def deal(batches):
        for batch in batches:
            names, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            lengths = np.fromiter(map(len, names), np.int64, len(names))
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                for at in chunks(mine, length):
                    counts = vectors(names[at].tolist())
                    hashes = (counts @ np.arange(7, 7 + DIMS) * 2654435761 + codes_of(names[at].tolist()).reshape(-1, length).astype(np.int64) @ np.arange(1, 2 * length, 2)) >> 7
                    jobs = [(0, length, at, tops[length].cells_of(counts), hashes)]
                    for role, other, downs in ((1, length, 1), (2, length + 1, 0)):
                        if other in tops:
                            rows, cells = tops[other].reach(counts, 1, downs)
                            jobs.append((role, other, at[rows], cells, hashes[rows]))
                    for role, other, rows, cells, h in jobs:
                        keys = [(other, c, 0, 0) for c in cells.tolist()]
                        heavy = [k for k, c in enumerate(cells.tolist()) if (other, c) in blocks] if blocks else []
                        pick, key = list(range(len(rows))), keys
                        for k in heavy:
                            n_points, n_queries = blocks[other, int(cells[k])]
                            own = int(h[k]) % (n_points if role == 0 else n_queries)
                            several = [(other, int(cells[k]), own, x) for x in range(n_queries)] if role == 0 else [(other, int(cells[k]), x, own) for x in range(n_points)]
                            key[k] = several[0]
                            pick += [k] * (len(several) - 1)
                            key = key + several[1:]
                        pick = rows[np.array(pick, np.int64)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f"{a}.{b}.{c}.{d}" for a, b, c, d in key], pa.string()), pa.array(np.full(len(pick), role, np.int32)), pa.array(names[pick].tolist(), pa.string()), pa.array(n[pick])],
                            ["cell", "role", "word", "n"],
                        )

    return deal


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, form, form_n`` for words (``word, n``, distinct, not null) that have near
    ones: how many, the most frequent of them (first by code point) and its count."""
    spark = words.sparkSession
    ship(spark)
    tops, blocks = fit_tops(words)
    dealt = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_dealer(tops, blocks), "cell string, role int, word string, n long")
    found = dealt.repartition(n_partitions(spark), "cell").groupBy("cell").applyInArrow(_in_cell, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", "b.form", (-F.col("b.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for ``links(word, form)``: the end of each word's chain of forms, by
    pointer jumping; rounds grow with the logarithm of the longest chain."""
    at = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        stepped = at.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved"))
        stepped = materialize(stepped, "spelling-roots")
        at = stepped.drop("_moved")
        if not stepped.filter("_moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: float = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words(word, n)``.

    ``form`` is the near word of largest n (ties: smallest by code point) if that n is at
    least ``ratio`` (above 1) times the word's n, else null, as is ``form_n``; ``root`` is
    the last word of the chain of forms, the word itself without one.  Null words, and
    null n, are left out; rows of one word add up.  An empty table gives no row; other columns are
    not read.  Words of any characters and lengths are taken.
    """
    kept = words.select(F.col("word").cast("string").alias("word"), "n").dropna()
    kept = materialize(kept.groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words")
    near = near_words(kept).withColumnRenamed("word", "_w")
    joined = kept.join(near, F.col("word") == F.col("_w"), "left").drop("_w")
    strong = F.col("form_n") >= ratio * F.col("n")
    forms = joined.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"))
    forms = materialize(forms, "spelling-forms")
    ends = roots(forms.filter("form is not null")).withColumnRenamed("word", "_w")
    return forms.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Runs of letters.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, run``: maximal runs of letters of whole texts, A to Z lower-cased; a row per run, none for null."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    return docs.select(F.col(key).alias("doc_id"), F.explode(runs).alias("run"))


def with_slips(runs: DataFrame, every: int = 97) -> DataFrame:
    """``word``: the run, from which one letter is deleted where ``every`` divides the CRC-32 of ``<doc_id>:<run>`` (null id: ``null``)."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")))
    hashed = runs.select("run", h.alias("h"))
    k = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), k), F.substring(F.col("run"), k + 2, F.length("run")))
    return hashed.select(F.when(F.pmod(F.col("h"), F.lit(every)) == 0, cut).otherwise(F.col("run")).alias("word"))


def frequent(words: DataFrame, shortest: int = 5, fewest: int = 3) -> DataFrame:
    """``word, n`` of words of at least so many characters that occur at least so often."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that correlate over the corpus go into the same part of the fingerprint.  If two
fingerprints differ in at most DISTANCE bits and thresholds ``t_i >= -1`` of the parts
add up to ``DISTANCE - parts + 1``, some part differs in at most its ``t_i`` bits.  So each
fingerprint picks the thresholds that promise the fewest candidates and probes: counts
are estimated from value histograms of eight-bit groups, which have a fixed size, and
the split is found by dynamic programming over the parts.  Probes meet the parts of all
fingerprints in an equi-join and are verified by the number of differing bits.

Only distinct fingerprints take part.  A part value that more than ``CROWDED``
fingerprints share is not joined: all fingerprints in or probing it are grouped by their
one-bit neighbours instead.  Two that share a neighbour differ in at most two bits, and
two that differ in at most two bits share one, so this finds the same groups without
pairs.

A null or empty text has fingerprint zero and is linked like any other.  Null ids are
allowed: they count as larger than all others.  Repeated rows share a fingerprint.  An
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .graph import components

SEED, SHINGLE, DISTANCE, PARTS = 42, 3, 2, 2
#: Fingerprints with an equal part above which pairs are not tried one by one.
CROWDED = 1000
#: Rows of work that one probe costs, against one candidate.
PROBE_COST = 1.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text) and fp (the 64 bits as a signed long) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fp.view(np.int64))], ["doc_id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_order(distinct: DataFrame, parts: int) -> list[int]:
    """Bits so ordered that each of ``parts`` runs holds bits that correlate.

    Sums over the table are of 64 x 64 counts, whatever its size.
    """

    def pairs(batches):
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            b = _bits(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            both += (b.T @ b).astype(np.int64)
            n += len(b)
        if n:
            i, j = np.indices((64, 64)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, 64)), pa.array(np.append(j, 64)), pa.array(np.append(both.ravel(), n))], ["i", "j", "n"])

    both = np.zeros((65, 65))
    for r in distinct.select("fp").mapInArrow(pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    n = max(both[64, 64], 1)
    p = np.diag(both)[:64] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both[:64, :64] / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, order = list(range(64)), []
    for k in range(parts):
        size = 64 * (k + 1) // parts - 64 * k // parts
        group = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (tie[b, group].sum(), -b)))
            free.remove(group[-1])
        order += group
    return order


def _shuffled(fp: np.ndarray, order: list[int]) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(_bits(fp)[:, order], axis=1, bitorder="little")).view("<i8").ravel().astype(np.int64)


def histograms(shuffled: DataFrame) -> np.ndarray:
    """Counts of the 256 values of each of the eight bytes."""

    def count(batches):
        out = np.zeros((8, 256), np.int64)
        for batch in batches:
            b = batch.column("g").to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for k in range(8):
                out[k] += np.bincount(b[:, k], minlength=256)
        k, v = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(out[k, v])], ["k", "v", "n"])

    out = np.zeros((8, 256))
    for r in shuffled.select("g").mapInArrow(count, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        out[r.k, r.v] = r.n
    return out


def _at_distance(hist: np.ndarray, reach: int) -> np.ndarray:
    """[byte, value, d]: share of fingerprints whose byte differs from the value in d bits."""
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    n = max(hist[0].sum(), 1)
    return np.stack([(apart == d) @ hist.T for d in range(reach + 1)], -1).transpose(1, 0, 2) / n


def thresholds(g: np.ndarray, near: np.ndarray, n: float, parts: int, distance: int) -> np.ndarray:
    """[row, part]: the thresholds of least estimated cost, by dynamic programming over parts.

    A part's share of fingerprints at distance d is the convolution of its bytes' shares.
    """
    bytes_ = g.astype("<i8").view(np.uint8).reshape(-1, 8)
    per, costs = 8 // parts, []
    for i in range(parts):
        share = np.zeros((len(g), distance + 1))
        share[:, 0] = 1
        for k in range(i * per, (i + 1) * per):
            one = near[k, bytes_[:, k]]
            share = np.stack([sum(share[:, a] * one[:, d - a] for a in range(d + 1)) for d in range(distance + 1)], 1)
        balls = np.cumsum([len(m) for m in (_masks(64 // parts, d) for d in range(distance + 1))])
        costs.append(np.column_stack([np.zeros(len(g)), n * np.cumsum(share, 1) + PROBE_COST * balls]))
    # best[s]: least cost of the parts so far with thresholds + 1 adding up to s
    best = np.full((len(g), distance + 2), np.inf)
    best[:, 0] = 0
    picks = []
    for cost in costs:
        options = np.full((distance + 2, len(g), distance + 2), np.inf)
        for t in range(distance + 2):
            options[t, :, t:] = best[:, : distance + 2 - t] + cost[:, t : t + 1]
        picks.append(options.argmin(0))
        best = options.min(0)
    left, out = np.full(len(g), distance + 1), np.zeros((len(g), parts), np.int64)
    for i in range(parts - 1, -1, -1):
        t = picks[i][np.arange(len(g)), left]
        out[:, i] = t - 1
        left = left - t
    return out


def _masks(width: int, d: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), d)]


def links(distinct: DataFrame, parts: int = PARTS, crowded: int = CROWDED) -> DataFrame:
    """Pairs a, b of fingerprints in ``fp`` (distinct longs) that connect all groups of
    fingerprints within DISTANCE bits; each pair is within that distance."""
    distance = DISTANCE
    if parts not in (2, 4, 8):
        raise ValueError("2, 4 or 8 parts")
    ship(distinct.sparkSession)
    order = bit_order(distinct, parts)

    def shuffle(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(_shuffled(fp, order))], ["fp", "g"])

    shuffled = materialize(distinct.select("fp").mapInArrow(shuffle, "fp long, g long"), "simhash-g")
    hist = histograms(shuffled)
    near, n, width = _at_distance(hist, distance), float(hist[0].sum()), 64 // parts

    def choose(batches):
        for batch in batches:
            g = batch.column("g").to_numpy(zero_copy_only=False)
            t = thresholds(g, near, n, parts, distance)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(list(t))], ["g", "t"])

    part = lambda i: F.shiftrightunsigned("g", width * i).bitwiseAND(F.lit((1 << width) - 1))
    index = shuffled.select("g", F.posexplode(F.array(*[part(i) for i in range(parts)])).alias("i", "key"))
    balls = F.array(*[F.array(*[F.lit(m) for d in range(t + 1) for m in _masks(width, d)]) for t in range(distance + 1)])
    chosen = shuffled.mapInArrow(choose, "g long, t array<long>")
    probes = chosen.select("g", F.posexplode("t").alias("i", "t"), F.array(*[part(i) for i in range(parts)]).alias("keys")).filter("t >= 0")
    probes = probes.select("g", "i", F.get("keys", F.col("i")).alias("key"), F.explode(F.get(balls, F.col("t").cast("int"))).alias("mask"))
    probes = probes.select("g", "i", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    busy = materialize(index.groupBy("i", "key").count().filter(F.col("count") > crowded).select("i", "key"), "simhash-crowded")
    calm = lambda x: x.join(busy, ["i", "key"], "left_anti")
    pairs = calm(probes).join(calm(index).withColumnRenamed("g", "h"), ["i", "key"]).filter("g < h").filter(F.bit_count(F.col("g").bitwiseXOR(F.col("h"))) <= distance)
    pairs = pairs.select(F.col("g").alias("a"), F.col("h").alias("b"))
    dense = index.join(busy, ["i", "key"], "left_semi").select("g").unionByName(probes.join(busy, ["i", "key"], "left_semi").select("g")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    near_by = dense.select("g", F.explode(flips).alias("f")).select("g", F.col("g").bitwiseXOR(F.col("f")).alias("x"))
    least = near_by.groupBy("x").agg(F.min("g").alias("a"), F.count("*").alias("k")).filter("k > 1").drop("k")
    stars = near_by.join(least, "x").filter("a < g").select("a", F.col("g").alias("b"))
    found = pairs.unionByName(stars).distinct()
    names = shuffled.select("fp", "g")
    found = found.join(names.withColumnsRenamed({"g": "a", "fp": "fa"}), "a").join(names.withColumnsRenamed({"g": "b", "fp": "fb"}), "b")
    return found.select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def groups(docs: DataFrame, parts: int = PARTS, crowded: int = CROWDED) -> DataFrame:
    """Per row: doc_id, digest, fp and ``least``, the struct (doc_id, digest) of the group's first row."""
    prints = materialize(fingerprints(docs), "simhash")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    distinct = materialize(prints.groupBy("fp").agg(F.min(own).alias("_own")), "simhash-distinct")
    found = components(links(distinct, parts, crowded), "simhash-links")
    named = distinct.join(found, distinct["fp"] == found["id"], "left").select("fp", "_own", F.coalesce("component", "fp").alias("c"))
    firsts = named.groupBy("c").agg(F.min("_own").alias("least"))
    named = named.join(firsts, "c").select(F.col("fp").alias("_fp"), "least")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, parts: int = PARTS, crowded: int = CROWDED) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest id of its group."""
    return groups(docs, parts, crowded).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The input with one row of each group: that with the smallest id, and of equal ids
    that with the smallest digest; of equal rows one stays."""
    first = groups(docs).select("least.*").distinct().select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    rows = docs.withColumn("_d", F.xxhash64("text"))
    rows = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_d"]).select(*docs.columns)

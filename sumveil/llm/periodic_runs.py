"""Periodic runs of words, by block convolution.

At scale B (a power of two) periods from B to 2B - 1 are looked for.  The words are cut
into aligned blocks of B; a run of four periods holds a whole block that comes again one
period later, inside the run.  For a block x and the window y that starts with it, sums of
squared differences ``sum((x[j] - y[j + d])**2)`` for all distances d at once are sums of
squares less twice a correlation, which a number-theoretic transform of length 4B computes
exactly modulo a prime.  A distance of sum zero seeds a run: the stretch of words that
equal the word one distance on is followed to both sides, which also rejects sums that are
a multiple of the prime.

Blocks are left out only where they cannot seed: where a word does not come again within
2B words, or where block and window lie in a run of smaller period.  A stretch inside a
run of smaller period has that smaller period (both periods' sum fits in it, so their
common divisor is one), so scales go upwards and it is no new run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, ship, words

#: A prime with roots of unity of every order up to 2**27, and a generator of its units.
PRIME, GENERATOR, ORDER = 2_013_265_921, 31, 1 << 27
#: A run has at least so many words and so many periods.
WORDS, PERIODS = 6, 4
#: Bytes of text worked on at a time, and numbers of one transform.
SLICE_BYTES, NUMBERS = 4 << 20, 1 << 20

_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _roots(n: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order n, the first n / 2."""
    if (n, inverse) not in _ROOTS:
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        if inverse:
            root = pow(root, PRIME - 2, PRIME)
        out = np.ones(max(1, n // 2), np.uint64)
        size = 1
        while size < len(out):  # doubling: w**(k + size) = w**k * w**size
            out[size : 2 * size] = out[:size] * np.uint64(pow(root, size, PRIME)) % np.uint64(PRIME)
            size *= 2
        _ROOTS[n, inverse] = out
    return _ROOTS[n, inverse]


def ntt(rows: np.ndarray) -> np.ndarray:
    """Transform of each row modulo PRIME, in bit-reversed order; rows have a power of two of numbers below PRIME."""
    p, (k, n) = np.uint64(PRIME), rows.shape
    a, half = rows.astype(np.uint64), n // 2
    while half:
        a = a.reshape(k, -1, 2, half)
        x, y = a[:, :, 0], a[:, :, 1]
        a = np.stack([(x + y) % p, (x + (p - y)) % p * _roots(2 * half, False) % p], 2)
        half //= 2
    return a.reshape(k, n)


def inverse_ntt(rows: np.ndarray) -> np.ndarray:
    """Rows whose transforms, in bit-reversed order, these are."""
    p, (k, n) = np.uint64(PRIME), rows.shape
    a, half = rows.astype(np.uint64), 1
    while half < n:
        a = a.reshape(k, -1, 2, half)
        x, y = a[:, :, 0], a[:, :, 1] * _roots(2 * half, True) % p
        a = np.stack([(x + y) % p, (x + (p - y)) % p], 2)
        half *= 2
    return a.reshape(k, n) * np.uint64(pow(n, PRIME - 2, PRIME)) % p


def zero_mismatches(x: np.ndarray, at: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) with ``block <= distance < 2 * block`` where the block at a start equals the
    words one distance on, modulo PRIME of the squared differences.  ``x`` goes on for 3 blocks after any start."""
    p, n = np.uint64(PRIME), 4 * block
    starts, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, NUMBERS // n)
    for k in range(0, len(at), step):
        begin = at[k : k + step]
        window = np.zeros((len(begin), n), np.uint64)
        window[:, : 3 * block] = x[begin[:, None] + np.arange(3 * block)] % PRIME
        back = np.zeros_like(window)
        back[:, -np.arange(block)] = window[:, :block]
        product = inverse_ntt(ntt(window) * ntt(back) % p)[:, block : 2 * block]
        squares = np.cumsum(window * window % p, axis=1, dtype=np.uint64)  # of 31 bits each
        own = squares[:, block - 1]
        theirs = squares[:, 2 * block - 1 : 3 * block - 1] - squares[:, block - 1 : 2 * block - 1]
        zero = (own[:, None] + theirs) % p == 2 * product % p
        i, d = np.nonzero(zero)
        starts.append(begin[i])
        distances.append(d + block)
    return np.concatenate(starts), np.concatenate(distances)


def _first(flags_at, start: int, stop: int, step: int) -> int:
    """First position from start towards stop where ``flags_at`` holds, looked for in growing pieces; stop if there is none."""
    size = 64
    while (stop - start) * step > 0:
        end = start + step * min(size, (stop - start) * step)
        lo, hi = (start, end) if step > 0 else (end + 1, start + 1)
        hit = np.flatnonzero(flags_at(lo, hi))
        if len(hit):
            return lo + int(hit[0] if step > 0 else hit[-1])
        start, size = end, 4 * size
    return stop


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period, in words with integer
    codes; words between two bounds are one document, and no run crosses a bound."""
    n = len(codes)
    none = np.zeros((0, 3), np.int64)
    if not n:
        return none
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((codes, doc))
    nxt = np.full(n, n + 1, np.int64)  # words until the same word comes again in the document
    same = (codes[order[1:]] == codes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    nxt[order[:-1][same]] = (order[1:] - order[:-1])[same]
    longest = int(np.diff(bounds).max())
    found: list[tuple[int, int, int]] = []
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the runs found, by start; the furthest end so far
    block = 1
    if PERIODS * ORDER // 2 <= longest:
        raise ValueError(f"a document of {longest} words has blocks beyond the transform's order")
    while PERIODS * block <= longest:
        rows = n // block
        at = np.flatnonzero((nxt[: rows * block] < 2 * block).reshape(rows, block).all(1)) * block
        if len(starts) and len(at):
            inside = ends[np.maximum(np.searchsorted(starts, at, "right") - 1, 0)]
            at = at[(starts[0] > at) | (inside < at + 3 * block)]
        new: list[tuple[int, int, int]] = []
        if len(at):
            padded = np.concatenate([codes, np.full(3 * block, int(codes.max()) + 1, codes.dtype)])
            seeds, distances = zero_mismatches(padded, at, block)
            if len(starts) and len(seeds):
                inside = ends[np.maximum(np.searchsorted(starts, seeds, "right") - 1, 0)]
                keep = (starts[0] > seeds) | (inside < seeds + block + distances)
                seeds, distances = seeds[keep], distances[keep]
            order = np.lexsort((seeds, distances))
            done, last = 0, 0
            for s, d in zip(seeds[order].tolist(), distances[order].tolist(), strict=True):
                if d == last and s < done:
                    continue  # in the stretch that an earlier seed has been followed through
                low, high = int(bounds[doc[s]]), int(bounds[doc[s] + 1]) - d
                other = lambda a, b: codes[a:b] != codes[a + d : b + d]
                stop = _first(other, s, high, 1)
                if stop < s + block:
                    continue  # a multiple of the prime
                first = _first(other, s - 1, low - 1, -1) + 1
                last, done = d, stop
                if stop + d - first >= max(WORDS, PERIODS * d):
                    new.append((first, stop + d, d))
        if new:
            k = [bool(len(starts)) and starts[0] <= a and ends[np.searchsorted(starts, a, "right") - 1] >= b for a, b, _ in new]
            found += [r for r, known in zip(new, k, strict=True) if not known]
            runs = np.array(sorted(found), np.int64).reshape(-1, 3)
            starts, ends = runs[:, 0], np.maximum.accumulate(runs[:, 1])
        block *= 2
    if not found:
        return none
    runs = np.array(found, np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (no space or control from tab to carriage return) of all texts, and where each text's begin."""
    split = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    upto = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)
    return flat.filter(pa.array(full)), upto[np.concatenate([[0], np.cumsum(counts)])]


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, runs, collapsed`` of each whole text.

    ``runs`` are the stretches (start, length, period; in words, by start and period) whose
    words a smallest period apart are equal, of at least WORDS words and PERIODS periods,
    that no neighbouring word extends.  ``collapsed`` is the text without what a run
    repeats: words that lie in some run after its first period are dropped, the others
    are joined by a blank.  A null or empty text has no words, no runs and is collapsed to
    ''; keys may be null and rows repeat; an empty table gives no row; other columns are
    not read.  Texts are taken whole; documents of 2**28 words and more are refused.
    """
    ship(docs.sparkSession)

    def find(batches):
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
                all_words, bounds = text_words(column.slice(at, to - at))
                found = find_runs(all_words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds)
                doc = np.searchsorted(bounds, found[:, 0], "right") - 1
                change = np.zeros(len(all_words) + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 1], -1)
                kept = np.cumsum(change)[:-1] == 0
                upto = np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), all_words.filter(pa.array(kept))), " ")
                fields = [pa.array(found[:, 0] - bounds[doc]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])]
                of = np.searchsorted(doc, np.arange(to - at + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(bounds)), lists, collapsed], ["_key", "n_words", "runs", "collapsed"])
                pa.default_memory_pool().release_unused()
                at = to

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(find, schema).withColumnRenamed("_key", key)


def with_loops(docs: DataFrame, every: int = 10) -> DataFrame:
    """``doc_id, text``: in documents whose CRC-32 of the id ``every`` divides, the words from
    one on go round in a loop of three to ten turns; a null id or text stays as it is."""

    def looped(h: Column) -> Column:
        g = F.floor(h / every)

        def turn(w: Column) -> Column:
            n = F.size(w).cast("long")
            a = g % n
            p = 1 + F.floor((n - a) / (3 + g % 8))
            tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
            return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

        return let(words(F.col("text")), turn)

    h = F.crc32(F.col("doc_id").cast("string"))
    text = F.when((h % every == 0) & F.col("text").isNotNull(), looped(h)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_runs, the run of most periods (start, length, period, exponent_milli;
    nulls without a run), and SHA-256 digests of all runs and of the collapsed text."""
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", F.aggregate("runs", F.get("runs", F.lit(0)), more))
    return best.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

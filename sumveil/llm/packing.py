"""Packing by order-preserving dynamic programming.

Documents are range-partitioned by id and encoded in order; the ids of a partition form
one stream.  Every document end and sentence end is a possible cut.  The best cuts
minimise padding plus a penalty per cut inside a document: ``cost(j) = min over i with
end(j) - end(i) <= window of cost(i) + window - (end(j) - end(i)) + penalty(j)``.  What
depends on i is ``cost(i) + end(i)``, so a monotone queue of candidates gives each step
in constant time.  Windows of a length that is a power of two are not padded: those
transitions are looked up beside the queue.  A sentence longer than what a cut inside it
costs can be cut inside, at steps of that length.  Only the open window is carried from batch to batch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, ship

WINDOW = 4096
#: Costs in ids of padding: a cut at a sentence end, and one inside a sentence.
SENTENCE_CUT, HARD_CUT = 8, 64
#: A stream is solved when so many ids are held; the windows at its end stay open.
HELD = 1 << 20


def best_cuts(ends: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the cuts (the last of ``ends`` included) that cost least.

    ``ends`` rises strictly from above 0, with no gap above the window.
    """
    n = len(ends)
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    at = np.concatenate([[0], ends])
    hit_to, hit_from = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in powers:
        i = np.searchsorted(at, ends - p)
        j = np.flatnonzero((ends >= p) & (at[np.minimum(i, n)] == ends - p))
        hit_to.append(j + 1)
        hit_from.append(i[j])
    hit_to, hit_from = np.concatenate(hit_to), np.concatenate(hit_from)
    order = np.argsort(hit_to, kind="stable")
    hits, hits_of = hit_from[order].tolist(), np.searchsorted(hit_to[order], np.arange(n + 2)).tolist()
    # The earliest end that a window may begin at.
    reach = np.searchsorted(at, at - window).tolist()
    place, penalty = at.tolist(), [0, *penalties.tolist()]
    cost, back = [0] * (n + 1), [0] * (n + 1)
    keys, index, head, size = [0], [0], 0, 1  # queue from head on: cost + end, rising, and the index
    for j in range(1, n + 1):
        e, least = place[j], reach[j]
        while index[head] < least:
            head += 1
        i = index[head]
        best = keys[head] + window - e
        for h in hits[hits_of[j] : hits_of[j + 1]]:
            if cost[h] < best:
                best, i = cost[h], h
        best += penalty[j]
        cost[j], back[j] = best, i
        key = best + e
        while size > head and keys[-1] >= key:
            keys.pop()
            index.pop()
            size -= 1
        keys.append(key)
        index.append(j)
        size += 1
    cuts, j = [], n
    while j:
        cuts.append(place[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def tail_cuts(length: int, window: int = WINDOW, hard: int = HARD_CUT) -> list[int]:
    """Lengths into which a last, short window is cut: powers of two if that costs less than its padding."""
    bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return bits if window - length > hard * (len(bits) - 1) else [length]


def _sentence_ends(tokenizer) -> np.ndarray:
    """Which ids end a sentence: pieces of marks only, with a full stop, question or exclamation mark."""
    vocab = tokenizer.get_vocab()
    table = np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        body = piece.removesuffix("</w>")
        table[i] = bool(body) and any(c in ".!?" for c in body) and not any(c.isalnum() for c in body) and piece != body
    return table


def _packer(path: str, spaced: bool, end_id: int, window: int, sentence_cut: int, hard_cut: int, held_ids: int, remembered: int | None):
    def pack(batches):
        from pyspark import TaskContext

        from .tokens import encoded, encoder

        first = TaskContext.get().partitionId() << 40
        ends_sentence, step = _sentence_ends(encoder(path, spaced, remembered).tokenizer), max(1, min(hard_cut, window))
        sequence = 0
        ids = np.zeros(0, np.uint32)  # not yet cut
        docs = np.zeros((0, 5), np.int64)  # doc id, known, position in ids (may be below 0), ids, row number

        def solve(last: bool):
            nonlocal ids, docs, sequence
            n = len(ids)
            marks = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
            doc_ends = docs[:, 2] + docs[:, 3]
            ends = np.unique(np.concatenate([marks, doc_ends]))
            gaps = np.diff(np.concatenate([[0], ends]))
            wide = np.flatnonzero(gaps > step)
            extra = np.concatenate([np.zeros(0, np.int64), *(np.arange(ends[w] - gaps[w] + step, ends[w], step) for w in wide)])
            penalties = np.where(np.isin(ends, doc_ends), 0, sentence_cut)
            ends = np.concatenate([ends, extra])
            order = np.argsort(ends, kind="stable")
            ends, penalties = ends[order], np.concatenate([penalties, np.full(len(extra), hard_cut)])[order]
            cuts = best_cuts(ends, penalties, window)
            if last:
                size = int(cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0))
                cuts = np.concatenate([cuts[:-1], cuts[-1] - size + np.cumsum(tail_cuts(size, window, hard_cut))])
            else:  # the last windows may end otherwise once more is known
                cuts = cuts[: max(1, len(cuts) - 8)]
            done = int(cuts[-1])
            # pieces: cuts and document ends up to the last cut
            points = np.unique(np.concatenate([cuts, doc_ends[doc_ends <= done]]))
            begins = np.concatenate([[0], points[:-1]])
            of = np.searchsorted(doc_ends, begins, "right")
            window_of = np.searchsorted(cuts, begins, "right")
            window_start = np.concatenate([[0], cuts])[window_of]
            raw = memoryview(np.ascontiguousarray(ids[:done], "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), points.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(docs[of, 0], mask=docs[of, 1] == 0),
                    pa.array(begins - docs[of, 2]),
                    pa.array(points - begins),
                    pa.array(crc, pa.int64()),
                    pa.array(docs[of, 3]),
                    pa.array(first + sequence + window_of),
                    pa.array(begins - window_start),
                    pa.array(first + docs[of, 4]),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id"],
            )
            sequence += len(cuts)
            ids = ids[done:]
            docs = docs[doc_ends > done].copy()
            docs[:, 2] -= done
            return out

        rows = 0
        for rest, new, offsets in encoded(batches, "text", path, spaced, end_id, remembered):
            col, k = rest.column("doc_id"), len(offsets) - 1
            values = col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = col.is_valid().to_numpy(zero_copy_only=False)
            docs = np.concatenate([docs, np.column_stack([values, known, len(ids) + offsets[:-1], np.diff(offsets), rows + np.arange(k)]).astype(np.int64)])
            rows += k
            ids = np.concatenate([ids, new])
            if len(ids) >= held_ids:
                yield solve(False)
        if len(ids):
            yield solve(True)

    return pack


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT, spaced: bool = False, held_ids: int = HELD, remembered: int | None = None
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row_id.

    Null texts are empty documents (their end id alone); null ids come first; rows with
    equal ids are ordered by text and told apart by ``row_id``.  An empty table gives no
    row.  A text is encoded whole, however long; other columns are not read.
    ``remembered`` bounds the words a worker keeps encoded, which trades memory for time.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(n_partitions(spark), F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long"
    return ordered.mapInArrow(_packer(tokenizer_path, spaced, end_id, window, sentence_cut, hard_cut, max(held_ids, 16 * window), remembered), schema)

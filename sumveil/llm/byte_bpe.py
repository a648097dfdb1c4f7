"""Byte-level BPE by two tiers, and back.

A text is split by the vocabulary's pattern into pre-tokens.  A minimal perfect hash over
the vocabulary's byte strings (hash and displace: as many slots as strings) finds the
pre-tokens that are tokens themselves; the string of the slot is compared, so that strings
outside the vocabulary are told apart.  The others start as single bytes linked to their
neighbours, with a heap of the pairs that can merge: the pair of lowest rank, leftmost
first, merges and offers its new neighbours.  Each distinct pre-token of a slice of texts
is looked up once; a worker remembers a bounded number of merged ones.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Merged pre-tokens a worker remembers; later ones are merged again for each slice.
REMEMBERED = 250_000
#: Bytes of text, and ids, that are worked on at a time.
SLICE_BYTES, SLICE_IDS = 4 << 20, 4 << 20
#: Strings a bucket of the hash holds on average, and displacements tried at a time.
BUCKET, TRIES = 4, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``find`` gives their positions."""

    def __init__(self, keys: pa.Array, seed: int = 0):
        self.keys, self.n = keys.cast(pa.large_binary()), len(keys)
        self.longest = max(1, pc.max(pc.binary_length(keys)).as_py() or 0)
        self.weights = np.random.default_rng(seed).integers(0, 1 << 64, self.longest, np.uint64) | np.uint64(1)
        self.n_buckets = max(1, self.n // BUCKET)
        #: Displacement of a bucket, or -1 - slot for the only string of a bucket.
        self.shift = np.zeros(self.n_buckets, np.int64)
        #: Position of the string in each slot.
        self.at = np.full(self.n, -1, np.int64)
        self._place(self._hash(self.keys))

    def _hash(self, keys: pa.LargeBinaryArray) -> np.ndarray:
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
        data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        lengths = np.diff(offsets)
        within = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
        total = np.concatenate([[0], np.cumsum((data + np.uint64(1)) * self.weights[within], dtype=np.uint64)]).astype(np.uint64)
        ends = offsets - offsets[0]
        return _mix(total[ends[1:]] - total[ends[:-1]])

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (_mix(hashes ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def _place(self, hashes: np.ndarray) -> None:
        if len(np.unique(hashes)) < self.n:
            raise ValueError("strings must be distinct")
        bucket = ((hashes >> np.uint64(32)) % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.n_buckets)
        starts = np.cumsum(sizes) - sizes
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[: int((sizes > 1).sum())].tolist():
            members = order[starts[b] : starts[b] + sizes[b]]
            first = 1
            while True:
                slots = self._slots(hashes[members][:, None], np.arange(first, first + TRIES)[None, :])
                good = (self.at[slots] < 0).all(0)
                if sizes[b] > 1:
                    ranked = np.sort(slots, axis=0)
                    good &= (ranked[1:] != ranked[:-1]).all(0)
                if good.any():
                    k = int(good.argmax())
                    self.shift[b], self.at[slots[:, k]] = first + k, members
                    break
                first += TRIES
        free = np.flatnonzero(self.at < 0)
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - free
        self.at[free] = order[starts[single]]

    def find(self, keys: pa.Array) -> np.ndarray:
        """Position of each string among the keys, -1 for others."""
        out = np.full(len(keys), -1, np.int64)
        keys = keys.cast(pa.large_binary())
        fits = np.flatnonzero(pc.binary_length(keys).to_numpy(zero_copy_only=False) <= self.longest)
        if not len(fits) or not self.n:
            return out
        keys = keys.take(pa.array(fits))
        hashes = self._hash(keys)
        shift = self.shift[((hashes >> np.uint64(32)) % np.uint64(self.n_buckets)).astype(np.int64)]
        found = self.at[np.where(shift < 0, -1 - shift, self._slots(hashes, shift))]
        same = pc.equal(self.keys.take(pa.array(found)), keys).to_numpy(zero_copy_only=False)
        out[fits[same]] = found[same]
        return out


class ByteBpe:
    """A rank file: lines of a base64 byte string and its rank; single bytes are among them."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import regex

        self.pattern = regex.compile(pattern)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        pieces = list(self.ranks)
        self.rank_of = np.fromiter(self.ranks.values(), np.int64, len(pieces))
        self.hash = PerfectHash(pa.array(pieces, pa.binary()))
        top = int(self.rank_of.max()) + 1
        by_rank = [None] * top
        for piece, rank in self.ranks.items():
            by_rank[rank] = piece
        self.pieces = pa.array(by_rank, pa.large_binary())
        self.known: dict[bytes, list[int]] = {}
        self.remembered = remembered

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself."""
        ranks, n = self.ranks, len(piece)
        after = list(range(1, n + 1))  # where the part that starts here ends, which is where the next one starts
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = after[i]
            if middle < 0 or middle >= n or after[middle] != end:
                continue  # one of the two parts has merged since
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if i:
                j = before[i]
                if (r := ranks.get(piece[j:end])) is not None:
                    heappush(heap, (r, j, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _merged(self, piece: bytes) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.merge(piece)
            if len(self.known) < self.remembered:
                self.known[piece] = ids
        return ids

    def parts(self, text: str) -> list[str]:
        """A long text in parts that no pre-token crosses: cut before a blank between two other characters."""
        if len(text) <= SLICE_BYTES:
            return [text]
        out, at = [], 0
        while (m := self.cut.search(text, at + SLICE_BYTES)) is not None:
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one more entry than texts)."""
        lists = [self.pattern.findall(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        coded = pa.array(chain.from_iterable(lists), pa.large_string(), size=int(bounds[-1])).dictionary_encode()
        del lists
        keys = coded.dictionary.cast(pa.large_binary())
        place = self.hash.find(keys)
        lengths = np.ones(len(keys), np.int64)
        misses = np.flatnonzero(place < 0)
        merged = [self._merged(p) for p in keys.take(pa.array(misses)).to_pylist()]
        lengths[misses] = [len(x) for x in merged]
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        hits = place >= 0
        flat[starts[hits]] = self.rank_of[place[hits]]
        flat[np.repeat(~hits, lengths)] = np.fromiter(chain.from_iterable(merged), np.int32)
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = lengths[index]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[index] - (ends - each), each) + np.arange(int(each.sum()))]
        return ids, np.concatenate([[0], ends])[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Byte string of each run of ids between two bounds."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.pieces)):
            raise ValueError("an id is outside the vocabulary")
        taken = self.pieces.take(pa.array(ids))
        if taken.null_count:
            raise ValueError("an id is outside the vocabulary")
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[bounds])), taken.buffers()[2]])


_VOCABULARIES: dict[tuple, ByteBpe] = {}


def vocabulary(path: str, pattern: str, remembered: int = REMEMBERED) -> ByteBpe:
    """The worker's vocabulary; only the last one is kept."""
    key = path, pattern, remembered
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = ByteBpe(*key)
    return _VOCABULARIES[key]


def _slices(sizes: np.ndarray, most: int):
    """(from, to) of consecutive rows with about ``most`` in all, one row at least."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``key, ids``: the ids of each whole text, in text order, special tokens being ordinary text.

    One row per input row, whatever repeats; a null or empty text has no ids, a null key
    stays null.  An empty table gives no row.  Other columns are not read, so their names
    cannot clash.  A text of any length is encoded whole, in parts that no pre-token crosses.
    """
    ship(docs.sparkSession)

    def run(batches):
        bpe = vocabulary(path, pattern, remembered)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            for at, to in _slices(pc.binary_length(column).to_numpy(zero_copy_only=False), SLICE_BYTES):
                parts = [bpe.parts(t) for t in column.slice(at, to - at).to_pylist()]
                offsets = np.cumsum([0, *map(len, parts)])
                flat = list(chain.from_iterable(parts))
                if len(parts) == 1 and len(flat) > 1:  # a long text: part by part
                    ids = np.concatenate([bpe.encode([p])[0] for p in flat])
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = bpe.encode(flat)
                    bounds = bounds[offsets]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], ["_key", "_ids"])
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, _ids array<int>").select(F.col("_key").alias(key), F.col("_ids").alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, ids, bytes``: the byte string of each list of ids.

    Null ids give null bytes, no ids give no bytes; an id outside the vocabulary is an
    error.  Bytes that are no UTF-8 (ids cut anywhere) come back as they are.
    """
    ship(encoded.sparkSession)

    def run(batches):
        bpe = vocabulary(path, pattern)
        for batch in batches:
            column = batch.column(1)
            known = column.is_valid()
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for at, to in _slices(sizes, SLICE_IDS):
                part = column.slice(at, to - at)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                out = bpe.decode(flat.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[at:to])]).astype(np.int64))
                out = pc.if_else(known.slice(at, to - at), out.cast(pa.binary()), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), part, out], ["_key", "_ids", "_bytes"])
                pa.default_memory_pool().release_unused()

    rows = encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, _ids array<int>, _bytes binary"
    return rows.mapInArrow(run, schema).select(F.col("_key").alias(key), F.col("_ids").alias("ids"), F.col("_bytes").alias("bytes"))


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, and the SHA-256 of its ids in decimal joined by one space, and of its bytes."""
    return decoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )

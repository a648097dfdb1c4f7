"""Arrow kernels that decode and add vectors.

Turning 16 encrypted bytes into a bigint takes several string steps per lane in SQL
(about 2 microseconds measured) and generated methods too long to be compiled, so
blocks are decoded, and long vectors added, by numpy on whole Arrow batches; integer
arithmetic there wraps modulo 2^64 by itself.  Ciphers,
shuffles and groupings stay with Spark, and batches are bounded by
``spark.sql.execution.arrow.maxBytesPerBatch``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


def _matrix(column: pa.Array, width: int | None = None, dtype: str = "int64") -> np.ndarray:
    """Rows of a list column; a null vector or lane, or vectors of unequal lengths, are errors."""
    rows, flat = len(column), column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or flat.null_count:
        raise ValueError("a vector or a lane is null")
    if rows and (lengths != (lengths[0] if width is None else width)).any():
        raise ValueError("vectors of unequal lengths")
    values = flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(rows, -1) if rows else values.reshape(0, 0)


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype="int32") * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def _blocks(column: pa.Array) -> np.ndarray:
    """(rows, blocks, halves) of big-endian 64-bit halves; the last block is padding."""
    rows = len(column)
    if column.null_count:
        raise ValueError("a cipher is null")
    kind = "<i8" if pa.types.is_large_binary(column.type) else "<i4"
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, rows + 1, offset=column.offset * np.dtype(kind).itemsize)
    if rows and (np.diff(at) != at[1] - at[0]).any():
        raise ValueError("ciphers of unequal lengths")
    raw = np.frombuffer(data, ">u8", (int(at[-1]) - int(at[0])) // 8, offset=int(at[0])) if rows else np.zeros(0, ">u8")
    return raw.reshape(rows, -1, 2)[:, :-1, :].astype("uint64") if rows else raw.reshape(0, 1, 2)


def _fold(blocks: np.ndarray) -> np.ndarray:
    return (blocks[:, :, 0] ^ blocks[:, :, 1]).view("int64")


def decode(data: Column) -> Column:
    """Lane keys of encrypted blocks."""

    @arrow_udf("array<bigint>")
    def kernel(column: pa.Array) -> pa.Array:
        return _lists(_fold(_blocks(column)))

    return kernel(data)


def decode_difference(data: Column) -> Column:
    """First half of the lane keys minus the second half."""

    @arrow_udf("array<bigint>")
    def kernel(column: pa.Array) -> pa.Array:
        keys = _fold(_blocks(column))
        half = keys.shape[1] // 2
        return _lists(keys[:, :half] - keys[:, half:])

    return kernel(data)


def bit_groups(data: Column, k: Column) -> Column:
    """The 128 // k groups of k bits (1 to 31) of a 16-byte block, each as g * 2^k + its value; nulls where the block is null."""

    @arrow_udf("array<bigint>")
    def kernel(column: pa.Array, widths: pa.Array) -> pa.Array:
        raw = b"".join(column.fill_null(bytes(16)).to_pylist())
        hi, low = np.frombuffer(raw, ">u8").astype("uint64").reshape(-1, 2).T
        return _rounds(hi, low, widths.to_numpy(zero_copy_only=False).astype("int64"), column.is_null().to_numpy(zero_copy_only=False))

    return kernel(data, k)


def _rounds(hi: np.ndarray, lo: np.ndarray, width: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The groups of blocks, given by their halves, as lists."""
    offsets = np.concatenate([[0], np.cumsum(128 // width)])
    flat = np.empty(offsets[-1], "int64")
    for k in np.unique(width):
        rows = np.flatnonzero(width == k)
        h, low = hi[rows], lo[rows]
        for g in range(128 // int(k)):
            flat[offsets[rows] + g] = _group_of(h, low, g, int(k)).view("int64") + (g << int(k))
    values = pa.array(flat, mask=np.repeat(gone, 128 // width) if gone.any() else None)
    return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), values)


def _aes_tables():
    """The substitution of AES, merged with its column mix and alone, once per byte of a word."""
    p, q, box = 1, 1, [0x63] + [0] * 255
    while True:
        p ^= p << 1 & 0xFF ^ (0x1B if p & 0x80 else 0)
        for n in (1, 2, 4):
            q ^= q << n
        q = q & 0xFF ^ (0x09 if q & 0x80 else 0)
        turned = (q * 0x101 >> 8 - n for n in range(5))
        box[p] = 0x63
        for x in turned:
            box[p] ^= x & 0xFF
        if p == 1:
            break
    one = np.array(box, "uint32")
    two = one << 1 ^ np.where(one & 0x80, 0x11B, 0).astype("uint32")
    mixed = two << 24 | one << 16 | one << 8 | two ^ one
    return [mixed >> np.uint32(n) | mixed << np.uint32(32 - n) if n else mixed for n in (0, 8, 16, 24)], [one << np.uint32(n) for n in (24, 16, 8, 0)]


_MIXED, _PLAIN = _aes_tables()
#: Keys that are worked on at a time, so that their words stay in the cache.
AES_ROWS = 8192


def _look_up(tables, words, out, tmp):
    """XOR of what four tables hold for the first byte of the first word, the second byte of the second, and so on."""
    for i, (t, w) in enumerate(zip(tables, words)):
        np.take(t, w.view("uint8").reshape(-1, 4)[:, 3 - i], out=tmp if i else out, mode="clip")
        if i:
            np.bitwise_xor(out, tmp, out=out)
    return out


class Aes:
    """AES-256 of many keys at once, one row each; setting up a cipher per key costs the JVM ten times as much."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.words, sub, tmp = np.empty((60, n), "uint32"), np.empty(n, "uint32"), np.empty(n, "uint32")
        self.words[:8] = keys.T
        for i in range(8, 60):
            last = self.words[i - 1]
            if i % 8 == 0:
                last = _look_up(_PLAIN, [last << np.uint32(8) | last >> np.uint32(24)] * 4, sub, tmp)
                last ^= np.uint32(1 << 23 + i // 8)
            elif i % 8 == 4:
                last = _look_up(_PLAIN, [last] * 4, sub, tmp)
            np.bitwise_xor(self.words[i - 8], last, out=self.words[i])

    def of(self, rows: np.ndarray) -> "Aes":
        """Some of the keys, once or more often."""
        some = Aes.__new__(Aes)
        some.words = self.words[:, rows]
        return some

    def block(self, first: np.ndarray, second: int) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the encrypted block of two 64-bit numbers; ``second`` is the same in all rows."""
        first, second = first.astype("int64").view("uint64"), second & (1 << 64) - 1
        plain = [(first >> np.uint64(32)).astype("uint32"), first.astype("uint32"), np.uint32(second >> 32), np.uint32(second & 0xFFFFFFFF)]
        a = [self.words[i] ^ x for i, x in enumerate(plain)]
        b, tmp = [np.empty_like(a[0]) for _ in range(4)], np.empty_like(a[0])
        for r in range(1, 15):
            for i in range(4):
                _look_up(_MIXED if r < 14 else _PLAIN, [a[(i + j) % 4] for j in range(4)], b[i], tmp)
                np.bitwise_xor(b[i], self.words[4 * r + i], out=b[i])
            a, b = b, a
        half = lambda x, y: x.astype("uint64") << np.uint64(32) | y
        return half(a[0], a[1]), half(a[2], a[3])


def _keys(column: pa.Array) -> np.ndarray:
    """Keys of 256 bits as (rows, 8) words; any other length is an error, and null keys are zeros."""
    column = column.fill_null(bytes(32)) if column.null_count else column
    kind = "<i8" if pa.types.is_large_binary(column.type) else "<i4"
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, offset=column.offset * np.dtype(kind).itemsize)
    if (np.diff(at) != 32).any():
        raise ValueError("a key has not 256 bits")
    return np.frombuffer(data, ">u4", 8 * len(column), offset=int(at[0])).astype("uint32").reshape(-1, 8) if len(column) else np.zeros((0, 8), "uint32")


def _groups_of(hi: np.ndarray, low: np.ndarray, g: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Value of group g of k bits of each block."""
    end = ((g + 1) * k).astype("uint64")
    k = k.astype("uint64")
    zero, word = np.uint64(0), np.uint64(64)
    left = hi >> (word - np.minimum(end, word))
    # Past the first half, what is left of it moves up and the second half's first bits come behind it.
    over = np.where(end > word, end - word, zero)
    right = np.where(over < word, hi << np.minimum(over, np.uint64(63)), zero) | low >> np.minimum(word - over, np.uint64(63))
    right = np.where(over == word, low, right)
    return (np.where(end <= word, left, right) & ((np.uint64(1) << k) - np.uint64(1))).astype("int64")


def _blocks_of(keys: pa.Array, epochs: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    words, hi, low = _keys(keys), np.empty(len(keys), "uint64"), np.empty(len(keys), "uint64")
    for lo in range(0, len(words), AES_ROWS):
        part = slice(lo, lo + AES_ROWS)
        hi[part], low[part] = Aes(words[part]).block(epochs[part], number)
    return hi, low


def graph_rounds(key: Column, epoch: Column, k: Column, number: int, use: Column | None = None) -> Column:
    """``bit_groups`` of the block (epoch, number) under a pair's key; with ``use``, the rounds of that list which are among them."""

    @arrow_udf("array<bigint>")
    def every(keys: pa.Array, epochs: pa.Array, widths: pa.Array) -> pa.Array:
        hi, low = _blocks_of(keys, epochs.to_numpy(zero_copy_only=False), number)
        return _rounds(hi, low, widths.to_numpy(zero_copy_only=False).astype("int64"), keys.is_null().to_numpy(zero_copy_only=False))

    @arrow_udf("array<bigint>")
    def used(keys: pa.Array, epochs: pa.Array, widths: pa.Array, uses: pa.Array) -> pa.Array:
        hi, low = _blocks_of(keys, epochs.to_numpy(zero_copy_only=False), number)
        offsets = uses.offsets.to_numpy().astype("int64")
        wanted = uses.flatten().to_numpy(zero_copy_only=False).astype("int64")
        row = np.repeat(np.arange(len(keys)), np.diff(offsets))
        width = widths.to_numpy(zero_copy_only=False).astype("int64")[row]
        g = wanted >> width
        kept = _groups_of(hi[row], low[row], g, width) == (wanted & ((1 << width) - 1))
        kept &= (g < 128 // width) & ~keys.is_null().to_numpy(zero_copy_only=False)[row]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(keys)))])
        return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(wanted[kept]))

    return every(key, epoch, k) if use is None else used(key, epoch, k, use)


def part_sums(pairs: DataFrame, members: DataFrame, keys: list[str], n_lanes: int, size_ms: int, number: int, first: int) -> DataFrame:
    """Signed sums per (universe, ws, member) over the edges of each part; both frames are dealt out by ``keys``, part and universe.

    ``pairs`` has a, b, key; ``members`` producer_id, k, rounds and the list of its ``windows``.
    A pair has a block per epoch under its key and ``number``, and lanes per window numbered from ``first``.
    """

    def kernel(pairs: pa.Table, members: pa.Table) -> pa.Table:
        if not pairs.num_rows or not members.num_rows:
            return _PART_SUMS.empty_table()
        pairs, members = pairs.combine_chunks(), members.combine_chunks()
        column = lambda t, c: t.column(c).chunk(0)
        ids, lists, k = column(members, "producer_id").to_numpy(), column(members, "windows"), members.column("k")[0].as_py()
        ws, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(ids)
        present = np.zeros((len(ws), len(ids)), bool)
        present[at, np.repeat(np.argsort(order), np.diff(lists.offsets.to_numpy()))] = True
        ids = ids[order]
        epochs = np.zeros(len(ws), "int64") if k is None else ws - ws % (size_ms * members.column("rounds")[0].as_py())
        rounds = (ws - epochs) // size_ms
        ends = [column(pairs, c).to_numpy() for c in ("a", "b")]
        found = [np.minimum(np.searchsorted(ids, e), len(ids) - 1) for e in ends]
        rows = np.flatnonzero((ids[found[0]] == ends[0]) & (ids[found[1]] == ends[1]))
        if pairs.column("key").null_count:
            raise ValueError("a key is null")
        words = _keys(column(pairs, "key"))
        total, n = np.zeros((n_lanes, len(ws) * len(ids)), "int64"), np.zeros(len(ws) * len(ids), "int64")
        for lo in range(0, len(rows), AES_ROWS):
            part = rows[lo : lo + AES_ROWS]
            aes, a, b = Aes(words[part]), found[0][part], found[1][part]
            drawn = {e: aes.block(np.full(len(part), e), number) for e in np.unique(epochs)} if k is not None else {}
            edge, window = [], []
            for w in range(len(ws)):
                is_edge = present[w, a] & present[w, b]
                if k is not None:
                    is_edge &= _group_of(*drawn[epochs[w]], int(rounds[w] >> k), k) == np.uint64(rounds[w] & (1 << k) - 1)
                edge.append(np.flatnonzero(is_edge))
                window.append(np.full(len(edge[-1]), w))
            edge, window = np.concatenate(edge), np.concatenate(window)
            aes, smaller, larger = aes.of(edge), window * len(ids) + a[edge], window * len(ids) + b[edge]
            for i in range(n_lanes):
                hi, low = aes.block(ws[window], first + i)
                lane = (hi ^ low).view("int64")
                np.add.at(total[i], larger, lane)
                np.subtract.at(total[i], smaller, lane)
            n += np.bincount(np.concatenate([smaller, larger]), minlength=len(n))
        some = np.flatnonzero(n)
        universe = np.full(len(some), members.column("universe_id")[0].as_py())
        masks = _lists(np.ascontiguousarray(total[:, some].T))
        return pa.Table.from_arrays([pa.array(universe), pa.array(ws[some // len(ids)]), pa.array(ids[some % len(ids)]), masks, pa.array(n[some])], schema=_PART_SUMS)

    return _cogroup(pairs, members, keys).applyInArrow(kernel, "universe_id bigint, ws bigint, producer_id bigint, mask array<bigint>, neighbours bigint")


_PART_SUMS = pa.schema([("universe_id", "int64"), ("ws", "int64"), ("producer_id", "int64"), ("mask", pa.list_(pa.int64())), ("neighbours", "int64")])


def _group_of(hi: np.ndarray, low: np.ndarray, g: int, k: int) -> np.ndarray:
    """Value of group g of k bits of each block."""
    end = (g + 1) * k
    if end <= 64:
        v = hi >> np.uint64(64 - end)
    elif end - k >= 64:
        v = low >> np.uint64(128 - end)
    else:
        v = hi << np.uint64(end - 64) | low >> np.uint64(128 - end)
    return v & np.uint64((1 << k) - 1)


def round_segments(blocks: DataFrame, number: int) -> DataFrame:
    """Rows (universe_id, epoch, key, k): how many pairs of each Arrow batch have a round in each segment of 2^k rounds,
    as (universe_id, epoch, segment, edges); the rounds are those of :func:`graph_rounds`."""

    def kernel(batches):
        for batch in batches:
            if batch.num_rows:
                universe, epoch, k = (batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in (0, 1, 3))
                keys = batch.column(2)
                if keys.null_count:
                    raise ValueError("a key is null")
                hi, low = _blocks_of(keys, epoch, number)
                yield from _segment_counts(universe, epoch, k, _rounds(hi, low, k, np.zeros(len(k), bool)))

    return blocks.select("universe_id", "epoch", "key", "k").mapInArrow(kernel, SEGMENTS)


SEGMENTS = "universe_id bigint, epoch bigint, segment bigint, edges bigint"


def list_segments(rounds: DataFrame) -> DataFrame:
    """The same for rows (universe_id, epoch, t, k) whose rounds ``t`` are known."""

    def kernel(batches):
        for batch in batches:
            if batch.num_rows:
                universe, epoch, k = (batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in (0, 1, 3))
                yield from _segment_counts(universe, epoch, k, batch.column(2))

    return rounds.select("universe_id", "epoch", "t", "k").mapInArrow(kernel, SEGMENTS)


def _segment_counts(universe: np.ndarray, epoch: np.ndarray, k: np.ndarray, rounds: pa.Array):
    """One batch per (universe, epoch) among the rows; these come in runs."""
    flat = rounds.flatten()
    if rounds.null_count or flat.null_count:
        raise ValueError("a round is null")
    flat, at = flat.to_numpy(zero_copy_only=False), rounds.offsets.to_numpy()
    at = at - at[0]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(universe) != 0) | (np.diff(epoch) != 0) | (np.diff(k) != 0)]))
    for lo, hi in zip(starts, [*starts[1:], len(universe)]):
        segment, n = np.unique(flat[at[lo] : at[hi]] >> k[lo], return_counts=True) if k[lo] > 8 else _counted(flat[at[lo] : at[hi]] >> k[lo])
        if len(segment):
            same = lambda v: np.full(len(segment), v)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype("int64")) for x in (same(universe[lo]), same(epoch[lo]), segment, n)], names=["universe_id", "epoch", "segment", "edges"])


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(values)
    return np.flatnonzero(n), n[n > 0]


def combine(plus: list[Column], minus: list[Column], n_lanes: int | None = None) -> Column:
    """Lane by lane sum of some vectors minus others."""
    added = len(plus)

    @arrow_udf("array<bigint>")
    def kernel(*columns: pa.Array) -> pa.Array:
        total = sum(_matrix(c, n_lanes) for c in columns[:added]) - sum(_matrix(c, n_lanes) for c in columns[added:])
        return _lists(np.ascontiguousarray(total))

    return kernel(*plus, *minus)


def _whole_groups(batches, keys: list[str]):
    """Tables of whole groups of rows sorted by the keys, each with the number of every row's group.

    The last group of a batch waits for the next batch.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        same = np.all([c == c[-1] for c in (table.column(k).to_numpy() for k in keys)], axis=0)
        at = 0 if same.all() else len(same) - int(same[::-1].argmin())
        if at:
            yield _numbered(table.slice(0, at).combine_chunks(), keys)
        held = table.slice(at)
    if held is not None:
        yield _numbered(held.combine_chunks(), keys)


def _numbered(table: pa.Table, keys: list[str]):
    columns = [table.column(k).to_numpy() for k in keys]
    return table, np.concatenate([[0], np.cumsum(np.any([c[1:] != c[:-1] for c in columns], axis=0))]) if table.num_rows > 1 else np.zeros(1, "int64")


class Packing:
    """Where each lane of a flat vector lies in words of 64 bits: ``bits`` per lane, 64 // bits lanes to a word.

    A packed lane holds 0 to 2^bits - 1; a sum of ``members`` vectors cannot run over if
    each lane of each is at most ``limit``.  Lanes of 64 bits are taken modulo 2^64 and never run over.
    """

    def __init__(self, fields: dict[str, int], bits: dict[str, int], members: int):
        word, shift, width, at = [], [], [], 0
        for name, n in fields.items():
            b = bits.get(name, 64)
            lane = np.arange(n)
            word.append(at + lane // (64 // b))
            shift.append(b * (lane % (64 // b)))
            width.append(np.full(n, b))
            at += -(-n // (64 // b))
        self.words, self.n_lanes = at, sum(fields.values())
        self.word, self.shift, self.width = (np.concatenate(x).astype("int64") for x in (word, shift, width))
        most = (1 << np.minimum(self.width, 62)) - 1
        self.limit = np.where(self.width == 64, np.iinfo("int64").max, most // members)


    def packed(self, row: np.ndarray, n: int, lane: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n vectors, to which lane values of the given rows add up, and whether each is beyond its lane's limit."""
        out = np.zeros((n, self.words), "int64")
        np.add.at(out.reshape(-1), row * self.words + self.word[lane], v << self.shift[lane])
        return out, (self.width[lane] < 64) & ((v < 0) | (v > self.limit[lane]))

    def lanes(self, words: np.ndarray) -> np.ndarray:
        """Flat vectors of packed ones."""
        lanes = words[:, self.word].view("uint64") >> self.shift.astype("uint64") if len(words) else np.zeros((0, self.n_lanes), "uint64")
        mask = np.where(self.width == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(self.width, 63).astype("uint64")) - np.uint64(1))
        return np.ascontiguousarray(lanes & mask).view("int64")


def scatter(rows: DataFrame, keys: list[str], packing: Packing) -> DataFrame:
    """Rows (keys, pos, v), partitioned and sorted by the keys, to one packed vector ``v`` per key.

    Rows of equal position add up.  ``beyond`` says whether a row's value is beyond its lane's limit.
    """

    def kernel(batches):
        for table, group in _whole_groups(batches, keys):
            lane, v = table.column("pos").to_numpy(), table.column("v").to_numpy()
            out, over = packing.packed(group, group[-1] + 1, lane, v)
            beyond = np.zeros(len(out), bool)
            beyond[group[over]] = True
            at = pa.array(np.searchsorted(group, np.arange(len(out))))
            yield pa.RecordBatch.from_arrays([*(table.column(k).chunk(0).take(at) for k in keys), _lists(out), pa.array(beyond)], names=[*keys, "v", "beyond"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", v array<bigint>, beyond boolean"
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("bigint").alias("v")).mapInArrow(kernel, schema)


def unpack(vector: Column, packing: Packing) -> Column:
    """Packed vectors to flat ones."""

    @arrow_udf("array<bigint>")
    def kernel(column: pa.Array) -> pa.Array:
        return _lists(packing.lanes(_matrix(column, packing.words)))

    return kernel(vector)


def group_release(lanes: DataFrame, blocks: DataFrame, keys: list[str], packing: Packing) -> DataFrame:
    """Release of each mask group's window in one pass: (keys, v, producers, beyond).

    ``lanes`` has (keys, producer_id, pos, v), ``blocks`` (keys, a, b, sent, data): for each committed
    producer ``a`` (b null) the encrypted blocks of its window's end and start and whether its
    token arrived, for each pair those of its mask.  Vectors of a group are packed, encrypted
    with the window keys and masked; ciphers and tokens are added up.  A group with a token
    missing gives no row, one with a lane beyond its limit no sum.  Groups are of bounded size.
    """

    def kernel(key, lanes: pa.Table, blocks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return out.empty_table()
        alone = blocks.column("b").is_null()
        members, pairs = (blocks.filter(x).combine_chunks() for x in (alone, pa.compute.invert(alone)))
        if not members.num_rows:
            return out.empty_table()
        lanes = lanes.combine_chunks()
        ids = members.column("a").to_numpy()
        # Masks: a pair's lanes are added for its larger member and subtracted for the smaller.
        masks = np.zeros((len(ids), packing.words), "int64")
        ends = [pairs.column(c).to_numpy() for c in ("a", "b")]
        shared = _fold(_blocks(pairs.column("data").chunk(0))) if pairs.num_rows else masks[:0]
        for i, member in enumerate(ids):
            smaller, larger = (np.flatnonzero(e == member) for e in ends)
            if len(smaller) + len(larger) != len(ids) - 1:
                raise ValueError(f"missing pair key of producer {member}")
            masks[i] = shared[larger].sum(axis=0) - shared[smaller].sum(axis=0)
        # Vectors of those who sent lanes.
        producer, order = lanes.column("producer_id").to_numpy(), np.argsort(ids)
        row = order[np.minimum(np.searchsorted(ids, producer, sorter=order), len(ids) - 1)]
        mine = ids[row] == producer
        row, lane, v = row[mine], lanes.column("pos").to_numpy()[mine], lanes.column("v").to_numpy()[mine]
        vectors, over = packing.packed(row, len(ids), lane, v)
        has = np.bincount(row, minlength=len(ids)) > 0
        sent = members.column("sent").to_numpy()
        head = [pa.array([k.as_py()], t) for k, t in zip(key, out.types)]
        if over.any():
            return pa.Table.from_arrays([*head, pa.array([None], out.field("v").type), pa.array([int(has.sum())]), pa.array([True])], schema=out)
        if not has.any() or not sent[has].all():
            return out.empty_table()
        streams = _fold(_blocks(members.column("data").chunk(0)))
        window_keys = streams[:, : packing.words] - streams[:, packing.words :]
        ciphers, tokens = (vectors + window_keys)[has], (masks - window_keys)[has]
        total = ciphers.sum(axis=0) + tokens.sum(axis=0)
        return pa.Table.from_arrays([*head, _lists(packing.lanes(total[None])), pa.array([int(has.sum())]), pa.array([False])], schema=out)

    out = pa.schema([*((k, pa.int64()) for k in keys), ("v", pa.list_(pa.int64())), ("producers", pa.int64()), ("beyond", pa.bool_())])
    schema = ", ".join(f"{k} bigint" for k in keys) + ", v array<bigint>, producers bigint, beyond boolean"
    lanes = lanes.select(*keys, "producer_id", F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("bigint").alias("v"))
    return _cogroup(lanes, blocks.select(*keys, "a", "b", "sent", "data"), keys).applyInArrow(kernel, schema)


def _cogroup(left: DataFrame, right: DataFrame, keys: list[str]):
    """Columns are named anew, as both frames may come from one."""
    renamed = right.select(*(F.col(c).alias(c) for c in right.columns))
    return left.groupBy(*keys).cogroup(renamed.groupBy(*keys))


def batch_sums(df: DataFrame, keys: list[str], vector: str, sign: str | None, n_lanes: int | None = None) -> DataFrame:
    """Partial sums: one vector per key and Arrow batch, so a shuffle carries few of them."""

    def kernel(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            codes = [batch.column(names.index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
            _, firsts, group_of = np.unique(np.stack(codes, axis=1), axis=0, return_index=True, return_inverse=True)
            groups = [batch.column(names.index(k)).take(pa.array(firsts)) for k in keys]
            rows = _matrix(batch.column(names.index(vector)), n_lanes)
            if sign:
                rows = rows * batch.column(names.index(sign)).to_numpy(zero_copy_only=False)[:, None]
            order = np.argsort(group_of.reshape(-1), kind="stable")
            starts = np.searchsorted(group_of.reshape(-1)[order], np.arange(len(firsts)))
            sums = np.add.reduceat(rows[order], starts, axis=0)
            yield pa.RecordBatch.from_arrays(
                [*groups, _lists(sums)], names=[*keys, vector]
            )

    picked = df.select(*keys, vector, *([F.col(sign).cast("bigint").alias(sign)] if sign else []))
    # Keys keep their fields, so an event time among them keeps its watermark.
    fields = [df.schema[k] for k in keys]
    return picked.mapInArrow(kernel, StructType([*fields, StructField(vector, ArrayType(LongType()))]))

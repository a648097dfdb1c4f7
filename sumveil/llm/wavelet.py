"""Token ids in wavelet matrices: one compressed file per shard, with rank and select.

Documents are range-partitioned by id, encoded in order and cut into shards of about a
million ids at document ends.  A shard's file holds one bit plane per bit of the largest
id, running counts of ones per block of 512 bits, the document ids and their lengths.
Planes are compressed one by one, so a reader loads what it needs.  Files get names of
their own per attempt and count only if the manifest, an ordinary table written by
Spark, names them; a task that runs again leaves nothing half done.

Null texts are empty, null ids come first, equal ids are ordered by text and all kept.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_partitions, open_fs, scratch_dir, ship

MAGIC = b"WVMX0001"
BLOCK = 512
#: Shards are closed at the first document end after so many ids.
SHARD_IDS = 1 << 20


class WaveletMatrix:
    """Access, rank and select over a sequence of integers below ``2 ** levels``."""

    def __init__(self, n: int, levels: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.levels, self.planes, self.zeros = n, levels, planes, zeros
        self._ones: list[np.ndarray | None] = [None] * levels

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bits = (x & x.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bits))
            low = x[~bits]
            zeros.append(len(low))
            if level:
                x = np.concatenate([low, x[bits]])
        return cls(len(ids), levels, planes, zeros)

    def all(self) -> np.ndarray:
        """The whole sequence, level by level from the last."""
        below = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[k], count=self.n).view(bool)
            out = np.empty_like(below)
            out[~bits] = below[: self.zeros[k]]
            out[bits] = below[self.zeros[k] :] | below.dtype.type(1 << (self.levels - 1 - k))
            below = out
        return below.astype(np.uint32)

    def _counts(self, k: int) -> np.ndarray:
        if self._ones[k] is None:
            padded = np.zeros(-(-max(1, len(self.planes[k])) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(self.planes[k])] = self.planes[k]
            per = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1)
            self._ones[k] = np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)
        return self._ones[k]

    def _rank1(self, k: int, i: int) -> int:
        """Ones before position i of plane k."""
        block, plane = i // BLOCK, self.planes[k]
        first = block * (BLOCK // 8)
        whole = int(np.bitwise_count(plane[first : i // 8]).sum())
        part = int(plane[i // 8] >> (8 - i % 8)).bit_count() if i % 8 else 0
        return int(self._counts(k)[block]) + whole + part

    def _select(self, k: int, j: int, one: bool) -> int:
        """Position of the j-th (from 0) one or zero of plane k."""
        ones = self._counts(k).astype(np.int64)
        seen = ones if one else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(seen, j, "right")) - 1
        bits = np.unpackbits(self.planes[k][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(bits == one)[j - int(seen[block])])

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.levels):
            bit = int(self.planes[k][i // 8] >> (7 - i % 8)) & 1
            ones = self._rank1(k, i)
            value = 2 * value + bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _span(self, symbol: int, upto: int) -> tuple[int, int]:
        low, high = 0, upto
        for k in range(self.levels):
            a, b = self._rank1(k, low), self._rank1(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> (self.levels - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def rank(self, symbol: int, upto: int) -> int:
        """Occurrences of a symbol before a position."""
        if symbol >> self.levels:
            return 0
        low, high = self._span(symbol, upto)
        return high - low

    def select(self, symbol: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of a symbol."""
        if not 0 <= j < self.rank(symbol, self.n):
            raise IndexError(j)
        i = self._span(symbol, self.n)[0] + j
        for k in range(self.levels - 1, -1, -1):
            one = bool(symbol >> (self.levels - 1 - k) & 1)
            i = self._select(k, i - self.zeros[k] if one else i, one)
        return i


def to_bytes(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: magic, header, compressed sections."""
    import zstandard

    wm, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    sections = [doc_ids.astype("<i8"), np.packbits(known), lengths.astype("<i8")]
    for k in range(wm.levels):
        sections += [wm.planes[k], wm._counts(k).astype("<u4")]
    body = [pack(np.ascontiguousarray(s).tobytes()) for s in sections]
    head = json.dumps({"n": wm.n, "levels": wm.levels, "zeros": wm.zeros, "docs": len(doc_ids), "sections": [len(b) for b in body]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


def from_bytes(data: bytes):
    """(matrix, document ids, which of them are not null, lengths)."""
    import zstandard

    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    size = struct.unpack("<I", data[8:12])[0]
    head = json.loads(data[12 : 12 + size])
    at, parts, unpack = 12 + size, [], zstandard.ZstdDecompressor()
    for k in head["sections"]:
        parts.append(unpack.decompress(data[at : at + k]) if k else b"")
        at += k
    planes = [np.frombuffer(parts[3 + 2 * k], np.uint8) for k in range(head["levels"])]
    wm = WaveletMatrix(head["n"], head["levels"], planes, head["zeros"])
    wm._ones = [np.frombuffer(parts[4 + 2 * k], "<u4") for k in range(head["levels"])]
    known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=head["docs"]).astype(bool)
    return wm, np.frombuffer(parts[0], "<i8"), known, np.frombuffer(parts[2], "<i8")


def _writer(folder: str, path: str, spaced: bool, end_id: int, shard_ids: int):
    def write(batches):
        from pyspark import TaskContext

        from .tokens import encoded

        part, seq = TaskContext.get().partitionId(), 0
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        ids, docs, known, lengths, held = [], [], [], [], 0

        def flush():
            nonlocal ids, docs, known, lengths, held, seq
            data = to_bytes(*(np.concatenate(x) for x in (ids, docs, known, lengths)))
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wvm"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            row = {"part": part, "seq": seq, "name": name, "n_docs": sum(map(len, docs)), "n_ids": held, "n_bytes": len(data)}
            ids, docs, known, lengths, held, seq = [], [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for rest, new, offsets in encoded(batches, "text", path, spaced, end_id):
            col = rest.column("doc_id")
            own = col.is_valid().to_numpy(zero_copy_only=False)
            values = col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(values):
                to = min(len(values), max(at + 1, int(np.searchsorted(offsets, offsets[at] + shard_ids - held, "left"))))
                ids.append(new[offsets[at] : offsets[to]])
                docs.append(values[at:to])
                known.append(own[at:to])
                lengths.append(np.diff(offsets[at : to + 1]))
                held += int(offsets[to] - offsets[at])
                at = to
                if held >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    return write


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, spaced: bool = True, shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """Encode documents in ascending id order into shard files; the folder and the manifest."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_dir(spark, "wavelet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n_partitions(spark), F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    schema = "part int, seq int, name string, n_docs long, n_ids long, n_bytes long"
    return folder, materialize(ordered.mapInArrow(_writer(folder, tokenizer_path, spaced, end_id, shard_ids), schema), "wavelet-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """``start`` of each shard: ids in all shards before it.

    Parts are as many as range partitions; only their totals meet in one task.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("start", F.col("_base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("_base")


def read_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        fs, base = open_fs(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}") as f:
                    wm, docs, known, lengths = from_bytes(f.read())
                ids = memoryview(wm.all().astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=~known), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    n = n_partitions(manifest.sparkSession)
    return with_starts(manifest).select("name", "start").repartition(n, "name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

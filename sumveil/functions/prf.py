"""Pseudo-random function columns over AES-256.

One block per lane holds 8 bytes of time and 8 bytes of lane, both big endian; the lane's
key is the XOR of the two halves of the encrypted block.  All lanes of a time come from
one ``aes_encrypt`` call: the cipher stream of GCM under the 12-byte vector (time, 0) is
the encryption of the blocks (time, 2), (time, 3) and so on, so lane i has the number
i + 2 and no block is ever put together (which cost more than the cipher when it was).
Blocks outside the stream (graphs, samples) are encrypted one by one.  Encrypted
blocks are decoded to bigint lanes by an Arrow kernel; the string functions SQL offers for
it cost more than the cipher.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumveil.functions import wide
from sumveil.functions.arith import let

# Lanes outside 0..n that keep other uses of the same key apart.
GRAPH_LANE = -1
SAMPLE_LANE = -2
#: Number in the block of lane 0, as the stream counts.
FIRST_NUMBER = 2


def _lane_hex(lane: int) -> str:
    return format(lane & ((1 << 64) - 1), "016X")


def _long(data: Column, start) -> Column:
    """Eight bytes from a 1-based position as a signed bigint."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.conv(F.hex(F.substr(data, at, F.lit(8))), 16, -10).cast("bigint")


def block(key: Column, time: Column, lane: int) -> Column:
    """One encrypted block, 16 bytes: of a lane from 0 as in :func:`lane_blocks`, or of one below 0 with a number of its own."""
    number = _lane_hex(lane if lane < 0 else lane + FIRST_NUMBER)
    plain = F.unhex(F.concat(F.lpad(F.hex(time.cast("bigint")), 16, "0"), F.lit(number)))
    return F.substr(F.aes_encrypt(plain, key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.lit(16))


def block_halves(key: Column, time: Column, lane: int) -> Column:
    """One encrypted block as a struct of two bigints, ``hi`` and ``lo``."""
    return let(block(key, time, lane), lambda b: F.struct(_long(b, 1).alias("hi"), _long(b, 9).alias("lo")))


def bit_group(halves: Column, k: Column, g: Column) -> Column:
    """Value of group ``g`` (from 0) when 128 bits are cut into groups of ``k`` bits, k at most 31."""
    hi, lo, end = halves["hi"], halves["lo"], ((g + 1) * k).cast("int")
    right = lambda v, n: F.call_function("shiftrightunsigned", v, n)
    across = F.call_function("shiftleft", hi, end - 64).bitwiseOR(right(lo, 128 - end))
    value = F.when(end <= 64, right(hi, 64 - end)).when(end - k.cast("int") >= 64, right(lo, 128 - end)).otherwise(across)
    return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int")) - 1)


def block_bits(key: Column, time: Column, lane: int) -> Column:
    """The same 128 bits as a string of 0 and 1."""
    b = block(key, time, lane)
    half = lambda start: F.lpad(F.bin(_long(b, start)), 64, "0")
    return F.concat(half(1), half(9))


def lane_blocks(key: Column, times: list[Column], n_lanes: int) -> Column:
    """Encrypted blocks of every (time, lane), times outermost, and a block to be ignored, as one binary."""

    def stream(time: Column) -> Column:
        vector = F.unhex(F.concat(F.lpad(F.hex(time.cast("bigint")), 16, "0"), F.lit("00000000")))
        return F.aes_encrypt(F.lit(bytes(16 * n_lanes)), key, F.lit("GCM"), F.lit("NONE"), vector)

    # Before the stream stands the vector, behind it the tag.
    size = 16 * n_lanes
    parts = [F.substring(stream(t), 13, size if i + 1 < len(times) else size + 16) for i, t in enumerate(times)]
    return F.concat(*parts)


def parse_lanes(data: Column, n_lanes: int, time_index: int = 0) -> Column:
    """``array<bigint>`` of lane keys out of :func:`lane_blocks`."""
    return F.slice(wide.decode(data), n_lanes * time_index + 1, n_lanes)


def prf_lanes(key: Column, time: Column, n_lanes: int) -> Column:
    """Lane keys of one time as ``array<bigint>``."""
    return wide.decode(lane_blocks(key, [time], n_lanes))


def key_difference(key: Column, end: Column, start: Column, n_lanes: int) -> Column:
    """F(end) - F(start) as ``array<bigint>``, from one cipher call."""
    return wide.decode_difference(lane_blocks(key, [end, start], n_lanes))

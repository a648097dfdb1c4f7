"""Additive encodings: how a value becomes lanes, and how summed lanes are read.

``*_lanes`` give the per-event lanes, ``decode_*`` read the sums of those lanes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_lanes(x: Column) -> list[Column]:
    return [x]


def count_lanes() -> list[Column]:
    return [F.lit(1).cast("bigint")]


def avg_lanes(x: Column) -> list[Column]:
    return [x, *count_lanes()]


def base_lanes(x: Column) -> list[Column]:
    return [x, x * x]


def var_lanes(x: Column) -> list[Column]:
    return [*base_lanes(x), *count_lanes()]


def regression_lanes(x: Column, y: Column) -> list[Column]:
    return [x, x * x, y, x * y, *count_lanes()]


def decode_avg(s: Column, n: Column) -> Column:
    """Mean, null for an empty population."""
    return F.when(n > 0, s.cast("double") / n.cast("double"))


def decode_var(s: Column, q: Column, n: Column) -> Column:
    """Population variance from sum, sum of squares and count."""
    mean = decode_avg(s, n)
    return F.when(n > 0, q.cast("double") / n.cast("double") - mean * mean)


def decode_stddev(s: Column, q: Column, n: Column) -> Column:
    # Rounding can leave a constant population a hair below zero.
    return F.when(n > 0, F.sqrt(F.greatest(decode_var(s, q, n), F.lit(0.0))))


def decode_regression(sx: Column, sxx: Column, sy: Column, sxy: Column, n: Column) -> tuple[Column, Column]:
    """Intercept and slope of the least squares line; null when x is constant."""
    x, xx, y, xy, k = (c.cast("double") for c in (sx, sxx, sy, sxy, n))
    det = k * xx - x * x
    intercept = F.when(det != 0, (y * xx - x * xy) / det)
    slope = F.when(det != 0, (k * xy - x * y) / det)
    return intercept, slope


def bucket(x: Column, boundaries: list[int]) -> Column:
    """Index of the first boundary above x, else the number of boundaries.

    A value equal to a boundary belongs to the upper bucket.
    """
    above = F.lit(len(boundaries)).cast("bigint")
    for i in range(len(boundaries) - 1, -1, -1):
        above = F.when(x < boundaries[i], F.lit(i).cast("bigint")).otherwise(above)
    return above


def decode_min_bucket(bucket_col: Column, n: Column) -> Column:
    """Aggregate over histogram rows: first bucket with a count, -1 if there is none."""
    return F.coalesce(F.min(F.when(n > 0, bucket_col)), F.lit(-1).cast("bigint"))


def decode_max_bucket(bucket_col: Column, n: Column) -> Column:
    return F.coalesce(F.max(F.when(n > 0, bucket_col)), F.lit(-1).cast("bigint"))


def pack_word(bin_col: Column, bits: int) -> Column:
    """Which packed word a bin lives in."""
    return F.call_function("div", bin_col, F.lit(64 // bits).cast("bigint"))


def pack_value(n: Column, bin_col: Column, bits: int) -> Column:
    """A bin's count at its place in the word; errors when it would spill over."""
    slot = (bin_col % F.lit(64 // bits).cast("bigint")).cast("int")
    fits = (n >= 0) if bits >= 63 else (n >= 0) & (n < (1 << bits))
    checked = F.when(fits, n).otherwise(
        F.raise_error(F.lit(f"count does not fit into {bits} bits")).cast("bigint")
    )
    return F.shiftleft(checked, 0) if bits == 64 else F.call_function("shiftleft", checked, slot * bits)


def unpack_word(word_index: Column, word: Column, bits: int) -> Column:
    """``array<struct<bin,n>>`` of all bins of a packed word."""
    per = 64 // bits
    if bits == 64:
        return F.array(F.struct(word_index.alias("bin"), word.alias("n")))
    mask = F.lit((1 << bits) - 1).cast("bigint")
    return F.array(*[
        F.struct(
            (word_index * per + i).alias("bin"),
            F.shiftrightunsigned(word, i * bits).bitwiseAND(mask).alias("n"),
        )
        for i in range(per)
    ])

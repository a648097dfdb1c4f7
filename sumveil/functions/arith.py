"""Arithmetic modulo 2^64 on bigint columns under ANSI mode.

ANSI sums raise on overflow, so wrapping is done on limbs: a per-row sum works on
two 32-bit halves, an aggregate on three limbs of 22, 22 and 20 bits.  A limb sum
overflows only beyond 2^41 rows per group, and every aggregate stays a plain
bigint ``sum`` with map-side partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF = (1 << 32) - 1
LIMB_BITS = 22
_LIMB = (1 << LIMB_BITS) - 1


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    Inside a higher-order function a plain column would be evaluated again for every
    element.
    """
    return F.transform(F.array(value), body)[0]


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def wrap_sum(plus: list[Column], minus: list[Column] = ()) -> Column:
    """Sum of bigint columns minus others, modulo 2^64, as a signed bigint."""
    low = lambda c: c.bitwiseAND(F.lit(_HALF))
    high = lambda c: F.shiftrightunsigned(c, 32)
    lo = _total([low(c) for c in plus] + [-low(c) for c in minus])
    hi = _total([high(c) for c in plus] + [-high(c) for c in minus]) + F.shiftright(lo, 32)
    return F.shiftleft(hi, 32).bitwiseOR(low(lo))


def limb_sums(value: Column, prefix: str, sign: Column | None = None) -> list[Column]:
    """Three aggregate columns ``{prefix}_0..2`` whose carry gives the wrapped sum."""
    limbs = [
        value.bitwiseAND(F.lit(_LIMB)),
        F.shiftrightunsigned(value, LIMB_BITS).bitwiseAND(F.lit(_LIMB)),
        F.shiftrightunsigned(value, 2 * LIMB_BITS),
    ]
    if sign is not None:
        limbs = [limb * sign for limb in limbs]
    return [F.sum(limb).alias(f"{prefix}_{i}") for i, limb in enumerate(limbs)]


def limb_total(prefix: str) -> Column:
    """Recombine the three limb sums into one signed bigint."""
    l0, l1, l2 = (F.col(f"{prefix}_{i}") for i in range(3))
    mid = l1 + F.shiftright(l0, LIMB_BITS)
    top = l2 + F.shiftright(mid, LIMB_BITS)
    return (
        F.shiftleft(top, 2 * LIMB_BITS)
        .bitwiseOR(F.shiftleft(mid.bitwiseAND(F.lit(_LIMB)), LIMB_BITS))
        .bitwiseOR(l0.bitwiseAND(F.lit(_LIMB)))
    )

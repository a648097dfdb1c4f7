"""Ordered scans whose work is split inside a key.

A window function over ``partitionBy(key)`` puts all rows of a key into one task.
Here the ordering column is cut into blocks of fixed width: block summaries (a
partially aggregated group-by) are scanned per key, and rows only within their
block.  A block holds at most ``width`` distinct order values, so no task grows with
the hottest key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sumveil.functions.timewin import idiv, floor_mod
from sumveil.session import materialize

_AGGS = {"max": (F.max, lambda a, b: F.greatest(a, b)), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def _block(order: str, width: int) -> Column:
    return idiv(F.col(order) - floor_mod(F.col(order), width), width)


def running_before(
    df: DataFrame, keys: list[str], order: str, value: str, width: int, agg: str = "max", out: str = "before"
) -> DataFrame:
    """Add the ``max``/``sum`` of ``value`` over all earlier rows of the key (null if none).

    ``order`` must be unique within a key for rows with different values to be ordered.
    """
    fn, merge = _AGGS[agg]
    blocked = df.withColumn("_block", _block(order, width))
    earlier_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(fn(value).alias("_total"))
        .select(*keys, "_block", fn("_total").over(earlier_blocks).alias("_carry"))
    )
    earlier_rows = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.withColumn("_inside", fn(value).over(earlier_rows))
    return (
        inside.join(carried, [*keys, "_block"])
        .withColumn(out, merge(F.col("_carry"), F.col("_inside")))
        .drop("_block", "_carry", "_inside")
    )


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, width: int = 4096, out: str = "quantile") -> DataFrame:
    """Exact interpolated quantile of an integer column per key.

    Values are first reduced to (value, frequency); ranks come from a blocked running
    sum, so neither rows nor distinct values of a key meet in one task.
    """
    counts = frequencies(df, keys, value)
    return quantile_of_frequencies(counts, keys, value, q, width, out)


def frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _n) as a written table, for the several passes statistics make."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return materialize(counted, "frequencies")


def quantile_of_frequencies(
    counts: DataFrame, keys: list[str], value: str, q: float, width: int = 4096, out: str = "quantile"
) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = running_before(counts, keys, value, "_n", width, "sum", "_before").join(totals, keys)
    position = F.lit(float(q)) * (F.col("_all") - 1)
    lo, hi = F.floor(position), F.ceil(position)
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    ends = ranked.filter(holds(lo) | holds(hi)).groupBy(*keys).agg(
        F.max(F.when(holds(lo), F.col(value))).alias("_lo"),
        F.max(F.when(holds(hi), F.col(value))).alias("_hi"),
        F.first(position - lo).alias("_frac"),
    )
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias(out))

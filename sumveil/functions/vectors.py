"""Vectors of lanes: ``array<bigint>`` columns of a fixed, known length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumveil.functions import wide
from sumveil.functions.arith import limb_sums, limb_total, wrap_sum

WIDE_LANES = 8


def combine(n_lanes: int, plus: list[Column], minus: list[Column] = ()) -> Column:
    """Lane by lane sum of some vectors minus others, modulo 2^64."""
    if n_lanes <= WIDE_LANES:
        return F.array(*[wrap_sum([lane(p, i, n_lanes) for p in plus], [lane(m, i, n_lanes) for m in minus]) for i in range(n_lanes)])
    return wide.combine(plus, minus, n_lanes)


def lane(vector: Column, i: int, n_lanes: int) -> Column:
    """One lane; a null vector or lane, or a vector of another length, is an error, as in the Arrow kernels."""
    wrong = F.raise_error(F.lit("a vector or a lane is null, or vectors of unequal lengths")).cast("bigint")
    return F.coalesce(F.when(F.size(vector) == n_lanes, F.get(vector, F.lit(i))), wrong)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: wrap_sum([x, y]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: wrap_sum([x], [y]))


def zeros(n_lanes: int) -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), n_lanes)


def vector_sum(
    df: DataFrame,
    keys: list[str],
    vector: str,
    n_lanes: int,
    sign: str | None = None,
    extra: list[Column] = (),
    out: str = "v",
) -> DataFrame:
    """Sum a vector column per group modulo 2^64, keeping it a vector.

    Short vectors become one wide aggregate (no row is multiplied).  Long ones are
    first summed per Arrow batch, then lane by lane, and put back together; that array
    has ``n_lanes`` elements, a constant of the profile.  Both ways keep the types of keys
    and raise on null or missing lanes.
    """
    s = F.col(sign) if sign else None
    if n_lanes <= WIDE_LANES:
        aggs = [a for i in range(n_lanes) for a in limb_sums(lane(F.col(vector), i, n_lanes), f"_s{i}", s)]
        summed = df.groupBy(*keys).agg(*aggs, *extra)
        drop = [f"_s{i}_{j}" for i in range(n_lanes) for j in range(3)]
        return summed.withColumn(out, F.array(*[limb_total(f"_s{i}") for i in range(n_lanes)])).drop(*drop)
    partial = wide.batch_sums(df, keys, vector, sign, n_lanes)
    lanes = partial.select(*keys, F.posexplode(vector).alias("_lane", "_x"))
    summed = lanes.groupBy(*keys, "_lane").agg(*limb_sums(F.col("_x"), "_s"))
    rebuilt = (
        summed.select(*keys, F.struct("_lane", limb_total("_s").alias("_v")).alias("_e"))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["_v"]).alias(out))
    )
    if not extra:
        return rebuilt
    return rebuilt.join(df.groupBy(*keys).agg(*extra), keys)


def lanes_to_columns(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c != vector], *[F.col(vector)[i].alias(n) for i, n in enumerate(names)])

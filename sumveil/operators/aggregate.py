"""Windowed population aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumveil.functions.timewin import window_start
from sumveil.session import spread

#: Windows that one row opens when gaps are filled.
GAP_BLOCK = 10_000


def producer_sums(df: DataFrame, size_ms: int, measures: dict[str, Column], ts: str = "ts_ms") -> DataFrame:
    """Sum each measure per (universe, producer, window)."""
    return df.groupBy("universe_id", "producer_id", window_start(F.col(ts), size_ms).alias("ws")).agg(
        *[F.sum(c).alias(name) for name, c in measures.items()]
    )


def population_sums(sums: DataFrame, measures: list[str], universes: DataFrame | None = None) -> DataFrame:
    """Sum producer sums per (universe, window); with ``universes(universe_id, full_size)``, only
    windows to which that many producers of their universe contributed come out."""
    total = sums.groupBy("universe_id", "ws").agg(
        *[F.sum(m).alias(m) for m in measures], F.count("*").alias("producers")
    )
    if universes is None:
        return total
    full = total.join(universes.select("universe_id", "full_size"), "universe_id").filter(F.col("producers") >= F.col("full_size"))
    return full.drop("full_size")


def add_inputs(df: DataFrame, keys: list[str], attrs: list[str], count: str = "count") -> DataFrame:
    """Add plain inputs; an input without a count stands for one event."""
    return df.groupBy(*keys).agg(
        *[F.sum(a).alias(a) for a in attrs], F.sum(F.coalesce(F.col(count), F.lit(1).cast("bigint"))).alias(count)
    )


def merge_maps(df: DataFrame, keys: list[str], map_col: str) -> DataFrame:
    """Merge-add map columns: one row per (keys, map key)."""
    return (
        df.select(*keys, F.explode(map_col).alias("map_key", "map_value"))
        .groupBy(*keys, "map_key")
        .agg(F.sum(F.col("map_value").cast("bigint")).alias("map_value"))
    )


def add_maps(a: Column, b: Column) -> Column:
    """Row form of :func:`merge_maps` for two map columns."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def fill_windows(totals: DataFrame, size_ms: int, zero: list[str]) -> DataFrame:
    """Open every window between a universe's first and last one; empty ones get zeros.

    The range is opened in blocks of ``GAP_BLOCK`` windows, which are dealt out before
    they are opened, so a long gap is neither one array nor one task.
    """
    spans = totals.groupBy("universe_id").agg(F.min("ws").alias("_lo"), F.max("ws").alias("_hi"))
    size, step = F.lit(size_ms).cast("bigint"), F.lit(size_ms * GAP_BLOCK).cast("bigint")
    blocks = spans.select("universe_id", "_hi", F.explode(F.sequence("_lo", "_hi", step)).alias("_from"))
    blocks = spread(blocks, "universe_id", "_from")
    every = blocks.select("universe_id", F.explode(F.sequence("_from", F.least("_hi", F.col("_from") + step - size), size)).alias("ws"))
    return every.join(totals, ["universe_id", "ws"], "left").na.fill(0, subset=zero)


def throughput(df: DataFrame, run: str, ts: str, size_ms: int = 1000) -> DataFrame:
    """Records per (run, window)."""
    return df.groupBy(run, window_start(F.col(ts), size_ms).alias("ws")).agg(F.count("*").alias("n"))


def bucket_balance(df: DataFrame, member: str, buckets: int, hashed: Column) -> DataFrame:
    """Members per bucket of a hash partitioning."""
    return df.select(member).distinct().groupBy(F.pmod(hashed, F.lit(buckets).cast("bigint")).alias("bucket")).agg(
        F.count("*").alias("members")
    )


def member_fingerprint(df: DataFrame, keys: list[str], member: str, bits: int = 256) -> DataFrame:
    """Order-free fingerprint of a member set.

    Each member's SHA-2 digest is cut into 8-digit (32-bit) chunks, chunks are
    summed over the set, and the sums are hashed again.  The sums are ordinary
    partial aggregates, so a set never meets in one task; they hold up to 2^31
    members.
    """
    digits = bits // 4
    digest = F.sha2(F.col(member).cast("string"), bits)
    starts = list(range(0, digits, 8))
    chunk = lambda s: F.conv(F.substr(F.col("_d"), F.lit(s + 1), F.lit(8)), 16, 10).cast("bigint")
    sums = (
        df.select(*keys, member).distinct().select(*keys, digest.alias("_d"))
        .groupBy(*keys)
        .agg(F.count("*").alias("members"), *[F.sum(chunk(s)).alias(f"_c{i}") for i, s in enumerate(starts)])
    )
    joined = F.concat_ws(",", *[F.col(f"_c{i}").cast("string") for i in range(len(starts))])
    return sums.select(*keys, "members", F.sha2(joined, bits).alias("fingerprint"))

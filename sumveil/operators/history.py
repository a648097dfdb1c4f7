"""Queries on result and status histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sumveil.functions.timewin import DAY_MS, window_start


def last_n_windows(df: DataFrame, n: int, key: str = "universe_id") -> DataFrame:
    """The newest n windows of each universe."""
    w = Window.partitionBy(key).orderBy(F.col("ws").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def expired_windows(windows: DataFrame, stream_time: DataFrame, size_ms: int, grace_ms: int = 0) -> DataFrame:
    """Windows whose end (plus grace) stream time has reached, oldest first."""
    return (
        windows.join(stream_time, "universe_id")
        .filter(F.col("ws") + size_ms + grace_ms <= F.col("stream_time"))
        .drop("stream_time")
        .orderBy("universe_id", "ws")
    )


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key: an aggregate over a struct, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in [*order, *rest]])


def trim_runs(df: DataFrame, keys: list[str], edge: int = 2, at_least: int = 8) -> DataFrame:
    """Drop a run's first and last windows; runs that keep too few are left out."""
    windows = df.groupBy(*keys, "ws").agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("ws")
    down = Window.partitionBy(*keys).orderBy(F.col("ws").desc())
    kept = windows.select(
        *keys, "ws", F.row_number().over(up).alias("_i"), F.row_number().over(down).alias("_j")
    ).filter((F.col("_i") > edge) & (F.col("_j") > edge))
    enough = kept.groupBy(*keys).agg(F.count("*").alias("_k")).filter(F.col("_k") >= at_least)
    return df.join(kept.join(enough, keys, "left_semi").select(*keys, "ws"), [*keys, "ws"], "left_semi")


def run_cutoff(df: DataFrame, keys: list[str], limit_ms: int) -> DataFrame:
    """Windows within a time limit of the run's first window."""
    first = df.groupBy(*keys).agg(F.min("ws").alias("_first"))
    return df.join(first, keys).filter(F.col("ws") <= F.col("_first") + limit_ms).drop("_first")


def result_delta(results: DataFrame, measure: str) -> DataFrame:
    """Previous value next to the current one."""
    w = Window.partitionBy("universe_id").orderBy("ws")
    return results.withColumn("previous", F.lag(measure).over(w)).withColumn("change", F.col(measure) - F.col("previous"))


def status_timeline(status: DataFrame) -> DataFrame:
    """Status rows plus a day-break marker (status 0) before the first window of a new day."""
    w = Window.partitionBy("universe_id").orderBy("ws")
    day = window_start(F.col("ws"), DAY_MS)
    marked = status.withColumn("_day", day).withColumn("_before", F.lag(day).over(w))
    breaks = marked.filter(F.col("_day") != F.col("_before")).select(
        "universe_id", F.col("_day").alias("ws"), F.lit(0).cast("bigint").alias("status")
    )
    return status.select("universe_id", "ws", "status").unionByName(breaks)


def window_status(
    totals: DataFrame, committed: DataFrame, tokens: DataFrame, expected: DataFrame, stream_time: DataFrame,
    size_ms: int, grace_ms: int,
) -> DataFrame:
    """Life-cycle state of every opened window, from facts.

    1 open; 2 staged once stream time reaches the window's end; after grace 3
    committed once commits are settled, 4 merged when membership diffs are out, 5
    closed when every committed producer's token came.  Commits of a window count as
    settled when grace is over (the deadline is applied to the commits before), so a
    window past grace is at least merged; without commits or with a token missing it
    stays there.  A window whose commits are all in before grace ends is committed.
    """
    per = lambda df, name: df.groupBy("universe_id", "ws").agg(F.count("*").alias(name))
    facts = (
        totals.select("universe_id", "ws")
        .join(per(committed, "commits"), ["universe_id", "ws"], "left")
        .join(per(tokens, "tokens"), ["universe_id", "ws"], "left")
        .join(per(expected, "expected"), ["universe_id", "ws"], "left")
        .na.fill(0, subset=["commits", "tokens", "expected"])
        .join(stream_time, "universe_id")
    )
    end = F.col("ws") + size_ms
    code = (
        F.when(F.col("stream_time") < end, 1)
        .when((F.col("stream_time") < end + grace_ms) & ~((F.col("commits") > 0) & (F.col("commits") == F.col("expected"))), 2)
        .when(F.col("stream_time") < end + grace_ms, 3)
        .when((F.col("commits") > 0) & (F.col("commits") == F.col("tokens")), 5)
        .otherwise(4)
    )
    return facts.select("universe_id", "ws", code.cast("bigint").alias("status"), "commits", "tokens")


def band(mean: Column, stddev: Column) -> tuple[Column, Column]:
    """Interval of half a standard deviation on either side of the mean."""
    return mean - stddev / 2, mean + stddev / 2

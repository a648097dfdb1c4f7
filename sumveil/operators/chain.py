"""Timestamp chains of producers: order guard, previous timestamp, boundary records,
completeness and late records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sumveil.functions.timewin import floor_mod, idiv, window_start
from sumveil.operators.scan import running_before
from sumveil.session import spread

KEYS = ["universe_id", "producer_id"]
SEQ_BLOCK = 1 << 16
SLICE_MS = 60_000


def order_guard(df: DataFrame, keys: list[str], seq: str, ts: str, width: int = SEQ_BLOCK) -> DataFrame:
    """Flag records whose time exceeds every earlier one of the producer in arrival order."""
    scanned = running_before(df, keys, seq, ts, width, "max", "_seen")
    return scanned.withColumn("accepted", F.col("_seen").isNull() | (F.col(ts) > F.col("_seen"))).drop("_seen")


def late_split(df: DataFrame, keys: list[str], seq: str, ts: str, size_ms: int, grace_ms: int, width: int = SEQ_BLOCK) -> DataFrame:
    """Flag records that arrive once stream time has passed window end plus grace.

    Stream time is the largest timestamp seen so far in the record's log partition.
    """
    scanned = running_before(df, keys, seq, ts, width, "max", "_seen")
    closes = window_start(F.col(ts), size_ms) + size_ms + grace_ms
    return scanned.withColumn("late", F.coalesce(closes <= F.col("_seen"), F.lit(False))).drop("_seen")


def with_window(df: DataFrame, size_ms: int, ts: str = "ts_ms") -> DataFrame:
    return df.withColumn("ws", window_start(F.col(ts), size_ms))


def with_previous(
    df: DataFrame,
    size_ms: int,
    keys: list[str] = KEYS,
    ts: str = "ts_ms",
    slice_ms: int = SLICE_MS,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Add ``ws`` and ``prev_ts``, the producer's previous time in the window (``ws - 1`` first).

    Windows are cut into time slices.  A chain's times are distinct milliseconds, so a
    slice of a producer has at most ``slice_ms`` rows; the first row of a slice takes
    the last time of the nearest earlier slice.  ``carried`` adds per-producer columns
    (such as its key) on the slice summaries, where one row stands for many events.
    """
    rows = with_window(df, size_ms, ts).withColumn("_slice", idiv(floor_mod(F.col(ts), size_ms), slice_ms))
    summary = rows.groupBy(*keys, "ws", "_slice").agg(F.max(ts).alias("_last"))
    by_slice = Window.partitionBy(*keys, "ws").orderBy("_slice")
    summary = summary.select(
        *keys, "ws", "_slice", F.coalesce(F.lag("_last").over(by_slice), F.col("ws") - 1).alias("_from")
    )
    if carried is not None:
        summary = summary.join(carried, "producer_id")
    in_slice = Window.partitionBy(*keys, "ws", "_slice").orderBy(ts)
    rows = spread(rows, *keys, "ws", "_slice").withColumn("_lag", F.lag(ts).over(in_slice))
    return (
        rows.join(summary, [*keys, "ws", "_slice"])
        .withColumn("prev_ts", F.coalesce("_lag", "_from"))
        .drop("_slice", "_lag", "_from")
    )


def window_spans(
    df: DataFrame, size_ms: int, keys: list[str] = KEYS, ts: str = "ts_ms", value: str | None = None,
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Per (producer, window): number of values, last value time, sums of measures, whether the producer moved on.

    One pass over the records.  Rows whose ``value`` is null are heartbeats: they only
    show that time has advanced.  What follows works on one row per window, so a
    producer's rows are as many as the timeline has windows.
    """
    has_value = F.lit(True) if value is None else F.col(value).isNotNull()
    w = with_window(df, size_ms, ts).groupBy(*keys, "ws").agg(
        F.count(F.when(has_value, 1)).alias("n_values"),
        F.max(F.when(has_value, F.col(ts))).alias("max_ts"),
        *[F.sum(c).alias(name) for name, c in (measures or {}).items()],
    )
    return w.withColumn("moved_on", F.col("ws") < F.max("ws").over(Window.partitionBy(*keys)))


def boundary_rows(spans: DataFrame, size_ms: int, keys: list[str] = KEYS) -> DataFrame:
    """The empty record at ``we - 1`` a producer sends when it leaves a non-empty window."""
    end = F.col("ws") + size_ms - 1
    return spans.filter(F.col("moved_on") & (F.col("n_values") > 0) & (F.col("max_ts") != end)).select(
        *keys, "ws", end.alias("ts_ms"), F.col("max_ts").alias("prev_ts")
    )


def complete(min_prev: Column, max_ts: Column, ws: Column, size_ms: int) -> Column:
    """A gap-free chain from ``ws - 1`` to ``we - 1``."""
    return (min_prev == ws - 1) & (max_ts == ws + size_ms - 1)


def complete_windows(spans: DataFrame, size_ms: int, keys: list[str] = KEYS) -> DataFrame:
    """(producer, window) pairs whose chain, with its boundary record, spans the window."""
    at_end = F.col("max_ts") == F.col("ws") + size_ms - 1
    return spans.filter((F.col("n_values") > 0) & (F.col("moved_on") | at_end)).select(*keys, "ws")

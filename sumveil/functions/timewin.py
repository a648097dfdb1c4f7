"""Tumbling windows, epochs and labels on millisecond columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def millis(ts: Column) -> Column:
    """Wall-clock milliseconds of a zone-less timestamp, whatever the session zone."""
    return F.unix_millis(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def window_start(ts_ms: Column, size_ms: int | Column) -> Column:
    """Epoch-aligned start; floors for negative times too."""
    return ts_ms - floor_mod(ts_ms, size_ms)


def idiv(a: Column, b) -> Column:
    """Integer division truncating towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def floor_mod(a: Column, size: int | Column) -> Column:
    return F.pmod(a, size if isinstance(size, Column) else F.lit(size).cast("bigint"))


def window_ordinal(ws: Column, size_ms: int) -> Column:
    """1-based position of a window within its day."""
    return idiv(floor_mod(ws, DAY_MS), size_ms) + 1


def clock_label(ms: Column) -> Column:
    """HH:mm:ss of a millisecond time, in UTC and independent of the session zone."""
    of_day = floor_mod(ms, DAY_MS)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", two(idiv(of_day, 3_600_000)), two(idiv(of_day, 60_000) % 60), two(idiv(of_day, 1000) % 60))


def range_label(ws: Column, we: Column) -> Column:
    return F.format_string("W[%s, %s)", clock_label(ws), clock_label(we))


def epoch_start(ws: Column, size_ms: int, rounds: int | Column) -> Column:
    """Start of the epoch of so many windows; ``rounds`` may differ by row."""
    return window_start(ws, size_ms * rounds)


def round_index(ws: Column, size_ms: int, rounds: int | Column) -> Column:
    return idiv(ws - epoch_start(ws, size_ms, rounds), size_ms)

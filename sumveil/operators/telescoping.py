"""Telescoping-key encryption of vectors: v + F(ts) - F(prev), modulo 2^64.

Sums over a gap-free chain keep only the outermost keys, so a window sum needs two
key vectors, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumveil.functions.prf import key_difference
from sumveil.functions.vectors import combine, vector_sum
from sumveil.session import spread
from sumveil.operators.chain import SLICE_MS, boundary_rows, window_spans, with_previous

WINDOW = ["universe_id", "producer_id", "ws"]


def encrypt_stream(
    events: DataFrame, keys: DataFrame, vector: Column, n_lanes: int, size_ms: int, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Encrypt each event's vector; the output has ``ts_ms``, ``prev_ts`` and ``c``.

    Both keys of an event come from one cipher call.
    """
    rows = with_previous(events.withColumn("_x", vector), size_ms, slice_ms=slice_ms, carried=keys)
    gap = key_difference(F.col("key"), F.col("ts_ms"), F.col("prev_ts"), n_lanes)
    return rows.withColumn("c", combine(n_lanes, [F.col("_x"), gap])).drop("_x", "key")


def encrypt_chained(rows: DataFrame, keys: DataFrame, n_lanes: int) -> DataFrame:
    """Encrypt records that carry ``prev_ts`` and their vector ``x``, boundary records included."""
    gap = key_difference(F.col("key"), F.col("ts_ms"), F.col("prev_ts"), n_lanes)
    keyed = rows.join(keys, "producer_id").withColumn("c", combine(n_lanes, [F.col("x"), gap]))
    return keyed.select(*WINDOW, "prev_ts", "ts_ms", "c")


def decrypt(df: DataFrame, keys: DataFrame, cipher: str, start: Column, end: Column, n_lanes: int, out: str = "v") -> DataFrame:
    """Subtract F(end) - F(start) from a vector; for one event or a whole window."""
    keyed = df.withColumn("_start", start).withColumn("_end", end).join(keys, "producer_id")
    keyed = keyed.withColumn("_k", key_difference(F.col("key"), F.col("_end"), F.col("_start"), n_lanes))
    return keyed.withColumn(out, combine(n_lanes, [F.col(cipher)], [F.col("_k")])).drop("_start", "_end", "_k", "key")


def outer_times(present: DataFrame, keys: DataFrame, size_ms: int) -> DataFrame:
    """Key and both times of :func:`window_keys` per (producer, window), for those who make the vectors themselves."""
    return present.select(*WINDOW).join(keys.hint("merge"), "producer_id").select(*WINDOW, "key", (F.col("ws") - 1).alias("start"), (F.col("ws") + size_ms - 1).alias("end"))


def window_keys(present: DataFrame, keys: DataFrame, n_lanes: int, size_ms: int) -> DataFrame:
    """``k`` = F(we - 1) - F(ws - 1) per (producer, window), from one cipher call per row."""
    keyed = spread(present.select(*WINDOW).join(keys.hint("merge"), "producer_id"), *WINDOW)
    difference = key_difference(F.col("key"), F.col("ws") + size_ms - 1, F.col("ws") - 1, n_lanes)
    return keyed.select(*WINDOW, difference.alias("k"))


def cipher_window_sums(
    events: DataFrame, keys: DataFrame, vector: Column, n_lanes: int, size_ms: int, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Per-event path: encrypt, add boundary records, sum per (producer, window).

    The output keeps the covered key interval as ``start`` and ``end``.
    """
    events = events.select("universe_id", "producer_id", "ts_ms", vector.alias("x"))
    enc = encrypt_stream(events, keys, F.col("x"), n_lanes, size_ms, slice_ms).select(*WINDOW, "ts_ms", "prev_ts", "c")
    edge = boundary_rows(window_spans(events, size_ms), size_ms)
    gap = key_difference(F.col("key"), F.col("ts_ms"), F.col("prev_ts"), n_lanes)
    edge = edge.join(keys, "producer_id").select(*WINDOW, "ts_ms", "prev_ts", gap.alias("c"))
    both = enc.unionByName(edge)
    return vector_sum(
        both, WINDOW, "c", n_lanes,
        extra=[F.min("prev_ts").alias("start"), F.max("ts_ms").alias("end")], out="c",
    )


def mask_window_sums(sums: DataFrame, wkeys: DataFrame, vector: str, n_lanes: int, out: str = "c") -> DataFrame:
    """Telescoped path: encrypt summed vectors of complete windows with the outer keys only.

    Equal to the per-event path on complete windows, with two key vectors per
    (producer, window) in place of two per event.
    """
    return sums.join(wkeys.hint("merge"), WINDOW).select(*WINDOW, combine(n_lanes, [F.col(vector), F.col("k")]).alias(out))

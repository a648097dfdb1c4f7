"""Stateful steps over the records of one producer, taken in event-time order.

Records wait in the state until the watermark has passed them, so those that come out
of order within the grace are put in order; later ones are dropped by the watermark.
A step leaves a timer at its next due time, so a trigger touches only keys with new
records or something due.  The state of a key holds what the grace spans.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sumveil.session import ship

KEYS = ["universe_id", "producer_id"]


def _stateful(df: DataFrame, keys: list[str], step: Callable, output: str, state: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandasWithState(step, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def _keep(state, due: int | None, values: tuple) -> None:
    """Store a state until ``due``; nothing due means nothing to remember."""
    if due is None:
        if state.exists:
            state.remove()
        return
    state.update(values)
    state.setTimeoutTimestamp(max(due - 1, state.getCurrentWatermarkMs()))


# ------------------------------------------------------------------ key chains


def _chain(size_ms: int, n_lanes: int):
    zeros = [0] * n_lanes

    def step(key, frames, state):
        held, flat, last = state.get if state.exists else ([], [], None)
        times, vectors = [np.array(held, "int64")], [np.array(flat, "int64").reshape(-1, n_lanes)]
        if not state.hasTimedOut:
            for pdf in frames:
                times.append(pdf["ts_ms"].to_numpy("int64"))
                vectors.append(np.array(pdf["x"].tolist(), "int64").reshape(-1, n_lanes))
        times, vectors = np.concatenate(times), np.concatenate(vectors)
        order = np.argsort(times, kind="stable")
        times, vectors = times[order], vectors[order]
        now = state.getCurrentWatermarkMs()
        ready = int(np.searchsorted(times, now, side="right"))
        out = []

        def close(before):
            # Times below ``before`` are over: an open window that ends there gets its boundary record.
            nonlocal last
            if last is not None:
                start = last - last % size_ms
                end = start + size_ms - 1
                if end < before:
                    if last != end:
                        out.append((start, last, end, zeros))
                    last = None

        for ts, x in zip(times[:ready].tolist(), vectors[:ready].tolist()):
            close(ts)
            start = ts - ts % size_ms
            out.append((start, start - 1 if last is None else last, ts, x))
            last = ts
        close(now + 1)
        due = [int(times[ready])] if ready < len(times) else []
        if last is not None:
            due.append(last - last % size_ms + size_ms - 1)
        _keep(state, min(due) if due else None, (times[ready:].tolist(), vectors[ready:].ravel().tolist(), last))
        if out:
            rows = pd.DataFrame(out, columns=["ws", "prev_ts", "ts_ms", "x"])
            rows.insert(0, "producer_id", key[1])
            rows.insert(0, "universe_id", key[0])
            yield rows

    return step


def chained(events: DataFrame, vector: Column, n_lanes: int, size_ms: int) -> DataFrame:
    """Events of a timed stream with the time of the record before, and boundary records.

    The first record of a window follows ``ws - 1``; an empty record at the window's end
    closes it as soon as the watermark is there, with or without a later event.
    """
    rows = events.select(*KEYS, "ts_ms", vector.alias("x"), "event_time")
    output = "universe_id bigint, producer_id bigint, ws bigint, prev_ts bigint, ts_ms bigint, x array<bigint>"
    return _stateful(rows, KEYS, _chain(size_ms, n_lanes), output, "held array<bigint>, flat array<bigint>, last bigint")


# ------------------------------------------------------------------ membership


def _member(size_ms: int):
    def step(key, frames, state):
        held, last = state.get if state.exists else ([], None)
        windows = set(held)
        if not state.hasTimedOut:
            for pdf in frames:
                windows.update(pdf["ws"].tolist())
        now = state.getCurrentWatermarkMs()
        out = []

        def drop(before):
            nonlocal last
            if last is not None and last + size_ms < before:
                out.append((last + size_ms, -1))
                last = None

        for ws in sorted(w for w in windows if w <= now):
            drop(ws)
            if last is None:
                out.append((ws, 1))
            last = ws
        later = sorted(w for w in windows if w > now)
        if last is None or last + size_ms not in later:
            drop(now + 1)
        due = later[:1] + ([last + size_ms] if last is not None else [])
        _keep(state, min(due) if due else None, (later, last))
        if out:
            rows = pd.DataFrame(out, columns=["ws", "diff"])
            rows.insert(0, "producer_id", key[1])
            rows.insert(0, "universe_id", key[0])
            yield rows[["universe_id", "ws", "producer_id", "diff"]]

    return step


def membership_changes(commits: DataFrame, size_ms: int) -> DataFrame:
    """Stream of +1 and -1 per (universe, window, producer) from a stream of commits.

    The state is one counter per producer, never a list of a universe's members.  A
    diff comes out once the watermark has passed its window's start; the event time of
    a commit is that start.  Repeated commits count once.
    """
    rows = commits.select(*KEYS, "ws", "event_time")
    output = "universe_id bigint, ws bigint, producer_id bigint, diff bigint"
    return _stateful(rows, KEYS, _member(size_ms), output, "held array<bigint>, last bigint")


# --------------------------------------------------------------------- release


def _accumulate(n_lanes: int, retention_ms: int):
    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        total = np.array(state.get[0], "int64") if state.exists else np.zeros(n_lanes + 2, "int64")
        released = state.exists and not len(total)
        for pdf in frames:
            if not released:
                total = total + np.array(pdf["v"].tolist(), "int64").reshape(-1, n_lanes + 2).sum(axis=0)
        done = not released and total[n_lanes] == total[n_lanes + 1] > 0
        state.update(([] if released or done else total.tolist(),))
        state.setTimeoutTimestamp(max(int(key[1]) + retention_ms, state.getCurrentWatermarkMs()))
        if done:
            yield pd.DataFrame({"universe_id": [key[0]], "ws": [key[1]], "producers": [int(total[n_lanes])], "v": [total[:n_lanes].tolist()]})

    return step


def release_stream(ciphers: DataFrame, tokens: DataFrame, expected: DataFrame, n_lanes: int, retention_ms: int) -> DataFrame:
    """Population sums, each out once: when every expected producer's cipher and token are there.

    ``ciphers`` (universe_id, producer_id, ws, c) and ``tokens`` (..., token) are streams of
    vectors, ``expected`` (universe_id, ws, producers) tells how many producers committed.
    A cipher meets its token in a stream-stream join, so tokens of others are ignored;
    repeats of either are dropped.  The pairs are summed per task, and only those sums
    reach the accumulator of their (universe, window), so a large universe is not
    gathered under one key.  A window is forgotten, released or not, once the watermark
    passes it by ``retention_ms``.
    """
    from sumveil.functions import wide
    from sumveil.functions.vectors import combine, zeros

    def once(df, keys, *columns):
        at = df.withColumn("event_time", F.timestamp_millis("ws")).withWatermark("event_time", f"{retention_ms} milliseconds")
        return at.dropDuplicatesWithinWatermark(keys).select(*keys, "event_time", *columns)

    key, window = ["universe_id", "producer_id", "ws"], ["universe_id", "ws", "event_time"]
    left = once(ciphers, key, "c")
    right = once(tokens, key, "token").select(*[F.col(k).alias(f"_{k}") for k in key], F.col("event_time").alias("_time"), "token")
    same = (F.col("event_time") == F.col("_time")) & (F.col("universe_id") == F.col("_universe_id"))
    met = left.join(right, same & (F.col("producer_id") == F.col("_producer_id")) & (F.col("ws") == F.col("_ws")))
    counts = lambda pairs, n: F.array(F.lit(pairs).cast("bigint"), F.lit(n).cast("bigint") if isinstance(n, int) else n)
    paired = met.select(*window, F.concat(combine(n_lanes, [F.col("c"), F.col("token")]), counts(1, 0)).alias("v"))
    told = once(expected, ["universe_id", "ws"], "producers")
    told = told.select(*window, F.concat(zeros(n_lanes), counts(0, F.col("producers").cast("bigint"))).alias("v"))
    parts = wide.batch_sums(paired.unionByName(told), window, "v", None, n_lanes + 2)
    output = "universe_id bigint, ws bigint, producers bigint, v array<bigint>"
    return _stateful(parts, ["universe_id", "ws"], _accumulate(n_lanes, retention_ms), output, "total array<bigint>")

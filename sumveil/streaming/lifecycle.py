"""Window life cycle as a stream: 1 open, 2 staged, 3 committed, 4 merged, 5 closed.

State is kept per universe.  Records reach it as summaries: values, commits and
tokens are first made unique per (universe, producer, window), spread over all
producers, and then combined inside each task, so a state key receives a few rows
per task and trigger, however many records its universe has.  Windows are state entries
of their own.  A window changes only when a fact reaches it or stream time passes its
end, its grace or its retention; times passed between two triggers belong to ranges of
starts, so a trigger reads the windows it touches and those due, never all open ones.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from sumveil.functions.timewin import window_start

# The stateful processor is also loaded by a worker on the driver, which does not see shipped files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTS = "universe_id bigint, kind string, ws bigint, n bigint, max_ts bigint"
OUTPUT = StructType([StructField(c, LongType()) for c in ("universe_id", "ws", "status", "commits", "tokens")])
WINDOW_STATE = "status bigint, expected bigint, commits bigint, tokens bigint, due bigint"
_SLOT = {"value": 1, "commit": 2, "token": 3}
_NEVER = 1 << 62


def combine(batches):
    """Per Arrow batch: one row per (universe, kind, window)."""
    for pdf in batches:
        if len(pdf):
            out = pdf.groupby(["universe_id", "kind", "ws"], as_index=False).agg(n=("ts_ms", "size"), max_ts=("ts_ms", "max"))
            yield out[["universe_id", "kind", "ws", "n", "max_ts"]]


def facts(df: DataFrame, kind: str, size_ms: int, grace_ms: int, ts: str = "ts_ms") -> DataFrame:
    """One fact per (universe, producer, window); ``kind`` is value, commit or token.

    A key must be remembered until its window ends and grace is over, counted from its
    first record; so the watermark lags by window and grace, and repeats in later
    micro-batches of the window are found too.  What is too late is left to the life
    cycle, which knows the stream time of the universe.
    """
    if "ws" not in df.columns:
        df = df.withColumn("ws", window_start(F.col(ts), size_ms))
    t = df.select("universe_id", "producer_id", "ws", F.col(ts).alias("ts_ms"))
    t = t.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", f"{size_ms + grace_ms} milliseconds")
    unique = t.dropDuplicatesWithinWatermark(["universe_id", "producer_id", "ws"])
    return unique.select("universe_id", F.lit(kind).alias("kind"), "ws", "ts_ms")


def clock(df: DataFrame, size_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Stream time carried by every record, heartbeats included."""
    return df.select(
        "universe_id", F.lit("clock").alias("kind"), window_start(F.col(ts), size_ms).alias("ws"), F.col(ts).alias("ts_ms")
    )


class Lifecycle(StatefulProcessor):
    """Counts per unfinished window; emits every state a window reaches."""

    size_ms = 0
    grace_ms = 0
    deadline_ms: int | None = None
    retention_ms = 0

    def init(self, handle):
        self.handle = handle
        self.windows = handle.getMapState("windows", "ws bigint", WINDOW_STATE)
        self.clock = handle.getValueState("clock", "stream_time bigint, newest bigint")
        # Staged windows by the time their commit phase ends: first and last start.
        self.staged = handle.getMapState("staged", "due bigint", "lo bigint, hi bigint")

    def _target(self, start, w, now, wall):
        end = start + self.size_ms
        _, expected, commits, tokens, due = w
        if now < end:
            return 1
        settled = now >= end + self.grace_ms if self.deadline_ms is None else wall >= due or (0 < commits == expected)
        if not settled:
            return 3 if 0 < commits == expected else 2
        return 5 if 0 < commits == tokens else 4

    def _find(self, windows, start):
        """The window's entry, read once per trigger; None if it is finished or not there yet."""
        if start not in windows:
            windows[start] = list(self.windows.getValue((start,))) if self.windows.containsKey((start,)) else None
        return windows[start]

    def _due(self, before, now, phase):
        """Starts of the windows whose end, grace or retention lies in (before, now]."""
        for offset in (self.size_ms, self.size_ms + self.grace_ms, self.size_ms + self.grace_ms + self.retention_ms):
            low = before - offset + 1
            yield from range(low + (phase - low) % self.size_ms, now - offset + 1, self.size_ms)

    def _stage(self, start, wall):
        due = wall + self.deadline_ms
        lo, hi = self.staged.getValue((due,)) if self.staged.containsKey((due,)) else (start, start)
        self.staged.updateValue((due,), (min(lo, start), max(hi, start)))
        self.handle.registerTimer(due)
        return due

    def _advance(self, key, windows, now, newest, wall):
        out = []
        for start in sorted(s for s, w in windows.items() if w is not None):
            w = windows[start]
            if newest is None or start > newest:  # facts came before the window opened
                self.windows.updateValue((start,), tuple(w))
                continue
            if self.deadline_ms is not None and now >= start + self.size_ms and w[4] == _NEVER:
                w[4] = self._stage(start, wall)
            target = self._target(start, w, now, wall)
            for status in range(w[0] + 1, target + 1):
                if status != 3 or w[2] > 0:
                    out.append((int(key[0]), start, status, w[2], w[3]))
            w[0] = max(w[0], target)
            if w[0] == 5 or now >= start + self.size_ms + self.grace_ms + self.retention_ms:
                if self.windows.containsKey((start,)):
                    self.windows.removeKey((start,))
            else:
                self.windows.updateValue((start,), tuple(w))
        return out

    def _wall(self, timerValues):
        return timerValues.getCurrentProcessingTimeInMs() if self.deadline_ms is not None else 0

    def handleInputRows(self, key, rows, timerValues):
        now, newest = self.clock.get() if self.clock.exists() else (None, None)
        windows: dict = {}
        seen, lowest, highest, before = newest, None, newest, now
        for pdf in rows:
            for kind, ws, n, max_ts in zip(pdf["kind"], pdf["ws"].tolist(), pdf["n"].tolist(), pdf["max_ts"].tolist()):
                if kind == "clock":
                    now = max_ts if now is None else max(now, max_ts)
                    lowest = ws if lowest is None else min(lowest, ws)
                    highest = ws if highest is None else max(highest, ws)
                    continue
                w = self._find(windows, ws)
                if seen is not None and ws <= seen and w is None:
                    continue  # the window is finished
                late = before is not None and before >= ws + self.size_ms + self.grace_ms
                if late and self.deadline_ms is None and kind != "token":
                    continue  # grace was over before this trigger
                if w is None:
                    w = windows[ws] = [0, 0, 0, 0, _NEVER]
                if kind == "commit" and self.deadline_ms is not None and w[0] >= 3:
                    continue  # the committed sum is frozen
                w[_SLOT[kind]] += n
        if highest is not None:
            for ws in range(lowest if seen is None else seen + self.size_ms, highest + 1, self.size_ms):
                if self._find(windows, ws) is None:
                    windows[ws] = [0, 0, 0, 0, _NEVER]
            if before is None:  # the first clock: facts may have come for any window
                for (ws,), w in self.windows.iterator():
                    if windows.get(ws) is None:
                        windows[ws] = list(w)
            else:
                for ws in self._due(before, now, highest % self.size_ms):
                    self._find(windows, ws)
            self.clock.update((now, highest))
        out = self._advance(key, windows, now, highest, self._wall(timerValues))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in OUTPUT.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, newest = self.clock.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        windows: dict = {}
        if self.staged.containsKey((due,)):
            lo, hi = self.staged.getValue((due,))
            self.staged.removeKey((due,))
            for start in range(lo, hi + 1, self.size_ms):
                self._find(windows, start)
        out = self._advance(key, windows, now, newest, max(self._wall(timerValues), due))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in OUTPUT.fields])

    def close(self):
        pass


def lifecycle(
    clocks: DataFrame, fact_rows: DataFrame, size_ms: int, grace_ms: int, deadline_ms: int | None = None,
    retention_ms: int = 400 * 86_400_000,
) -> DataFrame:
    """Status rows (universe, ws, status, commits, tokens) out of clock and fact streams.

    Without a deadline commits are settled when grace is over in stream time; with
    one, a processing-time timer started at staging settles them, unless everybody
    has committed before.  Unfinished windows are forgotten after the retention.
    Needs the RocksDB state store.
    """
    settings = dict(size_ms=size_ms, grace_ms=grace_ms, deadline_ms=deadline_ms, retention_ms=retention_ms)
    processor = Lifecycle()
    for name, value in settings.items():
        setattr(processor, name, value)
    both = clocks.mapInPandas(combine, FACTS).unionByName(fact_rows.mapInPandas(combine, FACTS))
    return both.groupBy("universe_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append",
        timeMode="None" if deadline_ms is None else "ProcessingTime",
    )

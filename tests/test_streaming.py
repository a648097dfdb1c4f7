import os
import tempfile
import time

import pandas as pd
from pyspark.sql import functions as F

from sumveil.functions import encodings as enc
from sumveil.functions.timewin import window_start
from sumveil.sources import fixtures as fx, records as rec
from sumveil.streaming import lifecycle as lc, windows as st

SF = "/root/testdata/sf0.001"
W = fx.W
GRACE = 3_600_000


def fresh():
    return tempfile.mkdtemp(prefix="sumveil-test-")


def write_in_order(df, folder, parts):
    """Files in time order, so that each micro-batch advances the watermark."""
    bounds = [r.q for r in df.select(F.explode(F.percentile("ts_ms", [i / parts for i in range(1, parts)])).alias("q")).collect()]
    low = None
    for high in [*bounds, None]:
        part = df if low is None else df.filter(F.col("ts_ms") > low)
        part = part if high is None else part.filter(F.col("ts_ms") <= high)
        part.coalesce(1).sortWithinPartitions("ts_ms").write.mode("append").parquet(folder)
        low = high


def sums(folder, spark):
    s = st.timed(st.read_stream(spark, folder, max_files=1), GRACE)
    return st.producer_sums(s, W, dict(zip("sqn", enc.var_lanes(F.col("value")))))


def closed(df):
    last = df.agg(F.max("ts_ms")).first()[0]
    w = df.withColumn("ws", window_start(F.col("ts_ms"), W)).filter(F.col("ws") + W <= last - GRACE)
    return w.groupBy("universe_id", "producer_id", "ws").agg(F.sum("value").alias("s"), F.count("*").alias("n"))


def test_stream_equals_batch_after_restart(spark):
    df = fx.std(spark, SF)
    src, out = fresh(), fresh()
    early = df.filter("ts_ms < 1705000000000")
    write_in_order(early, src, 3)
    first = st.run_to_table(st.with_start(sums(src, spark)), "t", folder=out)
    got = lambda rows: {(r.producer_id, r.ws, r.s, r.n) for r in rows.collect()}
    assert got(first) == got(closed(early))
    write_in_order(df.filter("ts_ms >= 1705000000000"), src, 3)
    assert got(st.run_to_table(st.with_start(sums(src, spark)), "t", folder=out)) == got(closed(df))


def test_late_rows_are_dropped_by_the_watermark(spark):
    src = fresh()
    rows = lambda ts: spark.createDataFrame([(1, 1, t, 1) for t in ts], "universe_id bigint, producer_id bigint, ts_ms bigint, value bigint")
    # Late rows are judged by the watermark two batches back; 30 comes after its window has closed.
    for batch in ([10, 20], [W + GRACE + 5], [W + GRACE + 6], [30, 3 * W]):
        rows(batch).coalesce(1).write.mode("append").parquet(src)
    got = st.run_to_table(st.with_start(sums(src, spark)), "late")
    assert {(r.ws, r.n) for r in got.collect()} == {(0, 2), (W, 2)}


FACT = "universe_id bigint, producer_id bigint, ws bigint, ts_ms bigint"


T0 = 1_000_000


def run_lifecycle(spark, events, commits, tokens, deadline=None, folder=None, src=None, until=None):
    src = src or {k: fresh() for k in ("events", "commit", "token")}
    ev = spark.createDataFrame([(1, p, (T0 + t) // 1000 * 1000, T0 + t) for p, t in events], FACT)
    ev.coalesce(1).write.mode("append").parquet(src["events"])
    for kind, rows in (("commit", commits), ("token", tokens)):
        spark.createDataFrame([(1, p, T0 + w, T0 + w) for p, w in rows], FACT).coalesce(1).write.mode("append").parquet(src[kind])
    read = lambda k: st.read_stream(spark, src[k])
    facts = lc.facts(read("events"), "value", 1000, 500)
    for kind in ("commit", "token"):
        facts = facts.unionByName(lc.facts(read(kind), kind, 1000, 10_000_000))
    out = lc.lifecycle(lc.clock(read("events"), 1000), facts, 1000, 500, deadline)
    folder = folder or fresh()

    def seen():
        got = {}
        for r in spark.read.schema(out.schema).parquet(f"{folder}/rows").collect():
            got.setdefault(r.ws - T0, []).append(r.status)
        return {w: sorted(x) for w, x in got.items()}

    if deadline is None:
        st.run_to_table(out, "life", folder=folder, provider=st.ROCKSDB)
        return seen(), folder, src
    q = st.start(out, folder, provider=st.ROCKSDB, processingTime="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            assert q.isActive, q.exception()
            if os.path.exists(f"{folder}/rows/_spark_metadata/0") and until(seen()):
                break
    finally:
        q.stop()
    return seen(), folder, src


def test_lifecycle_states_and_restart(spark):
    # Window 0: all commit and send tokens; 1000 is empty; 2000: one token missing; 3000: still open.
    events = [(1, 10), (2, 20), (1, 2010), (2, 2020), (1, 3900)]
    got, folder, src = run_lifecycle(spark, events, [(1, 0), (2, 0), (1, 2000), (2, 2000)], [(1, 0), (2, 0), (1, 2000)])
    assert got == {0: [1, 2, 3, 4, 5], 1000: [1, 2, 4], 2000: [1, 2, 3, 4], 3000: [1]}
    # The rest of the stream: the missing token arrives, time moves on; nothing is emitted twice.
    got, _, _ = run_lifecycle(spark, [(1, 9000)], [], [(2, 2000)], folder=folder, src=src)
    assert got[0] == [1, 2, 3, 4, 5] and got[2000] == [1, 2, 3, 4, 5] and got[3000] == [1, 2, 4]


def test_lifecycle_deadline_starts_at_staging(spark):
    """Producer 2 never commits: a timer started at staging ends the commit phase."""
    done = lambda got: 5 in got.get(0, [])
    got, _, _ = run_lifecycle(spark, [(1, 10), (2, 20), (1, 1100)], [(1, 0)], [(1, 0)], deadline=1500, until=done)
    assert got == {0: [1, 2, 3, 4, 5], 1000: [1]}


def test_malformed_lines_are_kept_apart(spark):
    folder = fresh()
    lines = ["1;100;50;10;0;5;20", "2;x;50;10;0;5;20", "3;100;50", "4;90;-5;1;1;0;-3"]
    spark.createDataFrame([(l,) for l in lines], "value string").write.mode("append").text(folder)
    good, bad = rec.read_trace_lines(spark, folder)
    assert {r.timestamp for r in good.collect()} == {1, 4}
    assert {r.line for r in bad.collect()} == {lines[1], lines[2]}


class CountedMap:
    """Map state in memory that counts the entries it hands out."""

    def __init__(self):
        self.rows, self.reads = {}, 0

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        self.reads += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def iterator(self):
        self.reads += len(self.rows)
        return iter(list(self.rows.items()))


class OneValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def getMapState(self, name, *schema):
        return CountedMap()

    def getValueState(self, name, *schema):
        return OneValue()


def test_a_trigger_reads_touched_and_due_windows_only():
    processor = lc.Lifecycle()
    processor.size_ms, processor.grace_ms, processor.retention_ms = 1000, 500, 10**12
    processor.init(Handle())
    send = lambda *rows: [
        tuple(r) for out in processor.handleInputRows((1,), [pd.DataFrame(rows, columns=["kind", "ws", "n", "max_ts"])], None) for r in out.values.tolist()
    ]
    n = 200_000
    send(("clock", 0, 1, 10))
    send(("value", 5000, 2, 5000), ("clock", 1000 * n, 1, 1000 * n + 10))  # all windows before stay unfinished: no commits
    assert len(processor.windows.rows) == n + 1
    processor.windows.reads = 0
    # One more window opens, one ends, two pass their grace, and a late token touches one.
    got = send(("token", 7000, 1, 7000), ("clock", 1000 * (n + 1), 1, 1000 * (n + 1) + 600))
    assert processor.windows.reads <= 8
    assert got == [(1, 1000 * (n - 1), 4, 0, 0), (1, 1000 * n, 2, 0, 0), (1, 1000 * n, 4, 0, 0), (1, 1000 * (n + 1), 1, 0, 0)]
    assert processor.windows.rows[(7000,)][3] == 1

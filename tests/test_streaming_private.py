"""Streaming encryption, membership and release in small micro-batches, records out of order within the grace."""

import tempfile

import pytest
from pyspark.sql import functions as F

from sumveil.operators import membership as mb
from sumveil.streaming import keyed, windows as st

W, GRACE = 1000, 300


def fresh():
    return tempfile.mkdtemp(prefix="sumveil-test-")


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


EVENT = "universe_id bigint, producer_id bigint, ts_ms bigint, value bigint"


def test_chains_over_micro_batches(spark):
    source, folder = fresh(), fresh()
    run = lambda: st.run_to_table(
        keyed.chained(st.timed(st.read_stream(spark, source, 1), GRACE), F.array("value", F.lit(1).cast("bigint")), 2, W), "chain", folder=folder
    )
    # Producer 1: out of order within the grace, a gap of two windows; producer 2: a record on the window's last millisecond.
    add(spark, source, [(1, 1, 5100, 7), (1, 1, 5050, 8), (1, 2, 5200, 9)], EVENT)
    run()
    add(spark, source, [(1, 1, 5080, 5)], EVENT)
    run()
    add(spark, source, [(1, 2, 5999, 2)], EVENT)
    run()
    add(spark, source, [(1, 1, 5090, 4)], EVENT)  # too late
    run()
    add(spark, source, [(1, 1, 8010, 6), (1, 3, 8400, 1)], EVENT)
    got = {(r.producer_id, r.ws, r.prev_ts, r.ts_ms, tuple(r.x)) for r in run().collect()}
    assert got == {
        (1, 5000, 4999, 5050, (8, 1)), (1, 5000, 5050, 5080, (5, 1)), (1, 5000, 5080, 5100, (7, 1)), (1, 5000, 5100, 5999, (0, 0)),
        (2, 5000, 4999, 5200, (9, 1)), (2, 5000, 5200, 5999, (2, 1)), (1, 8000, 7999, 8010, (6, 1)),
    }
    add(spark, source, [(2, 9, 20_000, 0)], EVENT)  # another producer's heartbeat closes what is open
    got = {(r.producer_id, r.ws, r.prev_ts, r.ts_ms, tuple(r.x)) for r in run().collect()} - got
    assert got == {(1, 8000, 8010, 8999, (0, 0)), (3, 8000, 7999, 8400, (1, 1)), (3, 8000, 8400, 8999, (0, 0))}


def test_membership_equals_batch(spark):
    schema = "universe_id bigint, producer_id bigint, ws bigint"
    rows = [(p % 2, p, w * W) for p in range(12) for w in range(1, 30) if (w * (p + 3)) % 7 > 2 and (p + w) % 11]
    source, folder = fresh(), fresh()
    late = W + GRACE  # commits come up to a window late
    run = lambda: st.run_to_table(keyed.membership_changes(st.timed(st.read_stream(spark, source, 1), late, "ws"), W), "members", folder=folder)
    for low in range(1, 30, 3):
        part = [r for r in rows if low <= r[2] // W + r[1] % 2 < low + 3]
        add(spark, source, part + part[:2], schema)
        if low == 13:
            run()
    last = max(r[2] for r in rows) - late
    want = mb.membership_diff(spark.createDataFrame(rows, schema), W).filter(F.col("ws") <= last)
    key = lambda df: sorted((r.universe_id, r.ws, r.producer_id, r.diff) for r in df.collect())
    assert key(run()) == key(want)


@pytest.mark.parametrize("n_lanes", [2, 12])
def test_release_is_all_or_nothing_and_once(spark, n_lanes):
    cipher, token, told = (fresh() for _ in range(3))
    c = "universe_id bigint, producer_id bigint, ws bigint, c array<bigint>"
    t = "universe_id bigint, producer_id bigint, ws bigint, token array<bigint>"
    vec = lambda p: [p + i for i in range(n_lanes)]
    big = (1 << 63) - 1
    add(spark, cipher, [(1, p, w, [big] * n_lanes) for p in (1, 2, 3) for w in (W, 2 * W)] + [(2, 5, W, vec(5))], c)
    add(spark, told, [(1, W, 3), (1, 2 * W, 3), (2, W, 1)], "universe_id bigint, ws bigint, producers bigint")
    key = lambda p: [x - big for x in vec(p)]
    # Window W of universe 1 is complete, with a repeat and a token of a stranger; 2W lacks producer 3.
    add(spark, token, [(1, p, W, key(p)) for p in (1, 2, 3, 3)] + [(1, 9, W, key(9))] + [(1, p, 2 * W, key(p)) for p in (1, 2, 2)], t)
    folder = fresh()
    run = lambda: {
        (r.universe_id, r.ws, r.producers, tuple(r.v))
        for r in st.run_to_table(keyed.release_stream(*[st.read_stream(spark, f, 1) for f in (cipher, token, told)], n_lanes, 50 * W), "release", folder=folder).collect()
    }
    first = {(1, W, 3, tuple(6 + 3 * i for i in range(n_lanes)))}
    assert run() == first
    add(spark, token, [(1, 1, W, key(1)), (2, 5, W, [0] * n_lanes)], t)  # a repeat after release; universe 2 completes
    add(spark, cipher, [(1, 1, W, vec(1))], c)
    assert run() == first | {(2, W, 1, tuple(vec(5)))}
    add(spark, token, [(1, 3, 2 * W, key(3))], t)
    rows = st.run_to_table(keyed.release_stream(*[st.read_stream(spark, f, 1) for f in (cipher, token, told)], n_lanes, 50 * W), "release", folder=folder)
    assert sorted((r.universe_id, r.ws) for r in rows.collect()) == [(1, W), (1, 2 * W), (2, W)]

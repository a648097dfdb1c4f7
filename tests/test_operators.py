import random

import numpy as np
import pytest

from sumveil.operators import chain, commits as cm, history as hs, membership as mb, aggregate as ag
from sumveil.operators.scan import exact_quantile, running_before

W = 10_000


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("agg", ["max", "sum"])
def test_running_before_matches_brute_force(spark, width, agg):
    rnd = random.Random(width)
    # Key 0 holds most rows.
    rows = [(0 if rnd.random() < 0.7 else rnd.randrange(1, 4), seq, rnd.randrange(50)) for seq in range(-20, 280)]
    df = spark.createDataFrame(rows, "k bigint, seq bigint, v bigint")
    for r in running_before(df, ["k"], "seq", "v", width, agg).collect():
        earlier = [v for k, s, v in rows if k == r.k and s < r.seq]
        want = (max(earlier) if earlier else None) if agg == "max" else sum(earlier)
        assert r.before == want


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), rnd.randrange(-40, 40)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    for r in exact_quantile(df, ["k"], "v", q, width=8).collect():
        assert r.quantile == pytest.approx(np.quantile([v for k, v in rows if k == r.k], q))


def events(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "universe_id bigint, producer_id bigint, ts_ms bigint")


@pytest.mark.parametrize("slice_ms", [100, 3000, 60_000])
def test_previous_time_across_slices(spark, slice_ms):
    rnd = random.Random(7)
    rows = sorted({(p, rnd.randrange(-15_000, 40_000)) for p in (1, 2) for _ in range(60)})
    got = {(r.producer_id, r.ts_ms): r.prev_ts for r in chain.with_previous(events(spark, rows), W, slice_ms=slice_ms).collect()}
    assert len(got) == len(rows)
    for p, t in rows:
        start = t // W * W
        inside = [x for q, x in rows if q == p and start <= x < t]
        assert got[(p, t)] == (max(inside) if inside else start - 1)


def test_boundaries_and_completeness(spark):
    # 1: only at we-1, then later window; 2: at ws, then later; 3: nothing after; 4: only at we-1, nothing after
    rows = [(1, 9999), (1, 25_000), (2, 0), (2, 31_000), (3, 5), (4, 9999)]
    spans = chain.window_spans(events(spark, rows), W)
    edges = {(r.producer_id, r.ts_ms, r.prev_ts) for r in chain.boundary_rows(spans, W).collect()}
    assert edges == {(2, 9999, 0)}
    done = {(r.producer_id, r.ws) for r in chain.complete_windows(spans, W).collect()}
    assert done == {(1, 0), (2, 0), (4, 0)}


def test_heartbeat_closes_a_window(spark):
    df = spark.createDataFrame(
        [(1, 1, 10, 5), (1, 1, 20_000, None), (1, 2, 10, 5), (1, 3, 10, None), (1, 3, 20_000, None)],
        "universe_id bigint, producer_id bigint, ts_ms bigint, value bigint",
    )
    spans = chain.window_spans(df, W, value="value")
    assert {(r.producer_id, r.ts_ms) for r in chain.boundary_rows(spans, W).collect()} == {(1, 9999)}


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_order_guard_and_late_split(spark, width):
    rnd = random.Random(11)
    rows = [(rnd.randrange(2), i, rnd.randrange(100_000)) for i in range(120)]
    df = spark.createDataFrame(rows, "p bigint, seq bigint, ts bigint")
    for r in chain.order_guard(df, ["p"], "seq", "ts", width).collect():
        seen = [t for p, s, t in rows if p == r.p and s < r.seq]
        assert r.accepted == (not seen or r.ts > max(seen))
    for r in chain.late_split(df, ["p"], "seq", "ts", W, 5000, width).collect():
        seen = [t for p, s, t in rows if p == r.p and s < r.seq]
        assert r.late == bool(seen and r.ts // W * W + W + 5000 <= max(seen))


KEYS = "universe_id bigint, producer_id bigint, ws bigint"


def test_commit_and_token_joins(spark):
    agg = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 0)], KEYS)
    commits = spark.createDataFrame([(1, 1, 0, 10_500), (1, 1, 0, 10_600), (1, 2, 0, 17_000), (1, 9, 0, 10_000)], KEYS + ", commit_ts bigint")
    on_time = cm.in_time(commits, W, 6000)
    assert {r.producer_id for r in on_time.collect()} == {1, 9}
    assert [r.producer_id for r in cm.commit_join(agg, on_time).collect()] == [1]
    assert {r.producer_id for r in cm.uncommitted(agg, on_time).collect()} == {2, 3}
    assert [r.producer_id for r in cm.incomplete_commits(on_time, agg).collect()] == [9]
    tokens = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 0, 5), (1, 7, 0, 1)], KEYS + ", v bigint")
    assert [(r.producer_id, r.v) for r in cm.token_semi(tokens, cm.committed(agg, on_time)).collect()] == [(1, 5)]


def random_commits(seed):
    rnd = random.Random(seed)
    return sorted({(1, p, w * W) for p in range(6) for w in (0, 1, 2, 4, 5, 6, 7, 8) if rnd.random() < 0.6})


@pytest.mark.parametrize("seed", range(3))
def test_membership_diff_and_epochs(spark, seed):
    rows = random_commits(seed)
    df = spark.createDataFrame(rows, KEYS)
    at = lambda w: {p for _, p, x in rows if x == w}
    last = max(w for _, _, w in rows)
    want = set()
    for w in range(0, last + 1, W):
        want |= {(w, p, 1) for p in at(w) - at(w - W)} | {(w, p, -1) for p in at(w - W) - at(w)}
    diffs = mb.membership_diff(df, W)
    assert {(r.ws, r.producer_id, r.diff) for r in diffs.collect()} == want
    nobody = df.filter("false").select("universe_id", "producer_id")
    assert {r.producer_id for r in mb.apply_diffs(nobody, diffs, 5 * W).collect()} == at(5 * W)
    # Epochs of four windows, replayed one by one.
    windows = sorted({w for _, _, w in rows})
    base, new, ever, epoch, expected, gone = set(), set(), set(), None, {}, set()
    for w in windows:
        e = w // (4 * W)
        if e != epoch:
            epoch, base, new = e, at(w), set()
        new |= at(w) - base
        expected[w] = (len(base), len(new), len((base | new) - at(w)), len(at(w)))
        gone |= {(w, p) for p in (base | new) - at(w)}
    got = {r.ws: (r.base, r.new_members, r.dropped, r.present) for r in mb.epoch_cumulative(df, W, 4).collect()}
    assert got == expected
    assert {(r.ws, r.producer_id) for r in mb.dropped_rows(df, W, 4).collect()} == gone


def test_gap_fill_and_trim(spark):
    t = spark.createDataFrame([(1, 0, 5), (1, 30_000, 2), (2, 10_000, 1)], "universe_id bigint, ws bigint, n bigint")
    assert sorted((r.universe_id, r.ws, r.n) for r in ag.fill_windows(t, W, ["n"]).collect()) == [
        (1, 0, 5), (1, 10_000, 0), (1, 20_000, 0), (1, 30_000, 2), (2, 10_000, 1)
    ]
    runs = spark.createDataFrame([("a", w) for w in range(12)] + [("b", w) for w in range(11)], "run string, ws bigint")
    kept = hs.trim_runs(runs, ["run"]).collect()
    assert {r.run for r in kept} == {"a"} and {r.ws for r in kept} == set(range(2, 10))


def test_fingerprint_ignores_order_and_repeats(spark):
    f = lambda ids, bits=256: ag.member_fingerprint(
        spark.createDataFrame([(1, i) for i in ids], "u bigint, p bigint"), ["u"], "p", bits
    ).first().fingerprint
    assert f([1, 2, 3]) == f([3, 1, 2, 2]) != f([1, 2, 4])
    assert len(f([1, 2], 512)) == 128

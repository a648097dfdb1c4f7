"""Queries that run as streams over the tables' files and read their output back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumveil.catalog import private_queries as private
from sumveil.catalog.registry import query
from sumveil.catalog.sqlviews import DAY, with_views
from sumveil.catalog.window_queries import GRACE, STATUS_SQL, arrived_tokens, committed, committed_windows
from sumveil.functions import encodings as enc
from sumveil.functions.vectors import lanes_to_columns, vector_sum
from sumveil.operators import chain, telescoping as tl
from sumveil.session import scratch_dir
from sumveil.sources import fixtures as fx, records as rec
from sumveil.streaming import keyed, lifecycle as lc, windows as st

W = fx.W
NAMES = ["s", "q", "n"]
_CLOSED = f"ws + {DAY} <= (SELECT max(ts_ms) FROM std) - {GRACE}"


def events_stream(spark, sf):
    raw = st.read_stream(spark, f"{sf}/events.parquet")
    return st.timed(fx.event_columns(raw), GRACE)


def _sums(df):
    return st.producer_sums(df, W, dict(zip(NAMES, enc.var_lanes(F.col("value")))))


@query("T1 T2 T6 S1", with_views(["psums"], f"SELECT * FROM psums WHERE {_CLOSED}"))
def stream_producer_sum(spark, sf):
    return st.run_to_table(st.with_start(_sums(events_stream(spark, sf))), "producer-sum")


@query("T7 T2", with_views(["psums"], f"""
    SELECT universe_id, ws, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q, sum(n)::BIGINT AS n, count(*) AS producers
    FROM psums WHERE {_CLOSED} GROUP BY universe_id, ws"""))
def stream_universe_sum(spark, sf):
    return st.run_to_table(st.with_start(st.population_sums(_sums(events_stream(spark, sf)), W, NAMES)), "universe-sum")


@query("J1 T1", with_views(["psums", "commits"], f"""
    SELECT universe_id, producer_id, ws, s, q, n FROM psums SEMI JOIN commits USING (universe_id, producer_id, ws) WHERE {_CLOSED}"""))
def stream_commit_join(spark, sf):
    """Producer sums joined with a stream of commits."""
    folder = scratch_dir(spark, "commits")
    fx.commits(fx.std(spark, sf)).write.parquet(folder)
    joined = st.commit_join(_sums(events_stream(spark, sf)), st.read_stream(spark, folder), W, GRACE)
    return st.run_to_table(st.with_start(joined), "commit-join")


@query("S3 S9 F2 J2", with_views(["psums", "committed"], """
    SELECT kind, count(*) AS n, sum(v)::BIGINT AS v FROM (
        SELECT 'transformation' AS kind, s AS v FROM psums SEMI JOIN committed USING (universe_id, producer_id, ws)
        UNION ALL SELECT 'commit', 1 FROM committed
        UNION ALL SELECT 'status', producer_id % 5 FROM committed WHERE producer_id % 5 > 0
        UNION ALL SELECT 'bad', 0 FROM committed WHERE producer_id % 5 = 0) GROUP BY kind"""))
def src_tokens(spark, sf):
    """Tagged token records, one variant each, written and read as a stream; malformed ones are set apart.

    A token of a producer without a commit is ignored.
    """
    windows, present = committed_windows(fx.std(spark, sf))
    key = ["universe_id", "producer_id", "ws"]
    vector = F.array("s", "q", "n")
    status = F.when(F.col("producer_id") % 5 > 0, F.col("producer_id") % 5)
    sent = windows.select(*key, *rec.token_record("transformation", vector))
    sent = sent.unionByName(present.select(*key, *rec.token_record("commit", F.struct(F.col("ws").alias("start"), (F.col("ws") + 1).alias("end")))))
    sent = sent.unionByName(present.select(*key, *rec.token_record("status", status)))
    folder = scratch_dir(spark, "token-records")
    sent.write.parquet(folder)
    back = st.run_to_table(st.read_stream(spark, folder).select("universe_id", "producer_id", "ws", "kind", *rec.TOKEN_KINDS), "tokens-read")
    good, bad = rec.well_formed(back)
    good = good.join(present.select(*key), key, "left_semi")
    value = F.coalesce(F.get("transformation", F.lit(0)), F.col("commit.end") - F.col("commit.start"), F.col("status").cast("bigint"))
    rows = good.select("kind", value.alias("v")).unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(0).cast("bigint").alias("v")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def _status_stream(spark, sf):
    events = fx.event_columns(st.read_stream(spark, f"{sf}/events.parquet"))
    present = scratch_dir(spark, "committed")
    committed(spark, sf).write.parquet(present)
    tokens = scratch_dir(spark, "tokens")
    arrived_tokens(spark, sf).select("universe_id", "producer_id", "ws").join(
        spark.read.parquet(present), ["universe_id", "producer_id", "ws"], "left_semi"
    ).write.parquet(tokens)
    at = lambda path: st.read_stream(spark, path).withColumn("ts_ms", F.col("ws"))
    rows = lc.facts(events, "value", W, GRACE)
    rows = rows.unionByName(lc.facts(at(present), "commit", W, GRACE)).unionByName(lc.facts(at(tokens), "token", W, GRACE))
    return lc.lifecycle(lc.clock(events, W), rows, W, GRACE)


@query("T4 T6 T10", with_views(["stdw", "committed", "commits"], f"""
    SELECT universe_id, ws, status, commits, tokens FROM ({STATUS_SQL})"""))
def stream_window_status(spark, sf):
    """The state each window has reached after the stream's last record."""
    rows = st.run_to_table(_status_stream(spark, sf), "window-status", provider=st.ROCKSDB)
    last = rows.groupBy("universe_id", "ws").agg(F.max(F.struct("status", "commits", "tokens")).alias("m"))
    return last.select("universe_id", "ws", "m.status", "m.commits", "m.tokens")


#: Retention of stream joins and accumulators: longer than any token may take.
RETENTION = 400 * DAY


def _append(df, folder):
    df.write.mode("append").parquet(folder)


def _middle(df, ts):
    """The middle of the timeline, where a stream is stopped and started again."""
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    return (low + high) // 2


@query("T9 T1 T6", with_views(["psums"], f"SELECT * FROM psums WHERE {_CLOSED}"))
def stream_restart(spark, sf):
    """Producer sums of a stream that stops half-way and goes on from its checkpoint, with its open windows."""
    events = fx.std(spark, sf)
    middle = _middle(events, "ts_ms")
    folder, source = scratch_dir(spark, "restart"), scratch_dir(spark, "restart-source")
    run = lambda: st.run_to_table(st.with_start(_sums(st.timed(st.read_stream(spark, source), GRACE))), "restart", folder=folder)
    _append(events.filter(F.col("ts_ms") <= middle), source)
    run()
    _append(events.filter(F.col("ts_ms") > middle), source)
    return run()


@query("A4 A5 J2 T9", with_views(["csum"], f"SELECT universe_id, ws, s, q, n, producers FROM csum WHERE {private.MISSING}"))
def stream_release(spark, sf):
    """The release as a stream: half of the tokens come after a restart, some twice, one never."""
    ciphers, wkeys, present, _ = private._ciphers(fx.std(spark, sf))
    sent = private._sent_tokens(wkeys, present)
    early = F.col("producer_id") % 2 == 0
    folders = {k: scratch_dir(spark, f"release-{k}") for k in ("ciphers", "tokens", "expected")}
    _append(ciphers, folders["ciphers"])
    _append(present.groupBy("universe_id", "ws").agg(F.count("*").alias("producers")), folders["expected"])
    _append(sent.filter(early), folders["tokens"])
    state = scratch_dir(spark, "release")

    def run():
        out = keyed.release_stream(*[st.read_stream(spark, folders[k]) for k in ("ciphers", "tokens", "expected")], private.L, RETENTION)
        return st.run_to_table(out, "release", folder=state)

    run()
    _append(sent.filter(~early), folders["tokens"])
    return lanes_to_columns(run(), "v", private.LANES)


@query("W5 W6 T8 K2 K3", with_views(["psums"], f"SELECT universe_id, producer_id, ws, s, q, n FROM psums WHERE {_CLOSED}"))
def stream_encrypt(spark, sf):
    """Events encrypted as a stream over a restart; sums of whole windows decrypt with the two outer keys."""
    events = fx.std(spark, sf)
    keys = fx.stream_keys(events)
    middle = _middle(events, "ts_ms")
    source, folder = scratch_dir(spark, "encrypt-source"), scratch_dir(spark, "encrypt")

    def run():
        rows = keyed.chained(st.timed(st.read_stream(spark, source), GRACE), private._vector(), private.L, W)
        return st.run_to_table(tl.encrypt_chained(rows, keys, private.L), "encrypt", folder=folder)

    _append(events.filter(F.col("ts_ms") <= middle), source)
    run()
    _append(events.filter(F.col("ts_ms") > middle), source)
    span = [F.min("prev_ts").alias("start"), F.max("ts_ms").alias("end")]
    sums = vector_sum(run(), private.WINDOW, "c", private.L, extra=span, out="c")
    whole = sums.filter(chain.complete(F.col("start"), F.col("end"), F.col("ws"), W))
    v = tl.decrypt(whole, keys, "c", F.col("ws") - 1, F.col("ws") + W - 1, private.L)
    return lanes_to_columns(v.select(*private.WINDOW, "v"), "v", private.LANES)


@query("J5 U3 T10", with_views(["diffs", "committed"], f"""
    SELECT universe_id, ws, producer_id, diff FROM diffs WHERE ws <= (SELECT max(ws) FROM committed) - {GRACE}"""))
def stream_membership_diff(spark, sf):
    """Membership changes as a stream over a restart; windows within the grace are still open at its end."""
    present = committed(spark, sf)
    middle = _middle(present, "ws")
    source, folder = scratch_dir(spark, "members-source"), scratch_dir(spark, "members")
    run = lambda: st.run_to_table(keyed.membership_changes(st.timed(st.read_stream(spark, source), GRACE, "ws"), W), "members", folder=folder)
    _append(present.filter(F.col("ws") <= middle), source)
    run()
    _append(present.filter(F.col("ws") > middle), source)
    return run()

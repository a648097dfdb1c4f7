"""Queries on windows, chains, population sums, joins with commits and membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumveil.catalog.registry import query
from sumveil.catalog.sqlviews import DAY, with_views, ws
from sumveil.functions import encodings as enc
from sumveil.functions import timewin as tw
from sumveil.operators import aggregate as ag
from sumveil.operators import chain, commits as cm, history as hs, membership as mb
from sumveil.session import materialize
from sumveil.sources import fixtures as fx

W = fx.W
UW = ["universe_id", "ws"]
HOUR = tw.HOUR_MS
GRACE = HOUR
DEADLINE = 6000
ROUNDS = 8
#: The five universes of ``std5`` stand for the regions' ones in the table of universes.
_REGION = 99


def _measures():
    return dict(zip(["s", "q", "n"], enc.var_lanes(F.col("value"))))


def _producer_sums(spark, sf):
    return ag.producer_sums(fx.std(spark, sf), W, _measures())


def _spans(spark, sf):
    return chain.window_spans(fx.std(spark, sf), W)


def complete(spark, sf):
    return chain.complete_windows(_spans(spark, sf), W)


def timely(spark, sf):
    return cm.in_time(fx.commits(fx.std(spark, sf)), W, DEADLINE)


def committed_windows(events, size_ms=W):
    """Written tables of one pass over the events: producer windows with sums, and the committed ones."""
    windows = materialize(chain.window_spans(events, size_ms, measures=_measures()), "producer-windows")
    in_time = cm.in_time(fx.commits(windows, size_ms), size_ms, DEADLINE)
    return windows, materialize(cm.committed(chain.complete_windows(windows, size_ms), in_time), "committed")


def committed(spark, sf):
    return committed_windows(fx.std(spark, sf))[1]


def diffs(spark, sf):
    return mb.membership_diff(committed(spark, sf), W)


# ------------------------------------------------------------------ aggregates


@query("A1", with_views(["psums"], "SELECT * FROM psums"))
def producer_window_sum(spark, sf):
    return _producer_sums(spark, sf)


@query("A2 S13 A5", with_views(["psums"], """
    SELECT universe_id, ws, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q, sum(n)::BIGINT AS n, count(*) AS producers
    FROM psums GROUP BY universe_id, ws"""))
def plain_universe_any(spark, sf):
    """Population sums of every window, whoever took part."""
    return ag.population_sums(_producer_sums(spark, sf), ["s", "q", "n"])


@query("A2", with_views(["psums", "stduniverses"], """
    SELECT universe_id, ws, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q, sum(n)::BIGINT AS n, count(*) AS producers
    FROM psums JOIN stduniverses USING (universe_id) GROUP BY universe_id, ws, full_size HAVING count(*) >= full_size"""))
def plain_universe_full(spark, sf):
    """Population sums only of windows to which enough producers of the universe contributed."""
    return ag.population_sums(_producer_sums(spark, sf), ["s", "q", "n"], fx.std_universes(spark, sf))


@query("A3 J1", with_views(["csum"], "SELECT universe_id, ws, s, q, n, producers FROM csum"))
def committed_sum(spark, sf):
    windows, present = committed_windows(fx.std(spark, sf))
    return ag.population_sums(cm.commit_join(windows, present), ["s", "q", "n"])


@query("A7 W1", with_views(["timely"], """
    SELECT producer_id % 3 AS run, commit_ts - commit_ts % 1000 AS ws, count(*) AS n FROM timely GROUP BY ALL"""))
def tokens_per_window(spark, sf):
    return ag.throughput(timely(spark, sf).withColumn("run", tw.floor_mod(F.col("producer_id"), 3)), "run", "commit_ts")


@query("A9", with_views(["diffs"], """
    SELECT universe_id, ws, sum(sum(diff)) OVER (PARTITION BY universe_id ORDER BY ws)::BIGINT AS members
    FROM diffs GROUP BY universe_id, ws"""))
def universe_size(spark, sf):
    return mb.universe_size(diffs(spark, sf))


@query("A10", with_views(["std"], """
    SELECT ('0x' || md5(producer_id::VARCHAR)[1:12])::BIGINT % 8 AS bucket, count(*) AS members
    FROM (SELECT DISTINCT producer_id FROM std) GROUP BY ALL"""))
def bucket_balance(spark, sf):
    hashed = F.conv(F.substr(F.md5(F.col("producer_id").cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("bigint")
    return ag.bucket_balance(fx.std(spark, sf), "producer_id", 8, hashed)


@query("A11", with_views(["stdw"], "SELECT universe_id, ws, members, sha256(concat_ws(',', " + ", ".join(f"c{i}" for i in range(8)) + """)) AS fingerprint
    FROM (SELECT universe_id, ws, count(*) AS members, """ + ", ".join(
        f"sum(('0x' || d[{8 * i + 1}:{8 * i + 8}])::BIGINT)::BIGINT AS c{i}" for i in range(8)) + """
          FROM (SELECT DISTINCT universe_id, ws, producer_id, sha256(producer_id::VARCHAR) AS d FROM stdw) GROUP BY ALL)"""))
def member_fingerprint(spark, sf):
    df = chain.with_window(fx.std(spark, sf), W)
    return ag.member_fingerprint(df, UW, "producer_id")


# --------------------------------------------------------------- windows, time


@query("W1", with_views(["std"], f"SELECT producer_id, ts_ms, {ws('ts_ms', HOUR)} AS ws, {ws('-ts_ms', HOUR)} AS negative_ws FROM std"))
def window_start(spark, sf):
    t = F.col("ts_ms")
    return fx.std(spark, sf).select(
        "producer_id", "ts_ms", tw.window_start(t, HOUR).alias("ws"), tw.window_start(-t, HOUR).alias("negative_ws")
    )


@query("W2 T10", with_views(["std"], f"""
    SELECT epoch, (ws - epoch) // {HOUR} AS t, count(*) AS n
    FROM (SELECT {ws('ts_ms', HOUR)} AS ws, {ws('ts_ms', HOUR * 256)} AS epoch FROM std) GROUP BY ALL"""))
def epoch_round(spark, sf):
    w = tw.window_start(F.col("ts_ms"), HOUR)
    return fx.std(spark, sf).groupBy(
        tw.epoch_start(w, HOUR, 256).alias("epoch"), tw.round_index(w, HOUR, 256).alias("t")
    ).agg(F.count("*").alias("n"))


@query("W3", with_views(["std"], f"""
    SELECT ws, ws - ws % {DAY} AS day, (ws % {DAY}) // {3 * HOUR} + 1 AS ordinal,
           'W[' || strftime(make_timestamp(ws * 1000), '%H:%M:%S') || ', ' || strftime(make_timestamp((ws + {3 * HOUR}) * 1000), '%H:%M:%S') || ')' AS label,
           count(*) AS n
    FROM (SELECT {ws('ts_ms', 3 * HOUR)} AS ws FROM std) GROUP BY ws"""))
def window_labels(spark, sf):
    size = 3 * HOUR
    totals = fx.std(spark, sf).groupBy(tw.window_start(F.col("ts_ms"), size).alias("ws")).agg(F.count("*").alias("n"))
    w = F.col("ws")
    return totals.select(
        "ws", tw.window_start(w, tw.DAY_MS).alias("day"), tw.window_ordinal(w, size).alias("ordinal"),
        tw.range_label(w, w + size).alias("label"), "n",
    )


MINUTE = 60_000


@query("W4", with_views(["std5"], f"""
    WITH t AS (SELECT universe_id, {ws('ts_ms', 10 * MINUTE)} AS ws, count(*) AS n, sum(value)::BIGINT AS s FROM std5 GROUP BY ALL),
         a AS (SELECT universe_id, unnest(range(min(ws), max(ws) + 1, {10 * MINUTE})) AS ws FROM t GROUP BY universe_id)
    SELECT universe_id, ws, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM a LEFT JOIN t USING (universe_id, ws)""").replace(
        "\n    WITH t AS", ", t AS", 1))
def window_gapfill(spark, sf):
    size = 10 * MINUTE
    totals = fx.std5(spark, sf).groupBy("universe_id", tw.window_start(F.col("ts_ms"), size).alias("ws")).agg(
        F.count("*").alias("n"), F.sum("value").alias("s")
    )
    return ag.fill_windows(totals, size, ["n", "s"])


_PREV = "coalesce(lag(ts_ms) OVER (PARTITION BY universe_id, producer_id, ws ORDER BY ts_ms), ws - 1)"


@query("W5", with_views(["stdw"], f"SELECT producer_id, ws, ts_ms, {_PREV} AS prev_ts FROM stdw"))
def prev_ts(spark, sf):
    return chain.with_previous(fx.std(spark, sf), W).select("producer_id", "ws", "ts_ms", "prev_ts")


@query("W6", with_views(["spans"], f"""
    SELECT producer_id, ws, ws + {DAY} - 1 AS ts_ms, max_ts AS prev_ts FROM spans WHERE moved_on AND max_ts <> ws + {DAY} - 1"""))
def boundary_rows(spark, sf):
    return chain.boundary_rows(_spans(spark, sf), W).drop("universe_id")


@query("T8 F1", with_views(["std"], f"""
    SELECT ws, sum(v)::BIGINT AS n_values, count(*) FILTER (v > 0 AND max_ts <> ws + {HOUR * 6} - 1 AND ws < last_ws) AS n_boundary,
           count(*) FILTER (v = 0) AS only_heartbeats
    FROM (SELECT producer_id, ws, count(*) FILTER (event_type <> 'signup') AS v, max(ts_ms) FILTER (event_type <> 'signup') AS max_ts,
                 max(ws) OVER (PARTITION BY producer_id) AS last_ws
          FROM (SELECT *, {ws('ts_ms', HOUR * 6)} AS ws FROM std) GROUP BY producer_id, ws) GROUP BY ws"""))
def heartbeat_rows(spark, sf):
    """Heartbeats carry no value; they only show that a producer has moved on."""
    size = 6 * HOUR
    df = fx.std_events(spark, sf).withColumn("value", F.when(F.col("event_type") != "signup", F.col("value")))
    spans = chain.window_spans(df, size, value="value")
    edge = chain.boundary_rows(spans, size).groupBy("ws").agg(F.count("*").alias("n_boundary"))
    totals = spans.groupBy("ws").agg(
        F.sum("n_values").alias("n_values"), F.count(F.when(F.col("n_values") == 0, 1)).alias("only_heartbeats")
    )
    return totals.join(edge, "ws", "left").na.fill(0, subset=["n_boundary"])


@query("F3", with_views(["complete"], "SELECT * FROM complete"))
def complete_windows(spark, sf):
    """From the records themselves: the covered interval of events and boundary records."""
    events = chain.with_previous(fx.std(spark, sf), W).select("universe_id", "producer_id", "ws", "ts_ms", "prev_ts")
    edge = chain.boundary_rows(_spans(spark, sf), W)
    spans = events.unionByName(edge).groupBy("universe_id", "producer_id", "ws").agg(
        F.min("prev_ts").alias("start"), F.max("ts_ms").alias("end")
    )
    return spans.filter(chain.complete(F.col("start"), F.col("end"), F.col("ws"), W)).drop("start", "end")


@query("F4", with_views(["arrivals"], """
    SELECT producer_id, seq, ts_ms, coalesce(ts_ms > max(ts_ms) OVER (PARTITION BY producer_id ORDER BY seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM arrivals"""))
def order_guard(spark, sf):
    df = fx.arrivals(spark, sf).drop("partition")
    return chain.order_guard(df, ["producer_id"], "seq", "ts_ms")


LATE_W, LATE_G = 30 * DAY, 1000 * DAY


@query("T3", with_views(["arrivals"], f"""
    SELECT partition, seq, ts_ms, coalesce({ws('ts_ms', LATE_W)} + {LATE_W + LATE_G} <= max(ts_ms) OVER (PARTITION BY partition
           ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM arrivals"""))
def late_split(spark, sf):
    df = fx.arrivals(spark, sf).drop("producer_id")
    return chain.late_split(df, ["partition"], "seq", "ts_ms", LATE_W, LATE_G)


@query("F5", with_views(["psums"], f"SELECT * FROM psums WHERE ws + {DAY} >= 1705276800000"))
def boundary_filter(spark, sf):
    """Windows that end before a boundary are skipped."""
    return _producer_sums(spark, sf).filter(F.col("ws") + W >= 1705276800000)


# ---------------------------------------------------------------------- joins


@query("J1", with_views(["psums", "commits"], """
    SELECT universe_id, producer_id, ws, s, q, n FROM psums SEMI JOIN commits USING (universe_id, producer_id, ws)"""))
def commit_join(spark, sf):
    return cm.commit_join(_producer_sums(spark, sf), fx.commits(fx.std(spark, sf)))


def arrived_tokens(spark, sf):
    """One token per commit; producer 3 misses the tenth window, producer 4 sends twice."""
    tenth = 1704844800000
    t = fx.commits(fx.std(spark, sf)).filter(~((F.col("producer_id") == 3) & (F.col("ws") == tenth)))
    twice = t.filter(F.col("producer_id") == 4)
    return t.unionByName(twice).select("universe_id", "producer_id", "ws", (F.col("producer_id") * 7 + tw.floor_mod(F.col("ws"), 1000)).alias("v"))


_TOKENS = "SELECT universe_id, producer_id, ws, producer_id * 7 + ws % 1000 AS v FROM commits WHERE NOT (producer_id = 3 AND ws = 1704844800000)"


@query("J2 S3 S9", with_views(["commits", "committed"], f"""
    SELECT * FROM ({_TOKENS}) SEMI JOIN committed USING (universe_id, producer_id, ws)"""))
def token_semi(spark, sf):
    return cm.token_semi(arrived_tokens(spark, sf), committed(spark, sf))


@query("F2", with_views(["commits"], """
    SELECT valid, count(*) AS n FROM (
        SELECT (CASE WHEN producer_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN producer_id % 4 = 0 THEN 1 ELSE 0 END
                + CASE WHEN producer_id % 5 = 0 THEN 1 ELSE 0 END) = 1 AS valid FROM commits) GROUP BY valid"""))
def token_valid(spark, sf):
    p = F.col("producer_id")
    variants = [F.when(p % m == 0, F.col("commit_ts")) for m in (3, 4, 5)]
    return fx.commits(fx.std(spark, sf)).groupBy(cm.valid_token(variants).alias("valid")).agg(F.count("*").alias("n"))


@query("J3", with_views(["psums", "commits"], """
    SELECT universe_id, producer_id, ws FROM psums ANTI JOIN commits USING (universe_id, producer_id, ws)"""))
def uncommitted(spark, sf):
    return cm.uncommitted(_producer_sums(spark, sf), fx.commits(fx.std(spark, sf))).select("universe_id", "producer_id", "ws")


@query("J4", with_views(["commits", "complete"], """
    SELECT universe_id, producer_id, ws FROM commits ANTI JOIN complete USING (universe_id, producer_id, ws)"""))
def incomplete_commits(spark, sf):
    return cm.incomplete_commits(fx.commits(fx.std(spark, sf)), complete(spark, sf)).drop("commit_ts")


@query("J5", with_views(["diffs"], "SELECT * FROM diffs"))
def membership_diff(spark, sf):
    return diffs(spark, sf)


@query("J9", with_views(["std5", "universes"], f"""
    SELECT u.universe_id, u.min_size, {W}::BIGINT AS window_ms, {ws('ts_ms')} AS ws, sum(value)::BIGINT AS s, count(*) AS n
    FROM std5 s JOIN universes u ON u.universe_id = s.universe_id + {_REGION} GROUP BY ALL"""))
def universe_lookup(spark, sf):
    """Configuration of each record's universe: summed first, then joined with the table of universes."""
    regional = fx.std5(spark, sf).withColumn("universe_id", F.col("universe_id") + _REGION)
    sums = regional.groupBy("universe_id", tw.window_start(F.col("ts_ms"), W).alias("ws")).agg(
        F.sum("value").alias("s"), F.count("*").alias("n")
    )
    config = fx.universes(spark, sf).select("universe_id", "min_size", "window_ms")
    return sums.join(config, "universe_id")


# ----------------------------------------------------------------- membership


@query("F6", with_views(["diffs"], """
    SELECT universe_id, ws, CASE diff WHEN 1 THEN 'added' ELSE 'dropped' END AS change, producer_id FROM diffs"""))
def diff_lists(spark, sf):
    """Added and dropped members, one row each."""
    d = diffs(spark, sf)
    change = F.when(F.col("diff") == mb.ADD, "added").when(F.col("diff") == mb.DROP, "dropped")
    return d.select("universe_id", "ws", change.alias("change"), "producer_id")


@query("A6 U1", with_views(["diffs"], "SELECT universe_id, ws, producer_id, diff FROM diffs"))
def diff_map(spark, sf):
    """Diffs found by separate tasks, each over its own producers, merged into one set."""
    c = committed(spark, sf)
    last = c.agg(F.max("ws")).scalar()
    task = lambda i: mb.membership_diff(c.filter(tw.floor_mod(F.col("producer_id"), 2) == i), W, last)
    return mb.merge_diffs(task(0).unionByName(task(1)))


@query("U1", with_views(["complete", "commits"], """
    SELECT 'complete' AS kind, universe_id, ws, count(*) AS n FROM complete GROUP BY ALL
    UNION ALL SELECT 'commit', universe_id, ws, count(*) FROM commits GROUP BY ALL"""))
def update_union(spark, sf):
    a = complete(spark, sf).withColumn("kind", F.lit("complete"))
    b = fx.commits(fx.std(spark, sf)).drop("commit_ts").withColumn("kind", F.lit("commit"))
    return a.unionByName(b).groupBy("kind", "universe_id", "ws").agg(F.count("*").alias("n"))


@query("U2", with_views(["committed"], "SELECT universe_id, producer_id FROM committed WHERE ws = 1705276800000"))
def members_at_window(spark, sf):
    d = diffs(spark, sf)
    nobody = d.filter("false").select("universe_id", "producer_id")
    return mb.apply_diffs(nobody, d, 1705276800000)


_EPOCH = ws("ws", DAY * ROUNDS)


@query("U3 T10", with_views(["committed"], f"""
    SELECT universe_id, epoch, ws, base, ever - base AS new_members, ever - present AS dropped, present FROM (
        SELECT w.universe_id, w.epoch, w.ws, w.present, count(*) FILTER (f.first_ws = w.epoch_ws) AS base, count(*) AS ever
        FROM (SELECT universe_id, {_EPOCH} AS epoch, ws, count(*) AS present,
                     min(ws) OVER (PARTITION BY universe_id, {_EPOCH}) AS epoch_ws FROM committed GROUP BY universe_id, ws) w
        JOIN (SELECT universe_id, {_EPOCH} AS epoch, producer_id, min(ws) AS first_ws FROM committed GROUP BY ALL) f
          ON f.universe_id = w.universe_id AND f.epoch = w.epoch AND f.first_ws <= w.ws
        GROUP BY ALL)"""))
def epoch_cumulative(spark, sf):
    return mb.epoch_cumulative(committed(spark, sf), W, ROUNDS)


# ------------------------------------------------------------ history, status


@query("O2 O1", with_views(["csum"], """
    SELECT universe_id, ws, s, n FROM csum QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY ws DESC) <= 7"""))
def last_n_windows(spark, sf):
    return hs.last_n_windows(committed_sum(spark, sf).select("universe_id", "ws", "s", "n"), 7)


@query("O3", with_views(["stdw"], f"""
    SELECT DISTINCT universe_id, ws FROM stdw WHERE ws + {DAY + GRACE} <= (SELECT max(ts_ms) FROM stdw)"""))
def expired_windows(spark, sf):
    df = chain.with_window(fx.std(spark, sf), W)
    time = df.groupBy("universe_id").agg(F.max("ts_ms").alias("stream_time"))
    return hs.expired_windows(df.select("universe_id", "ws").distinct(), time, W, GRACE)


@query("O5", with_views(["runs"], """
    SELECT run, kind, ws, latency_ms, n FROM runs QUALIFY row_number() OVER (PARTITION BY run, kind ORDER BY ws DESC) = 1"""))
def dedup_last(spark, sf):
    return hs.dedup_last(fx.runs(spark, sf), ["run", "kind"], ["ws"])


@query("F7", with_views(["runs"], """
    SELECT run, kind, ws, latency_ms, n FROM (
        SELECT *, count(*) OVER (PARTITION BY run, kind) AS kept FROM (
            SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run, kind ORDER BY ws) > 2
                               AND row_number() OVER (PARTITION BY run, kind ORDER BY ws DESC) > 2))
    WHERE kept >= 8"""))
def trim_runs(spark, sf):
    return hs.trim_runs(fx.runs(spark, sf), ["run", "kind"])


@query("F8", with_views(["runs"], f"""
    SELECT run, kind, ws, latency_ms, n FROM runs QUALIFY ws <= min(ws) OVER (PARTITION BY run, kind) + {10 * DAY}"""))
def run_cutoff(spark, sf):
    return hs.run_cutoff(fx.runs(spark, sf), ["run", "kind"], 10 * DAY)


def _stats(spark, sf):
    c = committed_sum(spark, sf)
    s, q, n = F.col("s"), F.col("q"), F.col("n")
    return c.select("universe_id", "ws", enc.decode_avg(s, n).alias("mean"), enc.decode_stddev(s, q, n).alias("stddev"))


@query("W7", with_views(["csum"], """
    SELECT universe_id, ws, round(mean, 6) AS mean, round(previous, 6) AS previous, round(mean - previous, 6) AS change
    FROM (SELECT universe_id, ws, s::DOUBLE / n AS mean, lag(s::DOUBLE / n) OVER (PARTITION BY universe_id ORDER BY ws) AS previous FROM csum)"""))
def result_delta(spark, sf):
    d = hs.result_delta(_stats(spark, sf), "mean")
    return d.select("universe_id", "ws", *[F.round(c, 6).alias(c) for c in ("mean", "previous", "change")])


@query("W8", with_views(["csum"], """
    SELECT universe_id, ws, round(m - d / 2, 4) AS low, round(m + d / 2, 4) AS high
    FROM (SELECT universe_id, ws, s::DOUBLE / n AS m, sqrt(greatest(q::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n), 0)) AS d FROM csum)"""))
def result_band(spark, sf):
    low, high = hs.band(F.col("mean"), F.col("stddev"))
    return _stats(spark, sf).select("universe_id", "ws", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


STATUS_SQL = f"""
    SELECT t.universe_id, t.ws,
           (CASE WHEN st < t.ws + {DAY} THEN 1
                 WHEN st < t.ws + {DAY + GRACE} AND NOT (coalesce(c, 0) > 0 AND coalesce(c, 0) = coalesce(e, 0)) THEN 2
                 WHEN st < t.ws + {DAY + GRACE} THEN 3
                 WHEN coalesce(c, 0) > 0 AND coalesce(c, 0) = coalesce(k, 0) THEN 5 ELSE 4 END)::BIGINT AS status,
           coalesce(c, 0) AS commits, coalesce(k, 0) AS tokens
    FROM (SELECT universe_id, unnest(range(min(ws), max(ws) + 1, {DAY})) AS ws, max(ts_ms) AS st FROM stdw GROUP BY universe_id) t
    LEFT JOIN (SELECT universe_id, ws, count(*) AS c FROM committed GROUP BY ALL) USING (universe_id, ws)
    LEFT JOIN (SELECT universe_id, ws, count(*) AS k FROM ({_TOKENS}) SEMI JOIN committed USING (universe_id, producer_id, ws) GROUP BY ALL) USING (universe_id, ws)
    LEFT JOIN (SELECT universe_id, ws, count(DISTINCT producer_id) AS e FROM stdw GROUP BY ALL) USING (universe_id, ws)"""


def _status(spark, sf):
    events = chain.with_window(fx.std(spark, sf), W)
    totals = ag.fill_windows(events.groupBy(*UW).agg(F.count("*").alias("n")), W, ["n"])
    c = committed(spark, sf)
    tokens = cm.token_semi(arrived_tokens(spark, sf), c)
    expected = events.select("universe_id", "producer_id", "ws").distinct()
    time = events.groupBy("universe_id").agg(F.max("ts_ms").alias("stream_time"))
    return hs.window_status(totals, c, tokens, expected, time, W, GRACE)


@query("T4 T5", with_views(["stdw", "committed", "commits"], STATUS_SQL))
def window_status(spark, sf):
    return _status(spark, sf)


@query("W9", with_views(["stdw", "committed", "commits"], f"""
    SELECT universe_id, ws, status FROM ({STATUS_SQL})
    UNION ALL SELECT universe_id, ws, 0 FROM ({STATUS_SQL}) QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY ws) > 1"""))
def status_timeline(spark, sf):
    return hs.status_timeline(_status(spark, sf))


@query("T5", with_views(["commits"], f"""
    SELECT ws, count(*) AS commits, count(*) FILTER (commit_ts <= ws + {DAY} + 6000) AS in_time,
           least(max(commit_ts) - ws - {DAY}, 6000) AS closed_after_ms
    FROM commits GROUP BY ws"""))
def commit_deadline(spark, sf):
    """Commits inside the deadline, and when the window's commit phase ended."""
    c = fx.commits(fx.std(spark, sf))
    on_time = F.col("commit_ts") <= F.col("ws") + W + DEADLINE
    return c.groupBy("ws").agg(
        F.count("*").alias("commits"), F.count(F.when(on_time, 1)).alias("in_time"),
        F.least(F.max("commit_ts") - F.col("ws") - W, F.lit(DEADLINE)).alias("closed_after_ms"),
    )

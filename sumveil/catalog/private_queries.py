"""Queries on telescoping keys, masks and release."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumveil.catalog.registry import query
from sumveil.catalog.sqlviews import DAY, with_views
from sumveil.catalog.window_queries import committed as committed_std, committed_windows
from sumveil.functions import encodings as enc
from sumveil.functions.prf import prf_lanes
from sumveil.functions.vectors import combine, lanes_to_columns, vector_sum, zeros
from sumveil.operators import chain, commits as cm, masks as mk, membership as mb, release as rl, telescoping as tl
from sumveil.plans import parameters as pm
from sumveil.session import materialize, scratch_dir
from sumveil.sources import fixtures as fx

W = fx.W
L = 3
LANES = ["s", "q", "n"]
WINDOW = ["universe_id", "producer_id", "ws"]
GW = fx.GRAPH_W


def _vector():
    return F.array(*enc.var_lanes(F.col("value")))


def _committed_sums(events, size_ms=W):
    """Vector sums of the committed (producer, window) pairs, the pairs, and all producers."""
    windows, present = committed_windows(events, size_ms)
    sums = cm.commit_join(windows, present.hint("merge")).select(*WINDOW, F.array(*LANES).alias("x"))
    return sums, present, windows


def _ciphers(events, size_ms=W):
    """Encrypted vectors, window keys, the committed (producer, window) pairs, all producers."""
    sums, present, windows = _committed_sums(events, size_ms)
    wkeys = tl.window_keys(present, fx.stream_keys(windows), L, size_ms)
    return tl.mask_window_sums(sums, wkeys, "x", L), wkeys, present, windows


def _released(df):
    return lanes_to_columns(df.select("universe_id", "ws", "v", "producers"), "v", LANES)


@query("K1", with_views(["committed"], f"SELECT producer_id, ws, {L}::BIGINT AS distinct_lanes, true AS undone, true AS differs FROM committed"))
def prf_column(spark, sf):
    """Lane keys of every producer at every window start: lanes differ, and F(end) - F(start) undoes itself."""
    df = committed_std(spark, sf).join(fx.stream_keys(fx.std(spark, sf)), "producer_id")
    start, end = (prf_lanes(F.col("key"), F.col("ws") + d, L) for d in (0, W))
    df = df.select("producer_id", "ws", start.alias("f"), end.alias("g"))
    back = combine(L, [combine(L, [F.col("g")], [F.col("f")]), F.col("f")], [F.col("g")])
    return df.select(
        "producer_id", "ws", F.size(F.array_distinct("f")).cast("bigint").alias("distinct_lanes"),
        (back == zeros(L)).alias("undone"), (F.col("f") != F.col("g")).alias("differs"),
    )


@query("K2 K3 S2", with_views(["stdw"], "SELECT producer_id, ts_ms, value AS s, value * value AS q, 1::BIGINT AS n FROM stdw"))
def enc_then_dec_rows(spark, sf):
    """Encrypt every event, decrypt it again with its own key interval."""
    events, keys = fx.std(spark, sf), fx.stream_keys(fx.std(spark, sf))
    c = tl.encrypt_stream(events.select("universe_id", "producer_id", "ts_ms", "value"), keys, _vector(), L, W)
    v = tl.decrypt(c, keys, "c", F.col("prev_ts"), F.col("ts_ms"), L)
    return lanes_to_columns(v.select("producer_id", "ts_ms", "v"), "v", LANES)


@query("K2 K3 A1 F3 T1", with_views(["psums", "complete"], """
    SELECT universe_id, producer_id, ws, s, q, n FROM psums SEMI JOIN complete USING (universe_id, producer_id, ws)"""))
def heac_window_sum(spark, sf):
    """Window sums of encrypted events, decrypted with the two outer keys where the chain is whole."""
    keys = fx.stream_keys(fx.std(spark, sf))
    sums = tl.cipher_window_sums(fx.std(spark, sf), keys, _vector(), L, W)
    whole = sums.filter(chain.complete(F.col("start"), F.col("end"), F.col("ws"), W))
    v = tl.decrypt(whole, keys, "c", F.col("ws") - 1, F.col("ws") + W - 1, L)
    return lanes_to_columns(v.select(*WINDOW, "v"), "v", LANES)


MISSING = f"NOT (ws = 1704844800000)"


def _sent_tokens(wkeys, present):
    """Tokens of committed producers: one window lacks a token, some producers send twice."""
    tokens = rl.plain_tokens(wkeys, L)
    first = present.filter(F.col("ws") == 1704844800000).agg(F.min("producer_id")).scalar()
    sent = tokens.filter(~((F.col("ws") == 1704844800000) & (F.col("producer_id") == first)))
    return sent.unionByName(sent.filter(F.col("producer_id") % 50 == 4))


@query("A4 A5 K10", with_views(["csum"], f"SELECT universe_id, ws, s, q, n, producers FROM csum WHERE {MISSING}"))
def release(spark, sf):
    """All-or-nothing: one window lacks a token and stays shut, one producer sends twice."""
    events = fx.std(spark, sf)
    ciphers, wkeys, present, windows = _ciphers(events)
    sent = _sent_tokens(wkeys, present)
    return _released(rl.release(ciphers, sent, L, expected=present))


_CSUM_ALL = """
    SELECT universe_id, ws, sum(value)::BIGINT AS s, sum(value * value)::BIGINT AS q, count(*) AS n, count(DISTINCT producer_id) AS producers
    FROM {view} SEMI JOIN committed USING (producer_id, ws) GROUP BY ALL"""


def _csum_sql(view: str) -> str:
    body = _CSUM_ALL.format(view=f"(SELECT *, ts_ms - ts_ms % {DAY} AS ws FROM {view})")
    return with_views([view, "committed"], body)


@query("K4 K6 J6 A4", _csum_sql("clique"))
def release_clique(spark, sf):
    """Release with masks between all pairs of a cohort; equals the plain committed sums."""
    events = fx.cohort_std(spark, sf, fx.CLIQUE_SIZE)
    ciphers, wkeys, present, windows = _ciphers(events)
    masks = mk.clique_masks(present, fx.pair_keys(windows, fx.CLIQUE_SIZE), L)
    return _released(rl.release(ciphers, rl.masked_tokens(masks, wkeys, L), L, expected=present))


def graph_parameters_of(windows):
    """k, rounds and members of the graph universes, written once."""
    return materialize(pm.graph_parameters(fx.graph_universes(windows)), "graph-parameters")


@query("K5 K6 K7 K11 T10", with_views(["gcommitted", "gparameters"], """
    SELECT universe_id, ws, k, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q, sum(n)::BIGINT AS n, count(*) AS producers
    FROM gcommitted JOIN gparameters USING (universe_id) GROUP BY ALL"""))
def release_graph(spark, sf):
    """Release with masks over the random graph of each window's round, k and epoch by universe;
    universes too small for a graph use all pairs."""
    ciphers, wkeys, present, windows = _ciphers(fx.graph_events(spark, sf), GW)
    parameters = graph_parameters_of(windows)
    masks = mk.parameter_masks(present, fx.graph_pairs(windows), parameters, L, GW)
    out = _released(rl.release(ciphers, rl.masked_tokens(masks, wkeys, L), L, expected=present))
    return out.join(parameters.select("universe_id", "k"), "universe_id")


def _zero_sql(view: str, edges: str) -> str:
    body = f"SELECT universe_id, ws, 0::BIGINT AS m0, 0::BIGINT AS m1, 0::BIGINT AS m2, count(*) AS members, {edges}, 0::BIGINT AS mismatched FROM (SELECT DISTINCT v.universe_id, c.ws, c.producer_id FROM committed c JOIN {view} v USING (producer_id)) GROUP BY universe_id, ws"
    return with_views([view, "committed"], body)


_CLIQUE_EDGES, _SOME_EDGES = "(count(*) * (count(*) - 1))::BIGINT AS neighbours", "true AS has_edges"
#: Members from which a window without an edge is next to impossible (below 1e-8).
CERTAIN = 12


def _some_edges(totals):
    """Edges depend on keys, so their number is not compared, only that larger windows have some."""
    return totals.withColumn("has_edges", (F.col("members") < CERTAIN) | (F.col("neighbours") > 0)).drop("neighbours")


def _mask_total(masks):
    """Sums of masks; a member has a mask other than zero exactly if it has neighbours."""
    apart = F.sum(F.when((F.col("mask") != zeros(L)) == (F.col("neighbours") > 0), 0).otherwise(1).cast("bigint"))
    extra = [F.count("*").alias("members"), F.sum("neighbours").alias("neighbours"), apart.alias("mismatched")]
    total = vector_sum(masks, ["universe_id", "ws"], "mask", L, extra=extra, out="m")
    return lanes_to_columns(total, "m", ["m0", "m1", "m2"])


@query("K4 J6", _zero_sql("clique", _CLIQUE_EDGES))
def mask_clique_zero(spark, sf):
    """All-pairs masks of a window add up to zero."""
    events = fx.cohort_std(spark, sf, fx.CLIQUE_SIZE)
    _, present, windows = _committed_sums(events)
    return _mask_total(mk.clique_masks(present, fx.pair_keys(windows, fx.CLIQUE_SIZE), L))


@query("K5 J7 K11", with_views(["gcommitted", "gparameters"], f"""
    SELECT universe_id, ws, k, 0::BIGINT AS m0, 0::BIGINT AS m1, 0::BIGINT AS m2, count(*) AS members,
           CASE WHEN k IS NULL THEN count(*) * (count(*) - 1) END AS all_pairs, true AS has_edges, 0::BIGINT AS mismatched
    FROM gcommitted JOIN gparameters USING (universe_id) GROUP BY universe_id, ws, k"""))
def mask_graph_zero(spark, sf):
    """Masks over each universe's graph add up to zero after the dropped producers' edges are
    taken out; a universe without k has an edge for every pair."""
    _, present, windows = _committed_sums(fx.graph_events(spark, sf), GW)
    parameters, pairs = graph_parameters_of(windows), fx.graph_pairs(windows)
    rounds = mk.parameter_rounds(present, parameters, GW)
    members = mk.with_parameters(present, parameters)
    drawn, alone = members.filter("k is not null"), members.filter("k is null")
    seen = mb.first_seen(drawn, GW, F.col("rounds"))
    # A member has edges in the windows from its first one of the epoch on in which it is not dropped.
    known = seen.join(F.broadcast(rounds.select("universe_id", "epoch", "ws")), ["universe_id", "epoch"]).filter(F.col("first_ws") <= F.col("ws"))
    known = mk.exclude_dropped(known.select(WINDOW), mb.dropped_rows(drawn, GW, F.col("rounds")))
    members = mk.with_parameters(known.unionByName(alone.select(WINDOW)), parameters)
    sums = mk.part_masks(members, pairs, L, GW)
    totals = _mask_total(mk.for_all_present(present, sums, L)).join(parameters.select("universe_id", "k"), "universe_id")
    totals = totals.withColumn("all_pairs", F.when(F.col("k").isNull(), F.col("neighbours")))
    return _some_edges(totals)


@query("K9", _zero_sql("clique", _SOME_EDGES))
def mask_sampled_zero(spark, sf):
    """Masks over pairs drawn afresh each window add up to zero."""
    events = fx.cohort_std(spark, sf, fx.CLIQUE_SIZE)
    _, present, windows = _committed_sums(events)
    return _some_edges(_mask_total(mk.sampled_masks(present, fx.pair_keys(windows, fx.CLIQUE_SIZE), L, 1)))


@query("K10", with_views(["psums", "committed"], """
    SELECT universe_id, producer_id, ws, s, q, n FROM psums SEMI JOIN committed USING (universe_id, producer_id, ws)"""))
def release_single(spark, sf):
    """Single-producer release without masks."""
    events = fx.std(spark, sf)
    ciphers, wkeys, _, _ = _ciphers(events)
    return lanes_to_columns(rl.release_single(ciphers, wkeys, L), "v", LANES)


_SEGMENTS = """
    SELECT universe_id, g AS segment, (n * (n - 1) // 2)::BIGINT AS edges
    FROM (SELECT universe_id, k, count(DISTINCT producer_id) AS n FROM {members} JOIN gparameters USING (universe_id) WHERE k IS NOT NULL GROUP BY ALL),
         LATERAL (SELECT unnest(range(0, 128 // k)) AS g)
    WHERE n > 1"""


def _segments(counts):
    """Edges per segment of 2^k rounds, from counts of batches."""
    return counts.groupBy("universe_id", "segment").agg(F.sum("edges").alias("edges"))


@query("K7 K11", with_views(["gevents", "gparameters"], _SEGMENTS.format(members="gevents")))
def graph_degree(spark, sf):
    """Each pair of a universe is an edge exactly once per segment of an epoch."""
    events = fx.graph_events(spark, sf)
    parameters = graph_parameters_of(events)
    epochs = parameters.select("universe_id", "k", F.lit(0).cast("bigint").alias("epoch"))
    return _segments(mk.pair_segments(fx.graph_pair_keys(events), epochs))


@query("K7 K8 K11", with_views(["gcommitted", "gparameters"], _SEGMENTS.format(members="gcommitted")))
def graph_incremental(spark, sf):
    """Members that join within the epoch add only their own pairs; finished epochs are removed from the store."""
    _, present, windows = _committed_sums(fx.graph_events(spark, sf), GW)
    parameters, pairs = graph_parameters_of(windows), fx.graph_pair_keys(windows)
    members = mk.with_parameters(present, parameters).filter("k is not null")
    seen = mb.first_seen(members, GW, F.col("rounds"))
    start = members.groupBy("universe_id").agg(F.min("ws").alias("start_ws"))
    seen = seen.join(start, "universe_id")
    base, new = seen.filter("first_ws = start_ws"), seen.filter("first_ws > start_ws")
    epochs = members.select("universe_id", "k", "rounds").distinct().withColumn("epoch", F.lit(0).cast("bigint"))
    over = epochs.withColumn("epoch", -F.col("rounds") * GW)
    path = scratch_dir(spark, "graph")
    mk.write_graph(mk.pair_rounds(mk.new_pairs(pairs, base.filter("false"), base), epochs.unionByName(over)), path)
    mk.write_graph(mk.pair_rounds(mk.new_pairs(pairs, base, new), epochs), path)
    mk.drop_epochs(spark, path, 0)
    return _segments(mk.stored_segments(mk.stored_graph(spark, path, "array<bigint>"), parameters))

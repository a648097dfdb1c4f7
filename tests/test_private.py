import random

import pytest
from pyspark.sql import functions as F

from sumveil.functions import wide
from sumveil.functions.vectors import vector_sum
from sumveil.operators import chain, masks as mk, release as rl, telescoping as tl
from sumveil.plans import parameters as pm, profiles as pf

W = 2000
WINDOW = ["universe_id", "producer_id", "ws"]
L = 2


def stream_keys(spark, producers):
    return spark.createDataFrame([(p,) for p in producers], "producer_id bigint").withColumn(
        "key", F.unhex(F.sha2(F.col("producer_id").cast("string"), 256))
    )


def pair_keys(spark, n):
    df = spark.createDataFrame([(1, a, b) for a in range(n) for b in range(a + 1, n)], "universe_id bigint, a bigint, b bigint")
    return df.withColumn("key", F.unhex(F.sha2(F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string")), 256)))


def present(spark, rows):
    return spark.createDataFrame([(1, p, w) for p, w in rows], "universe_id bigint, producer_id bigint, ws bigint")


@pytest.mark.parametrize("n", [2, 20])
def test_chain_telescopes(spark, n):
    keys = stream_keys(spark, [1])
    times = [(0, 1000), (1000, 1345), (1345, 1632)]
    rows = [(1, 1, s, e, [i * 10 + j for j in range(n)]) for i, (s, e) in enumerate(times)]
    df = spark.createDataFrame(rows, "universe_id bigint, producer_id bigint, s bigint, e bigint, v array<bigint>")
    # Decrypting with swapped ends encrypts.
    enc = tl.decrypt(df, keys, "v", F.col("e"), F.col("s"), n, out="c")
    assert all(r.c != r.v for r in enc.collect())
    total = vector_sum(enc, ["universe_id", "producer_id"], "c", n, out="c")
    out = tl.decrypt(total, keys, "c", F.lit(0), F.lit(1632), n, out="v").first().v
    assert out == [30 + 3 * j for j in range(n)]


def test_event_path_equals_telescoped_path(spark):
    rnd = random.Random(1)
    rows = sorted({(1, p, rnd.randrange(0, 9000)) for p in (1, 2) for _ in range(30)} | {(1, 1, 1999)})
    df = spark.createDataFrame([(u, p, t, t % 17) for u, p, t in rows], "universe_id bigint, producer_id bigint, ts_ms bigint, value bigint")
    keys = stream_keys(spark, [1, 2])
    vec = F.array(F.col("value"), F.lit(1).cast("bigint"))
    sums = tl.cipher_window_sums(df, keys, vec, L, W, slice_ms=300)
    whole = sums.filter(chain.complete(F.col("start"), F.col("end"), F.col("ws"), W))
    by_event = {(r.producer_id, r.ws): r.c for r in whole.collect()}
    assert len(by_event) >= 6
    plain = chain.with_window(df, W).groupBy(*WINDOW).agg(F.array(F.sum("value"), F.count("*")).alias("x"))
    wkeys = tl.window_keys(whole.select(*WINDOW), keys, L, W)
    telescoped = {(r.producer_id, r.ws): r.c for r in tl.mask_window_sums(plain, wkeys, "x", L).collect()}
    assert by_event == telescoped


def totals(masks, n=L):
    return [r.m for r in vector_sum(masks, ["universe_id", "ws"], "mask", n, out="m").collect()]


@pytest.mark.parametrize("n_lanes", [2, 20])
def test_clique_masks_cancel(spark, n_lanes):
    p = present(spark, [(i, w) for i in range(12) for w in (0, W) if not (w and i == 3)])
    masks = mk.clique_masks(p, pair_keys(spark, 12), n_lanes)
    rows = masks.collect()
    assert len(rows) == 23 and all(any(r.mask) for r in rows)
    assert {(r.ws, r.neighbours) for r in rows} == {(0, 11), (W, 10)}
    assert all(t == [0] * n_lanes for t in totals(masks, n_lanes))


def test_missing_pair_key_is_an_error(spark):
    p = present(spark, [(i, 0) for i in range(4)])
    with pytest.raises(Exception, match="missing pair key"):
        mk.clique_masks(p, pair_keys(spark, 4).filter("not (a = 1 and b = 2)"), L).collect()


@pytest.mark.parametrize("k", [2, 3, 6])
def test_graph_has_each_pair_once_per_segment(spark, k):
    epochs = spark.createDataFrame([(1, 0)], "universe_id bigint, epoch bigint")
    g = mk.epoch_graph(pair_keys(spark, 8), epochs, k)
    per = g.groupBy(F.expr(f"t div {1 << k}").alias("segment")).agg(F.count("*").alias("n"), F.countDistinct("a", "b").alias("d")).collect()
    assert len(per) == 128 // k and all(r.n == r.d == 28 for r in per)


def test_graph_masks_cancel_after_drops(spark):
    k = 1
    rounds = (128 // k) << k
    p = present(spark, [(i, w) for i in range(10) for w in (0, W) if not (w and i in (4, 5))])
    g = mk.epoch_graph(pair_keys(spark, 10), mk.with_round(p, W, rounds), k)
    masks = mk.graph_masks(p, g, L, W, rounds)
    assert all(t == [0] * L for t in totals(masks))
    dropped = present(spark, [(4, W), (5, W)])
    edges = mk.exclude_dropped(mk.round_edges(g, p, W, rounds), dropped)
    same = {(r.producer_id, r.ws): r.mask for r in mk.signed_sums(edges, L).collect()}
    assert same == {(r.producer_id, r.ws): r.mask for r in masks.collect() if r.neighbours}
    lonely = present(spark, [(1, 0)])
    assert mk.graph_masks(lonely, g, L, W, rounds).first().mask == [0] * L


def test_groups_of_bits_equal_cut_strings(spark):
    from sumveil.functions import prf

    key = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    rows = spark.range(20).select(prf.block_bits(key, F.col("id"), -1).alias("bits"), prf.block_halves(key, F.col("id"), -1).alias("h"))
    each = rows.crossJoin(spark.range(1, 32).toDF("k")).withColumn("g", F.explode(F.expr("sequence(0, 128 div k - 1)")))
    got = each.select("bits", "k", "g", prf.bit_group(F.col("h"), F.col("k"), F.col("g")).alias("v")).collect()
    assert len(got) > 5000 and all(r.v == int(r.bits[r.g * r.k : (r.g + 1) * r.k], 2) for r in got)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_lanes_are_blocks_of_their_number(spark, n):
    """The stream of one call is what single blocks give, for times below zero too."""
    from sumveil.functions import prf

    rows = spark.createDataFrame([(i, t) for i in range(3) for t in (-5, 0, 86_399_999, 1 << 50)], "id long, t long")
    key = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    single = F.concat(*[prf.block(key, F.col("t") + d, lane) for d in (0, 7) for lane in range(n)], F.lit(bytes(16)))
    both = rows.select(wide.decode(prf.lane_blocks(key, [F.col("t"), F.col("t") + 7], n)).alias("a"), wide.decode(single).alias("b")).collect()
    assert all(r.a == r.b and len(set(r.a)) == 2 * n for r in both) and len({tuple(r.a) for r in both}) == 12


def layout_rows(rng, fields, producers, big):
    """(producer, pos, v) with every lane of some producers, repeats, zeros and, if ``big``, values beyond a lane."""
    n = sum(fields.values())
    rows = [(p, lane, rng.randrange(0, 50)) for p in range(producers) for lane in range(n) if p % 2 or rng.random() < 0.3]
    return rows + [(p, rng.randrange(n), 3) for p in range(producers)] + ([(0, 0, 1 << 40), (1, 1, -1)] if big else [])


@pytest.mark.parametrize("batch", [3, 10_000])
def test_packing_round_trip(spark, batch):
    fields, bits = {"a": 7, "b": 5, "c": 3}, {"a": 16, "b": 32}
    packing = pf.Packing(fields, bits, 4)
    assert packing.words == 2 + 3 + 3 and packing.limit[0] == 65535 // 4 and packing.limit[7] == (2**32 - 1) // 4
    rng = random.Random(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for big in (False, True):
            rows = layout_rows(rng, fields, 9, big)
            df = spark.createDataFrame(rows, "p long, pos long, v long")
            out = pf.packed_vectors(df, ["p"], packing)
            flat = out.withColumn("u", wide.unpack(F.col("v"), packing)).collect()
            want = {p: [0] * 15 for p in range(9)}
            for p, lane, v in rows:
                want[p][lane] += v
            assert {r.p for r in flat if r.beyond} == ({0, 1} if big else set())
            assert {r.p: r.u for r in flat if not r.beyond} == {p: v for p, v in want.items() if not (big and p < 2)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packed_sums_at_the_bound(spark):
    """As many vectors as members, each lane at its limit, add up without a carry."""
    fields, bits = {"a": 8, "b": 4, "c": 1}, {"a": 16, "b": 32}
    packing = pf.Packing(fields, bits, 16)
    rows = [(p, lane, int(packing.limit[lane]) if lane < 12 else -p) for p in range(16) for lane in range(13)]
    df = spark.createDataFrame(rows, "p long, pos long, v long")
    out = pf.packed_vectors(df, ["p"], packing)
    assert not out.filter("beyond").count()
    total = vector_sum(out.withColumn("g", F.lit(1)), ["g"], "v", packing.words, out="t").select(wide.unpack(F.col("t"), packing).alias("u")).first().u
    assert total == [16 * int(x) for x in packing.limit[:12]] + [-120]


def test_lengths_of_packed_profiles():
    sizes = [pf.Packing(p.fields, p.bits, 16).words for p in (pf.POLAR, pf.CAR)] + [pf.Packing(pf.WEB_FIELDS, pf.WEB_BITS, 16).words]
    assert sizes == [683 - (155 - 78) - (310 - 155), 169, 956]


def private_events(spark, hot=0):
    """Polar events of 40 producers of two universes over three windows; the first producer has ``hot`` more events in one bin."""
    rows = [(u, 100 * u + p, w * 1000 + 7 * p, 60 + p, 100, 5, 1, 0, 20) for u in (0, 3) for p in range(20) for w in range(4)]
    rows += [(0, 0, 1000 + 8 + i % 900, 61, 100, 5, 1, 0, 20) for i in range(hot)]
    cols = "universe_id long, producer_id long, ts_ms long, " + ", ".join(f"{a} long" for a in pf.POLAR.attrs)
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("hot", [0, 5000])
def test_profiles_are_released_for_whole_universes_only(spark, hot):
    """One producer without a token shuts its universe's window, also where its mask group is only one of several."""
    from sumveil.catalog import application_queries as aq

    events = private_events(spark, hot)
    # All producers lie in universe 0 of the catalogue's keys but for the high bits; commits leave some out.
    run = lambda sent: {(r.universe_id, r.ws, r.field, r.lane): r.v for r in aq.private_lanes(events.filter("universe_id = 0"), lambda e: pf.fine_lane_totals(e, WINDOW, pf.POLAR), pf.POLAR.fields, pf.POLAR.bits, 1000, sent, universe=0).collect()}
    whole = run(None)
    gone = run(~((F.col("producer_id") == 2) & (F.col("ws") == 1000)))
    assert {k[1] for k in whole} == {0, 1000, 2000} and {k[1] for k in gone} == {0, 2000}
    assert gone == {k: v for k, v in whole.items() if k[1] != 1000}
    kept = [p for p in range(20) if p % 8 <= 6]
    for ws in (0, 1000, 2000):
        n = len([p for p in kept if not (p % 10 == 7 and (ws // 1000) % 2 == 0)])
        assert whole[0, ws, "count", 0] == n + (hot if ws == 1000 else 0)
    assert whole[0, 1000, "heartrateHist", 61] == 1 + hot


def universes_of(spark):
    """Universes 1 (k = 1), 2 (no k) and 3 (k = 2) of ten producers each, over windows of two epochs of universe 1."""
    rows = [(u, 10 * u + i, w * W) for u in (1, 2, 3) for i in range(10) for w in (0, 1, 2, 256, 257) if (i + w) % 7]
    present = spark.createDataFrame(rows, "universe_id bigint, producer_id bigint, ws bigint")
    pairs = spark.createDataFrame([(u, 10 * u + a, 10 * u + b) for u in (1, 2, 3) for a in range(10) for b in range(a + 1, 10)], "universe_id bigint, a bigint, b bigint")
    pairs = pairs.withColumn("key", F.unhex(F.sha2(F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string")), 256)))
    return present, pairs, spark.createDataFrame([(1, 1, 256), (2, None, None), (3, 2, 256)], "universe_id bigint, k bigint, rounds bigint")


def test_parameters_choose_graph_or_all_pairs(spark):
    present, pairs, parameters = universes_of(spark)
    masks = mk.parameter_masks(present, pairs, parameters, L, W)
    rows = masks.collect()
    assert len(rows) == present.count() and all(t == [0] * L for t in totals(masks))
    size = {(r.universe_id, r.ws): r["count"] for r in present.groupBy("universe_id", "ws").count().collect()}
    near = {u: [r.neighbours / (size[u, r.ws] - 1) for r in rows if r.universe_id == u] for u in (1, 2, 3)}
    mean = {u: sum(x) / len(x) for u, x in near.items()}
    assert set(near[2]) == {1.0} and 0.3 < mean[1] < 0.7 and 0.1 < mean[3] < 0.4
    # The same edges as from whole graphs of fixed k.
    got = {(r.universe_id, r.ws, r.a, r.b) for r in mk.parameter_edges(present, pairs, parameters, W).collect()}
    for u, k in ((1, 1), (3, 2)):
        mine, rounds = present.filter(F.col("universe_id") == u), (128 // k) << k
        graph = mk.epoch_graph(pairs, mk.with_round(mine, W, rounds), k)
        edges = mk.only_present(mk.round_edges(graph, mine, W, rounds), mine)
        assert {x for x in got if x[0] == u} == {(r.universe_id, r.ws, r.a, r.b) for r in edges.collect()}


def test_missing_keys_are_errors_only_where_all_pairs_are_used(spark):
    present, pairs, parameters = universes_of(spark)
    mk.parameter_masks(present, pairs.filter("not (a = 11 and b = 13)"), parameters, L, W).collect()
    with pytest.raises(Exception, match="missing pair key"):
        mk.parameter_masks(present, pairs.filter("not (a = 21 and b = 23)"), parameters, L, W).collect()
    # A universe that no parameter names uses all pairs too.
    few = mk.parameter_masks(present, pairs, parameters.filter("universe_id = 1"), L, W)
    assert {r.neighbours for r in few.filter("universe_id = 3 and ws = 0").collect()} == {7}


def test_finished_epochs_are_removed(spark, tmp_path):
    path = str(tmp_path / "graph")
    present, pairs, _ = universes_of(spark)
    epochs = spark.createDataFrame([(1, -10), (1, 0), (1, 10)], "universe_id bigint, epoch bigint")
    mk.write_graph(mk.epoch_graph(pairs, epochs, 1), path)
    reader = mk.retained_graph(spark, path, 0)
    n = reader.count()
    assert mk.drop_epochs(spark, path, 0) == [-10]
    assert {r.epoch for r in mk.stored_graph(spark, path).select("epoch").distinct().collect()} == {0, 10}
    assert reader.count() == n  # a reader of the kept epochs goes on
    assert mk.drop_epochs(spark, path, 100) == [0, 10] and mk.stored_graph(spark, path).count() == 0


def test_sampled_masks_cancel(spark):
    p = present(spark, [(i, w * W) for i in range(10) for w in range(4)])
    masks = mk.sampled_masks(p, pair_keys(spark, 10), L, 2)
    n = sum(r.neighbours for r in masks.collect()) / 2
    assert 0 < n < 4 * 45 / 2
    assert all(t == [0] * L for t in totals(masks))


@pytest.mark.parametrize("n", [2, 20])
def test_release_is_all_or_nothing(spark, n):
    p = present(spark, [(i, w) for i in range(5) for w in (0, W)])
    keys = stream_keys(spark, range(5))
    sums = p.withColumn("x", F.array(*[F.col("producer_id") + i for i in range(n)]))
    wkeys = tl.window_keys(p, keys, n, W)
    c = tl.mask_window_sums(sums, wkeys, "x", n)
    tokens = rl.masked_tokens(mk.clique_masks(p, pair_keys(spark, 5), n), wkeys, n)
    sent = tokens.filter("not (ws = 0 and producer_id = 2)").unionByName(tokens.filter("producer_id = 1"))
    got = rl.release(c, sent, n).collect()
    assert [(r.ws, r.producers, r.v) for r in got] == [(W, 5, [10 + 5 * i for i in range(n)])]
    single = rl.release_single(c, wkeys, n).collect()
    assert all(r.v == [r.producer_id + i for i in range(n)] for r in single)


@pytest.mark.parametrize("layout", [pf.POLAR.fields, pf.CAR.fields, pf.WEB_FIELDS, pf.STANDARD.fields])
def test_dense_vectors_round_trip(spark, layout):
    rnd = random.Random(4)
    lanes = sorted({(1, f, rnd.randrange(n)) for f, n in layout.items() for _ in range(3)})
    first, last = list(layout)[0], list(layout)[-1]
    rows = [(u, f, i, rnd.randrange(1, 99)) for u, f, i in lanes] + [(2, last, layout[last] - 1, 7), (3, first, 0, 8)]
    df = spark.createDataFrame(rows, "u bigint, field string, lane bigint, v bigint")
    dense = pf.dense_vectors(pf.flatten_lanes(df, layout), ["u"], layout)
    assert all(len(r.v) == pf.n_lanes(layout) for r in dense.collect())
    assert sorted(tuple(r) for r in pf.rebuild_lanes(dense, ["u"], layout).collect()) == sorted(rows)


def test_packed_sizes():
    """Published vector lengths: the altitude fields are counted twice over there."""
    polar16 = [b.n for b in pf.POLAR.bins]
    polar32 = [b.n for b in pf.POLAR.bins if b.grouped]
    longs = sum(pf.packed_longs(n, 16) for n in polar16) + sum(pf.packed_longs(n, 32) for n in polar32) + 13
    assert longs == 683 - (155 - 78) - (310 - 155)
    assert sum(pf.packed_longs(b.n, 16) for b in pf.CAR.bins) + 23 == 169
    sums = 4 * (2 * pf.packed_longs(100, 32) + pf.packed_longs(100, 16))
    assert 5 * pf.packed_longs(100, 16) + sums + 6 * pf.packed_longs(220, 16) + 1 == 956


def test_graph_parameters_fixed_points(spark):
    # Members -> (k, rounds) for alpha 0.5 and delta 1e-5.
    want = {
        60: (None, None), 100: (1, 256), 200: (2, 256), 500: (3, 336), 1000: (4, 512), 2000: (5, 800),
        5000: (6, 1344), 10000: (7, 2304),
    }
    df = spark.createDataFrame([(n, n, 0.5, 1e-5) for n in want], "universe_id bigint, min_size bigint, alpha double, delta double")
    got = {r.members: (r.k, r.rounds) for r in pm.graph_parameters(df).collect()}
    assert got == want


def test_quarantine(spark):
    cols = ", ".join(f"{a} bigint" for a in pf.POLAR.attrs)
    ok = (100, 50, 10, 0, 5, 20)
    df = spark.createDataFrame([ok, (220, *ok[1:]), (100, -101, *ok[2:]), (100, -109, *ok[2:]), (100, -110, *ok[2:]), (100, None, *ok[2:])], cols)
    good, bad = pf.split_invalid(df, pf.POLAR)
    assert good.count() == 3 and bad.count() == 3


def test_bins_count_what_is_off_an_axis(spark):
    cols = "u bigint, " + ", ".join(f"{a} bigint" for a in pf.POLAR.attrs)
    ok = (100, 50, 10, 0, 5, 20)
    rows = [(1, *ok), (1, *ok), (1, 220, *ok[1:]), (1, 100, None, *ok[2:]), (2, *ok[:-1], 41), (2, *ok)]
    got = {(r.u, r.axis, r.bin): (r.n, r.s) for r in pf.bin_totals(spark.createDataFrame(rows, cols), ["u"], pf.POLAR).collect()}
    assert got[1, pf.QUARANTINE, None] == (2, None) and got[2, pf.QUARANTINE, None] == (1, None)
    assert got[1, "altitude", 15] == (2, 200) and got[2, "altitude", 15] == (1, 100) and len(got) == 14


def test_value_off_its_axis_is_counted_not_encoded(spark):
    from sumveil.catalog import application_queries as aq

    cols = "universe_id bigint, producer_id bigint, ts_ms bigint, ws bigint, " + ", ".join(f"{a} bigint" for a in pf.POLAR.attrs)
    ok, off, lacking = (100, 50, 10, 0, 5, 20), (220, 50, 10, 0, 5, 20), (100, None, 10, 0, 5, 20)
    rows = [(0, 1, 5, 0, *ok), (0, 1, 6, 0, *off), (0, 2, 5, 0, *lacking), (0, 1, 1005, 1000, *ok), (0, 2, 1006, 1000, *ok)]
    events = spark.createDataFrame(rows, cols)
    named = lambda df: {(r.ws, r.field, r.lane): r.v for r in df.collect()}
    got = named(pf.lane_totals(events, ["ws"], pf.POLAR))
    good = named(pf.lane_totals(events.filter("ts_ms <> 6 and altitude is not null"), ["ws"], pf.POLAR))
    assert got == good | {(0, pf.QUARANTINE, 0): 2}
    # Producer 2 has nothing to encode in window 0 and still sends zeros, so the window is released.
    lanes = lambda e: pf.fine_lane_totals(e, ["universe_id", "producer_id", "ws"], pf.POLAR)
    private = named(aq.private_lanes(events.drop("ws"), lanes, pf.POLAR.fields, pf.POLAR.bits, 1000, universe=0))
    assert private == {k: v for k, v in good.items() if k[0] == 0}


def test_web_key_off_its_axis_is_counted_not_encoded(spark):
    one = "map({}, 1)"
    names = ["pageExit", "pageView", *pf.WEB_TIMINGS]
    event = lambda ts, page, cell: ", ".join([str(ts)] + [one.format(f"'{page}'")] * len(names) + [one.format(f"'0_{page}'")] + [one.format(f"'{cell}'")] * 2)
    cols = ", ".join(["u", *names, "pageUserFlow", "clickGrid", "hoverGrid"])
    frame = lambda *events: spark.sql(f"SELECT * FROM VALUES {', '.join(f'({e})' for e in events)} AS t({cols})")
    named = lambda df: {(r.u, r.field, r.lane): r.v for r in df.collect()}
    fine = event(1, 99, "0_19_10")
    got = named(pf.web_lane_totals(frame(fine, event(1, 100, "0_19_10"), event(2, 5, "0_20_1"), event(2, 5, "x")), ["u"]))
    assert got == named(pf.web_lane_totals(frame(fine), ["u"])) | {(1, pf.QUARANTINE, 0): 1, (2, pf.QUARANTINE, 0): 2}
    left = pf.in_vector(pf.web_position_totals(frame(event(2, 5, "x")), ["u"]), pf.WEB_FIELDS).collect()
    assert [(r.pos, r.v) for r in left] == [(pf.offsets(pf.WEB_FIELDS)["count"], 0)]

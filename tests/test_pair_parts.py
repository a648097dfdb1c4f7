"""Pairs in parts: ciphers, edges and sums are made where the pairs lie, and equal those of shuffled pairs."""

import pytest
from pyspark.sql import functions as F

from sumveil.functions import prf, wide
from sumveil.functions.vectors import vector_sum
from sumveil.operators import masks as mk
from sumveil.sources import fixtures as fx
from sumveil.sources.parts import PART

W, L = 1000, 3
KEY = "unhex(sha2(concat_ws('_', a, b), 256))"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(spark):
    """Members of a large and a small universe, some of them missing."""
    return spark.range(1020, 1160).filter("id % 7 <> 3").select(F.col("id").alias("producer_id"))


def test_ciphers_of_many_keys_equal_those_of_the_engine(spark):
    rows = spark.range(50).select("id", (F.col("id") * 977 - 20_000).alias("t"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    key, t = F.col("key"), F.col("t")
    got = rows.select(wide.graph_rounds(key, t, F.lit(5), prf.GRAPH_LANE).alias("rounds"), wide.bit_groups(prf.block(key, t, prf.GRAPH_LANE), F.lit(5)).alias("want")).collect()
    assert all(r.rounds == r.want for r in got)
    with pytest.raises(Exception, match="256 bits"):
        rows.select(wide.graph_rounds(F.substr(key, F.lit(1), F.lit(16)), t, F.lit(5), -1)).collect()


@pytest.mark.parametrize("k", [1, 3, 31])
def test_rounds_in_use_are_those_among_all(spark, k):
    use = F.array(*[F.lit(g * 2**k + x).cast("bigint") for g in (0, 1, 128 // k - 1) for x in (0, 1)])
    rows = spark.range(200).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"), F.lit(5).cast("bigint").alias("e"))
    every, used = (wide.graph_rounds(F.col("key"), F.col("e"), F.lit(k), -1, u) for u in (None, use))
    got = rows.select(F.array_sort(F.array_intersect(every, use)).alias("want"), F.array_sort(used).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got] and (k > 3 or any(r.got for r in got))


def test_pairs_are_those_of_a_universe_and_are_not_shuffled(spark):
    here = [r.producer_id for r in ids(spark).collect()]
    pairs = fx.graph_pairs(ids(spark).unionByName(ids(spark)))
    want = sorted((0 if b < 1100 else 1, a, b) for a in here for b in here if a < b and (a < 1100) == (b < 1100))
    assert sorted((r.universe_id, r.a, r.b) for r in pairs.collect()) == want
    assert pairs.filter(F.col("key") != F.expr(KEY)).count() == 0
    members = ids(spark).select((F.col("producer_id") >= 1100).cast("bigint").alias("universe_id"), "producer_id", F.lit(0).cast("bigint").alias("ws"), F.lit(1).alias("k"), F.lit(256).alias("rounds"))
    above = plan(wide.part_sums(pairs.select(*PART, "a", "b", "key"), fx.spread(members.groupBy("universe_id", "producer_id", "k", "rounds").agg(F.collect_set("ws").alias("windows")).crossJoin(spark.range(16).toDF("part")), *PART), PART, L, W, -1, 2)).split("SortMergeJoin")[0]
    assert "FlatMapCoGroups" in above and "Exchange" not in above and "Sort " not in above


@pytest.mark.parametrize("k", [1, 2, None])
def test_sums_in_parts_equal_those_of_shuffled_edges(spark, k):
    present = ids(spark).crossJoin(spark.range(0, 9).select((F.col("id") * 90 * W).alias("ws"))).filter("(producer_id + ws) % 11 <> 2")
    present = present.select((F.col("producer_id") >= 1100).cast("bigint").alias("universe_id"), "producer_id", "ws")
    parameters = spark.createDataFrame([(0, k, None if k is None else 128 // k * 2**k), (1, None, None)], "universe_id bigint, k bigint, rounds bigint")
    pairs = fx.graph_pairs(present)
    edges = mk.parameter_edges(present, pairs.drop("part"), parameters, W)
    rows = lambda df: {(r.universe_id, r.ws, r.producer_id): (r.mask, r.neighbours) for r in df.collect()}
    want = rows(mk.signed_sums(edges, L))
    assert rows(mk.part_masks(mk.with_parameters(present, parameters), pairs, L, W)) == want and len(want) > 500
    both = [rows(mk.parameter_masks(present, p, parameters, L, W)) for p in (pairs, pairs.drop("part"))]
    assert both[0] == both[1]
    total = vector_sum(mk.parameter_masks(present, pairs, parameters, L, W), ["universe_id", "ws"], "mask", L).collect()
    assert all(r.v == [0] * L for r in total)


def test_a_missing_pair_key_in_parts_is_an_error_only_where_all_pairs_are_used(spark):
    present = ids(spark).select((F.col("producer_id") >= 1100).cast("bigint").alias("universe_id"), "producer_id", F.lit(0).cast("bigint").alias("ws"))
    parameters = spark.createDataFrame([(0, 2, 256), (1, None, None)], "universe_id bigint, k bigint, rounds bigint")
    first = lambda u: mk.parameter_masks(present, fx.graph_pairs(present).filter(f"universe_id <> {u} or a <> {1020 if u == 0 else 1100}"), parameters, L, W)
    assert first(0).count() == present.count()
    with pytest.raises(Exception, match="missing pair key"):
        first(1).collect()


def test_segments_are_counted_where_rounds_are_made(spark):
    pairs = fx.graph_pair_keys(ids(spark))
    epochs = spark.createDataFrame([(0, 3, 0), (1, 20, 0), (1, 20, 5)], "universe_id bigint, k bigint, epoch bigint")
    add = lambda df: sorted(map(tuple, df.groupBy("universe_id", "epoch", "segment").agg(F.sum("edges")).collect()))
    lists = mk.pair_rounds(pairs, epochs)
    n = {u: ids(spark).filter(f"(producer_id >= 1100) = ({u} = 1)").count() for u in (0, 1)}
    want = sorted((u, e, g, n[u] * (n[u] - 1) // 2) for u, e, parts in ((0, 0, 42), (1, 0, 6), (1, 5, 6)) for g in range(parts))
    assert add(mk.pair_segments(pairs, epochs)) == want == add(mk.stored_segments(lists, epochs.select("universe_id", "k").distinct()))


def test_profiles_are_released_without_shuffling_vectors(spark, monkeypatch):
    """Events are shuffled once, by group and window; lanes and vectors stay there, also for both passes of a profile."""
    from sumveil.catalog import application_queries as aq
    from sumveil.plans import profiles as pf

    rows = [(1, p, w * W + t, *(100, 50, 10, 0, 5, 20)) for p in range(40) for w in range(3) for t in (p, W - 1)]
    events = spark.createDataFrame(rows, "universe_id bigint, producer_id bigint, ts_ms bigint, " + ", ".join(f"{a} bigint" for a in pf.POLAR.attrs))
    plans, write = {}, aq.materialize
    monkeypatch.setattr(aq, "materialize", lambda df, name: plans.setdefault(name, plan(df)) and write(df, name))
    run = lambda sent=None: {(r.ws, r.field, r.lane): r.v for r in aq.private_lanes(events, lambda e: pf.fine_lane_totals(e, ["universe_id", "producer_id", "ws"], pf.POLAR), pf.POLAR.fields, pf.POLAR.bits, W, sent).collect()}
    got = run()
    kept = {w: [p for p in range(40) if p % 8 <= 6 and not (p % 10 == 7 and w % 2 == 0)] for w in range(3)}
    assert {w * W: 2 * len(p) for w, p in kept.items()} == {w: v for (w, f, _), v in got.items() if f == "count"}
    assert {w * W: 200 * len(p) for w, p in kept.items()} == {w: v for (w, f, i), v in got.items() if f == "heartrateBase" and i == 0}
    assert {k: v for k, v in got.items() if k[0] != W} == run(~((F.col("producer_id") == 20) & (F.col("ws") == W)))
    # Twice the events, which are read once by exchange reuse, and once the keys.
    above = plans["released-groups"].split("Union")[1]
    assert above.count("Exchange") == above.count("REPARTITION_BY_NUM") == 3 and "Exchange" not in plans["released-groups"].split("Union")[0]


def test_a_missing_pair_key_of_a_group_is_an_error(spark):
    from sumveil.functions import wide
    from sumveil.operators import release as rl, telescoping as tl

    present = spark.range(4).select(F.lit(0).cast("bigint").alias("universe_id"), F.col("id").alias("producer_id"), F.lit(0).cast("bigint").alias("ws"))
    keys = present.select("producer_id", F.unhex(F.sha2(F.col("producer_id").cast("string"), 256)).alias("key"))
    pairs = fx.pair_keys(present, 16)
    lanes = present.withColumn("pos", F.col("producer_id") % 2).withColumn("v", F.col("producer_id") + 1)
    packing = wide.Packing({"x": 2}, {"x": 16}, 16)
    out = lambda some, v=lanes: rl.release_committed(v, tl.outer_times(present, keys, W), mk.cohort_masks(present, some), packing).collect()
    assert [tuple(r) for r in out(pairs)] == [(0, 0, [4, 6], 4, False)]
    assert [tuple(r) for r in out(pairs, lanes.withColumn("v", F.col("v") * 2000))] == [(0, 0, None, 4, True)]
    with pytest.raises(Exception, match="missing pair key"):
        out(pairs.filter("not (a = 1 and b = 2)"))

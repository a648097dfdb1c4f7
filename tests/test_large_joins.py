"""Tables that Spark takes for small are not broadcast, and work on pairs is kept in many tasks."""

import pytest
from pyspark.sql import functions as F

from sumveil.functions import prf, wide
from sumveil.operators import commits as cm, masks as mk, release as rl, telescoping as tl
from sumveil.session import spread_files
from sumveil.sources import fixtures as fx, records as rec

KEY = "unhex(sha2(concat_ws('_', a, b), 256))"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def members(spark, n=20, windows=2):
    return spark.range(n).crossJoin(spark.range(windows).toDF("ws")).select(F.lit(0).cast("bigint").alias("universe_id"), F.col("id").alias("producer_id"), "ws")


def all_pairs(spark, n=20):
    ids = spark.range(n)
    return ids.toDF("a").crossJoin(ids.toDF("b")).filter("a < b").select(F.lit(0).cast("bigint").alias("universe_id"), "a", "b", F.expr(KEY).alias("key"))


def test_pairs_are_not_broadcast(spark):
    present, pairs = members(spark).localCheckpoint(), all_pairs(spark).localCheckpoint()
    for df in (mk.window_pairs(pairs, present), mk.new_pairs(pairs, present.filter("false"), present.filter("ws = 0")), mk.only_present(mk.window_pairs(pairs, present), present)):
        assert "Broadcast" not in plan(df) and df.count() in (190, 380)


def test_vectors_are_not_broadcast(spark):
    keys = members(spark).localCheckpoint()
    sums = keys.withColumn("x", F.array(F.lit(1).cast("bigint")))
    wkeys = keys.withColumn("k", F.array(F.lit(2).cast("bigint")))
    masks = keys.withColumn("mask", F.array(F.lit(3).cast("bigint")))
    for df in (tl.mask_window_sums(sums, wkeys, "x", 1), rl.masked_tokens(masks, wkeys, 1), cm.token_semi(masks, keys), cm.committed(keys, keys)):
        assert "Broadcast" not in plan(df) and df.count() == 40


def test_pair_keys_come_from_many_tasks(spark):
    events = spark.range(400).select(F.col("id").alias("producer_id"))
    for pairs in (fx.pair_keys(events, 16), fx.graph_pair_keys(events)):
        assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_bit_groups_equal_cut_strings(spark):
    rows = spark.range(20).withColumn("key", F.when(F.col("id") != 7, F.unhex(F.sha2(F.col("id").cast("string"), 256))))
    each = rows.crossJoin(spark.range(1, 32).toDF("k"))
    got = each.select("id", "k", prf.block_bits(F.col("key"), F.col("id"), -1).alias("bits"), wide.bit_groups(prf.block(F.col("key"), F.col("id"), -1), F.col("k")).alias("t")).collect()
    for r in got:
        n = 128 // r.k
        assert r.t == ([None] * n if r.id == 7 else [(g << r.k) + int(r.bits[g * r.k : (g + 1) * r.k], 2) for g in range(n)])


@pytest.mark.parametrize("k", [0, 1, 3])
def test_sampled_pairs_have_leading_zeros(spark, k):
    present, pairs = members(spark), all_pairs(spark)
    drawn = F.substr(prf.block_bits(F.col("key"), F.col("ws"), prf.SAMPLE_LANE), F.lit(1), F.lit(k)) == F.lit("0" * k)
    want = mk.window_pairs(pairs, present).filter(drawn).count()
    assert mk.sampled_masks(present, pairs, 1, k).agg(F.sum("neighbours")).first()[0] == 2 * want > 0


def test_trace_is_grouped_in_parts_by_its_size(spark, tmp_path):
    path = str(tmp_path / "trace")
    df = spark.range(2000).select(F.lit(1).cast("bigint").alias("trace"), F.col("id").alias("timestamp"), *[F.lit(5).alias(c) for c in rec.TRACE_COLUMNS[1:]])
    rec.write_trace(df, path, ["trace"])
    back = rec.read_trace(spark, path, "trace bigint")
    assert "REBALANCE" in plan(df.hint("rebalance", "timestamp"))
    parts = spread_files(back, path, "trace", "timestamp", part_bytes=1000)
    assert parts.rdd.getNumPartitions() > 10 and parts.count() == 2000
    assert spread_files(back, path, "trace", "timestamp").rdd.getNumPartitions() == 4

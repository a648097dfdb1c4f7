"""Tokens and all-or-nothing release of population sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumveil.functions import wide
from sumveil.functions.prf import lane_blocks
from sumveil.functions.vectors import WIDE_LANES, combine, vector_sum, zeros
from sumveil.functions.wide import Packing
from sumveil.operators.commits import token_semi
from sumveil.session import spread

WINDOW = ["universe_id", "producer_id", "ws"]
#: What a mask group's window is dealt out by.
GROUP = ["universe_id", "ws"]


def plain_tokens(wkeys: DataFrame, n_lanes: int) -> DataFrame:
    """Token without masks: the negated window key."""
    return wkeys.select(*WINDOW, combine(n_lanes, [zeros(n_lanes)], [F.col("k")]).alias("token"))


def masked_tokens(masks: DataFrame, wkeys: DataFrame, n_lanes: int) -> DataFrame:
    """Token = mask - F(we - 1) + F(ws - 1)."""
    both = masks.select(*WINDOW, "mask").join(wkeys.hint("merge"), WINDOW)
    return both.select(*WINDOW, combine(n_lanes, [F.col("mask")], [F.col("k")]).alias("token"))


def release(ciphers: DataFrame, tokens: DataFrame, n_lanes: int, cipher: str = "c", expected: DataFrame | None = None) -> DataFrame:
    """Population sums of windows for which every expected token arrived.

    ``ciphers`` holds one encrypted vector per committed (producer, window).  Vectors
    and tokens of a window go through one sum; a window with a token missing gives
    no row.  ``expected`` holds the committed (producer, window) pairs where they are
    at hand, so that the ciphers need not be computed for them once more.
    """
    got = token_semi(tokens, ciphers if expected is None else expected)
    parts = ciphers.select("universe_id", "ws", F.col(cipher).alias("_x"), F.lit(1).alias("_c"), F.lit(0).alias("_t")).unionByName(
        got.select("universe_id", "ws", F.col("token").alias("_x"), F.lit(0).alias("_c"), F.lit(1).alias("_t"))
    )
    return release_parts(parts, n_lanes)


def release_committed(lanes: DataFrame, wkeys: DataFrame, masks: DataFrame, packing: Packing, sent: Column | None = None) -> DataFrame:
    """The same for long vectors of mask groups of bounded size, such as cohorts: (universe, ws, v, producers, beyond).

    ``lanes`` has (universe, producer, ws, pos, v) rows, dealt out by universe and ws; ``wkeys`` (WINDOW, key,
    start, end) per committed producer; ``masks`` its pairs (``masks.cohort_masks``).  All are narrow and meet
    by group.  There vectors v, window keys k and masks are made, cipher v + k and token mask - k are added
    up, so no vector is shuffled.  ``sent`` says whether a producer's token arrived (all did without it).
    A group with a lane beyond its limit has no ``v`` and says so in ``beyond``.
    """
    arrived = F.lit(True) if sent is None else F.coalesce(sent, F.lit(False))
    one = wkeys.select("universe_id", "ws", F.col("producer_id").alias("a"), F.lit(None).cast("bigint").alias("b"), "key", "start", "end", arrived.alias("sent"))
    two = masks.select("universe_id", "ws", "a", "b", "key", F.col("ws").alias("start"), F.col("ws").alias("end"), F.lit(None).cast("boolean").alias("sent"))
    both = spread(one.unionByName(two), *GROUP).sortWithinPartitions(*GROUP)
    alone = lane_blocks(F.col("key"), [F.col("end"), F.col("start")], packing.words)
    shared = lane_blocks(F.col("key"), [F.col("start")], packing.words)
    return wide.group_release(lanes, both.withColumn("data", F.when(F.col("b").isNull(), alone).otherwise(shared)), GROUP, packing)


def whole_universes(groups: DataFrame, present: DataFrame, universe_of: Column) -> DataFrame:
    """(universe, ws) windows of which every mask group was released.

    Masks cancel within groups (the ``universe_id`` of ``groups`` and ``present``), and a
    group is released or not by itself; its sum is held back until the groups of its
    universe (``universe_of`` a group) have released as many producers as committed
    there.  Only (group, window) rows meet here, not vectors.
    """
    committed = present.groupBy("universe_id", "ws").agg(F.count("*").alias("_n"))
    released = groups.select("universe_id", "ws", (-F.col("producers").cast("bigint")).alias("_n"))
    both = committed.unionByName(released).withColumn("universe_id", universe_of)
    return both.groupBy("universe_id", "ws").agg(F.sum("_n").alias("_open")).filter("_open = 0").drop("_open")


def release_parts(parts: DataFrame, n_lanes: int) -> DataFrame:
    """Sum ciphers and tokens of a window; a window whose counts differ gives no row."""
    if n_lanes > WIDE_LANES:
        # Both counts ride along as two more lanes of the same sum.
        counted = parts.withColumn("_x", F.concat("_x", F.array(F.col("_c").cast("bigint"), F.col("_t").cast("bigint"))))
        total = vector_sum(counted, ["universe_id", "ws"], "_x", n_lanes + 2, out="_v")
        full = total.filter(F.col("_v")[n_lanes] == F.col("_v")[n_lanes + 1])
        return full.select("universe_id", "ws", F.col("_v")[n_lanes].alias("producers"), F.slice("_v", 1, n_lanes).alias("v"))
    total = vector_sum(
        parts, ["universe_id", "ws"], "_x", n_lanes,
        extra=[F.sum("_c").alias("producers"), F.sum("_t").alias("tokens")], out="v",
    )
    return total.filter(F.col("tokens") == F.col("producers")).drop("tokens")


def release_single(ciphers: DataFrame, wkeys: DataFrame, n_lanes: int, cipher: str = "c") -> DataFrame:
    """Single-producer release: the receiver subtracts the window key."""
    return ciphers.join(wkeys.hint("merge"), WINDOW).select(*WINDOW, combine(n_lanes, [F.col(cipher)], [F.col("k")]).alias("v"))

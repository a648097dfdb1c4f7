import random

import pytest
from pyspark.sql import functions as F

from sumveil.functions import encodings as enc, timewin as tw, vectors
from sumveil.functions.arith import limb_sums, limb_total, wrap_sum
from sumveil.functions.prf import block, block_bits, lane_blocks, parse_lanes, prf_lanes

M = 1 << 64


def signed(x):
    x %= M
    return x - M if x >= M // 2 else x


EDGES = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, -(2**32), 2**22 - 1]


def test_wrapping_row_sum(spark):
    rnd = random.Random(1)
    rows = [tuple(rnd.choice(EDGES + [rnd.randrange(-(2**63), 2**63)]) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    got = df.select("a", "b", "c", wrap_sum([F.col("a"), F.col("b")], [F.col("c")]).alias("r")).collect()
    assert all(r.r == signed(r.a + r.b - r.c) for r in got)


@pytest.mark.parametrize("with_sign", [False, True])
def test_wrapping_aggregate(spark, with_sign):
    rnd = random.Random(2)
    rows = [(rnd.randrange(3), rnd.choice(EDGES + [rnd.randrange(-(2**63), 2**63)]), rnd.choice([1, -1])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g bigint, v bigint, s bigint")
    agg = df.groupBy("g").agg(*limb_sums(F.col("v"), "x", F.col("s") if with_sign else None))
    for r in agg.select("g", limb_total("x").alias("t")).collect():
        assert r.t == signed(sum(v * (s if with_sign else 1) for g, v, s in rows if g == r.g))


def test_block_is_aes256(spark):
    """Published AES-256 vector: key 00..1f, block 00112233..ff."""
    key = bytes(range(32))
    lane = 0x8899AABBCCDDEEFF - M
    df = spark.createDataFrame([(key,)], "key binary")
    got = df.select(block(F.col("key"), F.lit(0x0011223344556677), lane).alias("b")).first().b
    assert bytes(got).hex() == "8ea2b7ca516745bfeafc49904b496089"


@pytest.mark.parametrize("n", [3, 16, 17, 40])
def test_lane_keys_short_and_long(spark, n):
    df = spark.createDataFrame([(bytes([i] * 32), i * 1000 - 5) for i in range(4)], "key binary, t bigint")
    rows = df.select(
        prf_lanes(F.col("key"), F.col("t"), n).alias("lanes"),
        *[block(F.col("key"), F.col("t"), i).alias(f"b{i}") for i in (0, n - 1)],
        parse_lanes(lane_blocks(F.col("key"), [F.col("t") + 1, F.col("t")], n), n, 1).alias("second"),
    ).collect()
    for r in rows:
        assert len(r.lanes) == n and r.second == r.lanes
        for i in (0, n - 1):
            b = bytes(r[f"b{i}"])
            want = int.from_bytes(b[:8], "big") ^ int.from_bytes(b[8:], "big")
            assert r.lanes[i] == signed(want)


def test_block_bits(spark):
    r = spark.createDataFrame([(b"k" * 32,)], "key binary").select(
        block(F.col("key"), F.lit(7), -1).alias("b"), block_bits(F.col("key"), F.lit(7), -1).alias("s")
    ).first()
    assert r.s == format(int.from_bytes(bytes(r.b), "big"), "0128b")


@pytest.mark.parametrize("n", [3, 20])
def test_vector_sum_and_combine(spark, n):
    rnd = random.Random(3)
    rows = [(rnd.randrange(4), [rnd.randrange(-(2**63), 2**63) for _ in range(n)], rnd.choice([1, -1])) for _ in range(200)]
    df = spark.createDataFrame(rows, "g bigint, v array<bigint>, s bigint")
    for r in vectors.vector_sum(df, ["g"], "v", n, "s", out="t").collect():
        assert r.t == [signed(sum(v[i] * s for g, v, s in rows if g == r.g)) for i in range(n)]
    both = df.select("v", vectors.combine(n, [F.col("v"), F.col("v")], [F.reverse("v")]).alias("c")).collect()
    assert all(r.c == [signed(2 * a - b) for a, b in zip(r.v, r.v[::-1])] for r in both)


def test_bucket_edges(spark):
    b = [100, 200, 300, 400, 500, 600, 700, 800, 900]
    xs = [511, 99, 100, 900, 899, -5]
    got = spark.createDataFrame([(x,) for x in xs], "x bigint").select(enc.bucket(F.col("x"), b).alias("i"))
    assert [r.i for r in got.collect()] == [5, 0, 1, 9, 8, 0]


def test_empty_population_has_no_statistics(spark):
    df = spark.createDataFrame([(0, 0, 0)], "s bigint, q bigint, n bigint")
    s, q, n = F.col("s"), F.col("q"), F.col("n")
    r = df.select(enc.decode_avg(s, n).alias("a"), enc.decode_var(s, q, n).alias("v"), enc.decode_stddev(s, q, n).alias("d")).first()
    assert r.a is None and r.v is None and r.d is None
    none = df.agg(enc.decode_min_bucket(F.col("s"), n).alias("lo"), enc.decode_max_bucket(F.col("s"), n).alias("hi")).first()
    assert (none.lo, none.hi) == (-1, -1)


@pytest.mark.parametrize("bits", [8, 16, 32, 64])
def test_pack_round_trip(spark, bits):
    counts = {i: (i * 7) % 200 for i in range(50)}
    df = spark.createDataFrame(list(counts.items()), "bin bigint, n bigint")
    packed = df.groupBy(enc.pack_word(F.col("bin"), bits).alias("w")).agg(
        F.sum(enc.pack_value(F.col("n"), F.col("bin"), bits)).alias("p")
    )
    back = packed.select(F.explode(enc.unpack_word(F.col("w"), F.col("p"), bits)).alias("e")).select("e.*")
    assert {r.bin: r.n for r in back.collect() if r.bin in counts} == counts


def test_pack_rejects_overflow(spark):
    df = spark.createDataFrame([(0, 70000)], "bin bigint, n bigint")
    with pytest.raises(Exception, match="does not fit"):
        df.select(enc.pack_value(F.col("n"), F.col("bin"), 16)).collect()


def test_window_start_floors_negative_times(spark):
    ts = [-1, 0, 9999, 10000, -10000, -10001]
    got = spark.createDataFrame([(t,) for t in ts], "t bigint").select(tw.window_start(F.col("t"), 10000).alias("w"))
    assert [r.w for r in got.collect()] == [-10000, 0, 0, 10000, -10000, -20000]


def test_labels_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(3_723_000,)], "t bigint")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert df.select(tw.range_label(F.col("t"), F.col("t") + 1000).alias("l")).first().l == "W[01:02:03, 01:02:04)"
        ntz = spark.sql("select timestamp_ntz'2024-01-01 00:00:01' as ts").select(tw.millis(F.col("ts")).alias("m"))
        assert ntz.first().m == 1704067201000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

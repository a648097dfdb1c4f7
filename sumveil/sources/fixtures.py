"""The input views of the engine over the given tables (see FIXTURES.md).

Every view is a projection or a partially aggregated group-by of its table, so it
scales with the table and never gathers a key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumveil.functions.timewin import DAY_MS, floor_mod, idiv, millis, window_start
from sumveil.session import spread
from sumveil.sources.parts import PART, every_part, pair_part

W = DAY_MS
CLIQUE_SIZE = 16
#: Of a universe's producers: those that make a window full, and the fewest members.
FULL_PERCENT, LEAST_PERCENT = 89, 73
#: Universes of the graph masks: of every so many ids the first form a large one, the others a small one.
GRAPH_BLOCK, GRAPH_LARGE = 1200, 1100
#: Their windows: 365 days.
GRAPH_W = 365 * DAY_MS

# Event types in alphabetical order, numbering universes from 1.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# Lower bound and number of values of each vehicle attribute.
CAR_RANGES = {
    "vibrationVelocity": (0, 16),
    "vibrationDisplacement": (0, 120),
    "vibrationAcceleration": (0, 40),
    "soundPressure": (0, 120),
    "humidity": (0, 100),
    "speed": (0, 200),
    "fuelLevel": (0, 100),
    "tirePressure": (12, 28),
    "ambientAirTemperature": (-7, 47),
    "oilTemperature": (0, 160),
    "engineTemperature": (0, 100),
}

# The timings of a page and the factor each is derived with.
WEB_TIMINGS = {"pageNetworkTime": 1, "pageTransferTime": 3, "pageLoadTime": 7, "pageServerTime": 11}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _long(c):
    return c.cast("bigint")


def event_columns(events: DataFrame) -> DataFrame:
    """``std`` columns plus event_id and event_type, for batch and stream frames."""
    return events.select(
        F.lit(1).cast("bigint").alias("universe_id"),
        F.col("user_id").alias("producer_id"),
        millis(F.col("ts")).alias("ts_ms"),
        _long(F.floor("value")).alias("value"),
        _long(F.get_json_object("props", "$.k")).alias("y"),
        "event_id",
        "event_type",
    )


def std_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_columns(table(spark, sf, "events"))


def std(spark: SparkSession, sf: str) -> DataFrame:
    return std_events(spark, sf).select("universe_id", "producer_id", "ts_ms", "value", "y")


def std5(spark: SparkSession, sf: str) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type"))
    return std_events(spark, sf).withColumn("universe_id", _long(position)).drop("event_id", "event_type")


def cohort_std(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """``std`` with producers split into universes of ``size`` consecutive ids."""
    return std(spark, sf).withColumn("universe_id", idiv(F.col("producer_id"), size))


def _graph_universe(producer: Column) -> Column:
    return idiv(producer, GRAPH_BLOCK) * 2 + (floor_mod(producer, GRAPH_BLOCK) >= GRAPH_LARGE).cast("bigint")


def graph_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events of customers, in large and small universes."""
    key, customer = F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint")
    return table(spark, sf, "orders").select(
        _graph_universe(customer).alias("universe_id"), customer.alias("producer_id"),
        (millis(F.col("o_orderdate")) + floor_mod(key * 8, W)).alias("ts_ms"), floor_mod(key * 37 + customer, 491).alias("value"),
    )


def graph_universes(events: DataFrame) -> DataFrame:
    """Universes of ``graph_events`` with the fewest members they should have, a share of their producers."""
    sizes = events.groupBy("universe_id").agg(F.countDistinct("producer_id").alias("n"))
    return sizes.select("universe_id", idiv(F.col("n") * LEAST_PERCENT, 100).alias("min_size"), F.lit(0.5).alias("alpha"), F.lit(1e-5).alias("delta"))


def graph_pair_keys(events: DataFrame) -> DataFrame:
    """Test keys only: one 256-bit key per pair of producers of a graph universe, ``a < b``."""
    return graph_pairs(events).drop("part")


def graph_pairs(events: DataFrame) -> DataFrame:
    """``graph_pair_keys`` with the ``part`` of its universe that a pair lies in, dealt out and sorted by part and universe.

    Larger members come to every part, so that no pair is shuffled; the merge join on part and
    universe alone keeps where its rows lie and sorts members, not pairs.
    """
    a = F.col("producer_id")
    last = a - floor_mod(a, GRAPH_BLOCK) + F.when(floor_mod(a, GRAPH_BLOCK) < GRAPH_LARGE, GRAPH_LARGE - 1).otherwise(GRAPH_BLOCK - 1)
    members = _members(events).select(_graph_universe(a).alias("universe_id"), a.alias("a"), last.alias("_last"))
    smaller = spread(members.withColumn("part", pair_part(F.col("a"))), *PART)
    larger = spread(members.select("universe_id", F.col("a").alias("b"), F.explode(every_part()).alias("part")), *PART)
    pairs = smaller.join(larger.hint("merge"), PART).filter((F.col("a") < F.col("b")) & (F.col("b") <= F.col("_last")))
    return pairs.select("universe_id", "a", "b", _pair_key().alias("key"), "part")


def polar(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    a = F.pmod("l_orderkey", F.lit(99).cast("bigint")) - 49
    return li.select(
        F.lit(1).cast("bigint").alias("universe_id"),
        F.col("l_suppkey").alias("producer_id"),
        (millis(F.col("l_shipdate")) + floor_mod(F.col("l_orderkey") * 8 + F.col("l_linenumber"), W)).alias("ts_ms"),
        (60 + _long(F.floor("l_quantity"))).alias("heartrate"),
        (floor_mod(F.col("l_partkey") * 37, 3100) - 100).alias("altitude"),
        floor_mod(F.col("l_orderkey"), 44).alias("speed"),
        F.greatest(a, F.lit(0).cast("bigint")).alias("ascent"),
        F.greatest(-a, F.lit(0).cast("bigint")).alias("descent"),
        (floor_mod(F.col("l_partkey"), 51) - 10).alias("temperature"),
    )


def car(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.lit(1).cast("bigint").alias("universe_id"),
        F.col("l_suppkey").alias("producer_id"),
        (millis(F.col("l_shipdate")) + floor_mod(F.col("l_orderkey") * 8 + F.col("l_linenumber"), W)).alias("ts_ms"),
        *[
            (floor_mod(F.col("l_orderkey") * c + F.col("l_partkey"), width) + low).alias(name)
            for c, (name, (low, width)) in enumerate(CAR_RANGES.items(), start=1)
        ],
    )


def web(spark: SparkSession, sf: str) -> DataFrame:
    """Nine ``map<string,int>`` columns per event."""
    e = std_events(spark, sf).select(
        "universe_id", "producer_id", "ts_ms", "value", F.col("y").alias("k"),
        floor_mod(F.col("producer_id"), 3).alias("start"),
    )
    e = e.withColumn("page", F.when(F.col("k") == F.col("start"), floor_mod(F.col("k") + 1, 100)).otherwise(F.col("k")))
    e = e.withColumn("x", idiv(F.col("k"), 5)).withColumn("gy", floor_mod(F.col("k"), 11))
    s = lambda c: F.col(c).cast("string")
    one = F.lit(1).cast("int")
    cell = F.concat_ws("_", s("start"), s("x"), s("gy"))
    below = F.concat_ws("_", s("start"), s("x"), (F.col("gy") + 1).cast("string"))
    return e.select(
        "universe_id", "producer_id", "ts_ms",
        F.create_map(F.concat_ws("_", s("start"), s("page")), one).alias("pageUserFlow"),
        F.create_map(s("start"), one).alias("pageExit"),
        F.create_map(s("page"), one).alias("pageView"),
        *[
            F.create_map(s("page"), floor_mod(F.col("value") * f, 1000).cast("int")).alias(name)
            for name, f in WEB_TIMINGS.items()
        ],
        F.create_map(cell, one).alias("clickGrid"),
        F.when(F.col("gy") < 10, F.create_map(cell, one, below, one)).otherwise(F.create_map(cell, one)).alias("hoverGrid"),
    )


def std_universes(spark: SparkSession, sf: str) -> DataFrame:
    """The universes of ``std`` with the producers that make a window full, and the fewest
    members a universe should have: shares of all its producers."""
    sizes = std(spark, sf).groupBy("universe_id").agg(F.countDistinct("producer_id").alias("size"))
    share = lambda percent: idiv(F.col("size") * percent, 100)
    return sizes.select("universe_id", share(FULL_PERCENT).alias("full_size"), share(LEAST_PERCENT).alias("min_size"), F.lit(W).cast("bigint").alias("window_ms"))


def commits(events: DataFrame, size_ms: int = W) -> DataFrame:
    """One commit per (producer, window) with an arrival time; some producers skip even windows."""
    ws = F.col("ws") if "ws" in events.columns else window_start(F.col("ts_ms"), size_ms)
    seen = events.select("universe_id", "producer_id", ws.alias("ws")).distinct()
    skips = (F.col("producer_id") % 10 == 7) & (idiv(F.col("ws"), size_ms) % 2 == 0)
    return seen.filter(~skips).withColumn("commit_ts", F.col("ws") + size_ms + 1000 * (F.col("producer_id") % 8))


def stream_keys(events: DataFrame) -> DataFrame:
    """Test keys only: one 256-bit key per producer."""
    return events.select("producer_id").distinct().withColumn(
        "key", F.unhex(F.sha2(F.col("producer_id").cast("string"), 256))
    )


def pair_keys(events: DataFrame, size: int) -> DataFrame:
    """Test keys only: one 256-bit key per pair of producers of a cohort, ``a < b``.

    A cohort is ``size`` consecutive ids, so a member meets at most ``size - 1``
    others and the table grows linearly with the number of producers.
    """
    cohort_end = (idiv(F.col("producer_id"), size) + 1) * size - 1
    return _pairs(_members(events), idiv(F.col("producer_id"), size), cohort_end)


def _members(events: DataFrame) -> DataFrame:
    """Producer ids, kept apart: pairs and keys cost far more than ids.

    They are spread before they are made distinct; afterwards Spark would drop the
    repartition as one it already has, and merge its few bytes into one task.
    """
    return spread(events.select("producer_id"), "producer_id").distinct()


def _pairs(members: DataFrame, universe: Column, last: Column) -> DataFrame:
    pairs = members.filter(F.col("producer_id") < last).select(
        universe.alias("universe_id"),
        F.col("producer_id").alias("a"),
        F.explode(F.sequence(F.col("producer_id") + 1, last)).alias("b"),
    )
    known = pairs.join(members.select(F.col("producer_id").alias("b")), "b", "left_semi")
    return known.select("universe_id", "a", "b", _pair_key().alias("key"))


def _pair_key() -> Column:
    return F.unhex(F.sha2(F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string")), 256))


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-order records: an ordered log of four partitions."""
    return table(spark, sf, "orders").select(
        floor_mod(F.col("o_custkey"), 4).alias("partition"),
        F.col("o_custkey").alias("producer_id"),
        F.col("o_orderkey").alias("seq"),
        millis(F.col("o_orderdate")).alias("ts_ms"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One result row per (run, kind, window), as a benchmark run leaves them."""
    kind = F.when(F.col("event_type").isin("click", "view"), "plain").otherwise("private")
    return (
        std_events(spark, sf)
        .groupBy(F.col("producer_id").alias("run"), kind.alias("kind"), window_start(F.col("ts_ms"), W).alias("ws"))
        .agg(F.max("value").alias("latency_ms"), F.count("*").alias("n"))
    )


def universes(spark: SparkSession, sf: str) -> DataFrame:
    """A universe per nation (1000 + key), per region (100 + key) and over all (0).

    The members are the customers, so universe sizes follow the table.
    """
    sizes = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    placed = sizes.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    region, nation = F.col("n_regionkey"), F.col("n_nationkey")
    uid = F.when(region.isNull(), 0).when(nation.isNull(), 100 + region).otherwise(1000 + nation)
    return (
        placed.rollup("n_regionkey", "n_nationkey")
        .agg(F.sum("n").alias("min_size"))
        .select(
            _long(uid).alias("universe_id"), "min_size", F.lit(W).cast("bigint").alias("window_ms"),
            F.lit(0.5).alias("alpha"), F.lit(1e-5).alias("delta"),
        )
    )

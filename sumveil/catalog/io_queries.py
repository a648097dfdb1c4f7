"""Queries on sources and sinks; what they write goes to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumveil.catalog.registry import query
from sumveil.catalog.sqlviews import DAY, with_views, ws
from sumveil.functions import timewin as tw
from sumveil.operators import chain
from sumveil.operators.aggregate import population_sums
from sumveil.catalog.window_queries import _producer_sums
from sumveil.plans import profiles as pf
from sumveil.session import scratch_dir, spread_files
from sumveil.sources import fixtures as fx, records as rec
from sumveil.streaming import windows as st

W = fx.W
YEAR = 360 * DAY


@query("S1", with_views(["stdw"], "SELECT ws, count(*) AS n, count(DISTINCT producer_id) AS producers FROM stdw GROUP BY ws"))
def src_plain(spark, sf):
    per_producer = chain.with_window(fx.std(spark, sf), W).groupBy("ws", "producer_id").agg(F.count("*").alias("n"))
    return per_producer.groupBy("ws").agg(F.sum("n").alias("n"), F.count("*").alias("producers"))


_PREV = "SELECT *, coalesce(lag(ts_ms) OVER (PARTITION BY producer_id, ws ORDER BY ts_ms), ws - 1) AS prev_ts FROM stdw"


@query("S2 S8 F1", with_views(["stdw"], f"""
    SELECT ws, count(*) AS n, sum(ts_ms - prev_ts)::BIGINT AS covered, sum(value)::BIGINT AS s
    FROM ({_PREV}) WHERE event_type <> 'error' GROUP BY ws"""))
def src_cipher_header(spark, sf):
    """Records written with an explicit time and header, read back with the header merged in."""
    df = chain.with_previous(fx.std_events(spark, sf), W)
    value = F.when(F.col("event_type") != "error", F.to_json(F.struct("value")))
    out = rec.to_records(df, F.col("producer_id"), value, F.col("ts_ms"), F.col("prev_ts"), F.lit("u1"))
    path = scratch_dir(spark, "records")
    out.write.parquet(path)
    back = rec.from_records(spark.read.parquet(path), "value bigint")
    return back.groupBy(tw.window_start(F.col("ts_ms"), W).alias("ws")).agg(
        F.count("*").alias("n"), F.sum(F.col("ts_ms") - F.col("prev_ts")).alias("covered"), F.sum("value.value").alias("s")
    )


@query("S4", with_views(["stdw"], "SELECT ws, count(*) AS n, sum(value)::BIGINT AS s FROM stdw GROUP BY ws"))
def src_bounded_batches(spark, sf):
    """A stream read in bounded micro-batches gives the rows of one read."""
    path = scratch_dir(spark, "batches")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fx.std(spark, sf).repartition(n, "producer_id", "ts_ms").write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    rows = st.run_to_table(st.read_stream(spark, path, max_files=max(1, n // 4)), "bounded")
    return rows.groupBy(tw.window_start(F.col("ts_ms"), W).alias("ws")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))


@query("S5 F9", with_views(["std5"], f"""
    SELECT universe_id, {ws('ts_ms')} AS ws, sum(value)::BIGINT AS s, count(*) AS n FROM std5 WHERE universe_id IN (1, 3, 4) GROUP BY ALL"""))
def results_read(spark, sf):
    """Results of some universes, drained from a stream of result files."""
    results = fx.std5(spark, sf).groupBy("universe_id", tw.window_start(F.col("ts_ms"), W).alias("ws")).agg(
        F.sum("value").alias("s"), F.count("*").alias("n")
    )
    path = scratch_dir(spark, "results")
    results.write.parquet(path)
    return st.run_to_table(st.read_stream(spark, path).filter(F.col("universe_id").isin(1, 3, 4)), "wanted")


_TRACE = ["heartrate", "altitude", "speed", "ascent", "descent", "temperature"]


@query("S6 P2", with_views(["polar"], f"""
    SELECT trace, sum(n)::BIGINT AS n, count(*) AS times, """ + ", ".join(f"sum({a})::BIGINT AS {a}" for a in _TRACE) + f"""
    FROM (SELECT trace, ts_ms, count(*) AS n, """ + ", ".join(f"sum({a}) AS {a}" for a in _TRACE) + f"""
          FROM (SELECT *, {ws('ts_ms', YEAR)} AS trace, min(ts_ms) OVER (PARTITION BY {ws('ts_ms', YEAR)}) AS first FROM polar)
          WHERE ts_ms <= first + {180 * DAY} GROUP BY ALL) GROUP BY trace"""))
def csv_polar_roundtrip(spark, sf):
    """Trace files written and read; ``times`` below ``n`` shows times that repeat."""
    df = fx.polar(spark, sf).select(
        tw.window_start(F.col("ts_ms"), YEAR).alias("trace"), F.col("ts_ms").alias("timestamp"), *_TRACE
    )
    path = scratch_dir(spark, "trace")
    rec.write_trace(df, path, ["trace"])
    back = rec.within_time(rec.read_trace(spark, path, "trace bigint"), "timestamp", 180 * DAY, ["trace"])
    per_time = spread_files(back, path, "trace", "timestamp").groupBy("trace", "timestamp").agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in _TRACE])
    return per_time.groupBy("trace").agg(
        F.sum("n").alias("n"), F.count("*").alias("times"), *[F.sum(a).alias(a) for a in _TRACE]
    )


@query("S7", with_views(["polar"], """
    SELECT CASE WHEN heartrate % 13 = 0 THEN 'malformed' WHEN heartrate % 11 = 0 THEN 'out of range' ELSE 'good' END AS outcome,
           count(*) AS n FROM polar GROUP BY ALL"""))
def bad_record_split(spark, sf):
    """Lines that do not parse and values off their axis go to quarantine."""
    hr = F.col("heartrate")
    shown = F.when(hr % 13 == 0, F.lit("x")).when(hr % 11 == 0, (hr + 1000).cast("string")).otherwise(hr.cast("string"))
    line = F.concat_ws(";", F.col("ts_ms").cast("string"), shown, *[F.col(a).cast("string") for a in _TRACE[1:]])
    path = scratch_dir(spark, "lines")
    fx.polar(spark, sf).select(line.alias("value")).write.text(path)
    good, malformed = rec.read_trace_lines(spark, path)
    fits = F.when(pf.in_range(pf.POLAR), "good").otherwise("out of range")
    rows = good.select(fits.alias("outcome")).unionByName(malformed.select(F.lit("malformed").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


@query("S10", with_views(["std"], f"""
    SELECT universe_id, {ws('ts_ms')} AS ws, sum(value)::BIGINT AS s, sum(value * value)::BIGINT AS q, count(*) AS n, true AS emitted_after_window
    FROM std GROUP BY ALL"""))
def results_restamped(spark, sf):
    """Population sums with the time they were emitted at, which is after the window's end."""
    stamped = rec.restamp(population_sums(_producer_sums(spark, sf), ["s", "q", "n"]))
    after = F.unix_millis("emitted_at") >= F.col("ws") + W
    return stamped.select("universe_id", "ws", "s", "q", "n", after.alias("emitted_after_window"))


@query("S11 S8", with_views(["std5"], f"SELECT 'u' || universe_id || '-results' AS topic, {ws('ts_ms')} AS ws, count(*) AS n FROM std5 GROUP BY ALL"))
def routed_sink_counts(spark, sf):
    """The topic is chosen per row."""
    df = fx.std5(spark, sf).select(
        F.format_string("u%d-results", "universe_id").alias("topic"), tw.window_start(F.col("ts_ms"), W).alias("ws")
    )
    path = scratch_dir(spark, "routed")
    rec.write_routed(df, path, "topic")
    return spark.read.parquet(path).groupBy("topic", "ws").agg(F.count("*").alias("n"))


@query("S12", with_views(["psums"], "SELECT producer_id % 8 AS partition, count(*) AS n, sum(s)::BIGINT AS s FROM psums GROUP BY ALL"))
def direct_partition_counts(spark, sf):
    """Rows are placed by key mod partitions; the physical partition is what comes out."""
    placed = rec.direct_partition(_producer_sums(spark, sf), "producer_id", 8)
    return placed.withColumn("partition", F.spark_partition_id().cast("bigint")).groupBy("partition").agg(
        F.count("*").alias("n"), F.sum("s").alias("s")
    )


@query("S15 S14 A8", with_views(["runs"], "SELECT run, kind, ws, latency_ms, n FROM runs"))
def bench_json_flatten(spark, sf):
    """Reports of nested JSON written and flattened; a report covers thirty days, so thirty entries at most."""
    runs = fx.runs(spark, sf)
    month = tw.window_start(F.col("ws"), 30 * DAY)
    entry = F.struct("ws", "latency_ms", "n")
    reports = runs.groupBy("run", "kind", month.alias("month")).agg(F.sort_array(F.collect_list(entry)).alias("data"))
    path = scratch_dir(spark, "reports")
    reports.select(F.struct("run", "kind").alias("config"), "data").write.json(path)
    return rec.read_report(spark, path, "run bigint, kind string", "ws bigint, latency_ms bigint, n bigint")

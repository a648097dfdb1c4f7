"""Structured Streaming forms of the windowed aggregates.

Windows close by watermark (event time less grace) and come out once, in append
mode.  Stages chain: producer sums feed population sums or a stream-stream join.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumveil.session import scratch_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A parquet table as a stream of its files, at most ``max_files`` per micro-batch.

    The table may be one file or a folder; as a glob the stream source takes both.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def kafka_stream(spark: SparkSession, servers: str, topics: str, max_offsets: int | None = None) -> DataFrame:
    """Records of many topics from the earliest offset, with headers; needs the Kafka connector."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", topics)
        .option("startingOffsets", "earliest").option("includeHeaders", "true")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def timed(df: DataFrame, grace_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Event time and watermark from a millisecond column."""
    return df.withColumn("event_time", F.timestamp_millis(F.col(ts))).withWatermark("event_time", f"{grace_ms} milliseconds")


def _window(size_ms: int, col="event_time") -> Column:
    return F.window(col, f"{size_ms} milliseconds")


def _with_start(df: DataFrame) -> DataFrame:
    return df.withColumn("ws", F.unix_millis("window.start")).drop("window")


def producer_sums(df: DataFrame, size_ms: int, measures: dict[str, Column]) -> DataFrame:
    """Sums per (universe, producer, window) of a timed stream."""
    return df.groupBy("universe_id", "producer_id", _window(size_ms)).agg(*[F.sum(c).alias(n) for n, c in measures.items()])


def population_sums(sums: DataFrame, size_ms: int, measures: list[str]) -> DataFrame:
    """Population sums per window out of producer sums: a second, chained stage."""
    return sums.groupBy("universe_id", _window(size_ms, F.window_time("window"))).agg(
        *[F.sum(m).alias(m) for m in measures], F.count("*").alias("producers")
    )


def commit_join(sums: DataFrame, commits: DataFrame, size_ms: int, grace_ms: int) -> DataFrame:
    """Stream-stream join of producer sums with commits; either side may come first.

    Both sides carry the window's last instant as event time, so the watermark
    bounds how long an unmatched row is kept.
    """
    last = F.timestamp_micros((F.col("ws") + size_ms) * 1000 - 1)
    c = (
        commits.select(F.col("universe_id").alias("cu"), F.col("producer_id").alias("cp"), last.alias("c_time"))
        .withWatermark("c_time", f"{grace_ms} milliseconds")
    )
    s = sums.withColumn("s_time", F.window_time("window"))
    on = (F.col("universe_id") == F.col("cu")) & (F.col("producer_id") == F.col("cp")) & (F.col("s_time") == F.col("c_time"))
    return s.join(c, on).drop("cu", "cp", "c_time", "s_time")


@contextmanager
def state_store(spark: SparkSession, provider: str | None):
    """Use a state store provider for queries started inside the block."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if provider is None:
        yield
        return
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(
    df: DataFrame, purpose: str, mode: str = "append", folder: str | None = None, provider: str | None = None,
) -> DataFrame:
    """Drain the stream's available input into a parquet table and read it back.

    Started again on the same ``folder`` it goes on from the checkpoint.
    """
    spark = df.sparkSession
    folder = folder or scratch_dir(spark, purpose)
    start(df, folder, mode, provider, availableNow=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def start(df: DataFrame, folder: str, mode: str = "append", provider: str | None = None, **trigger):
    """Start a query into ``folder/rows`` with its checkpoint in ``folder/state``.

    A query with processing-time timers never runs out of work: give it a
    ``processingTime`` trigger and stop it from outside.
    """
    with state_store(df.sparkSession, provider):
        return (
            df.writeStream.format("parquet").outputMode(mode)
            .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
            .trigger(**trigger).start()
        )


def with_start(df: DataFrame) -> DataFrame:
    """Replace the window struct by its start in milliseconds."""
    return _with_start(df)

"""Sources and sinks: keyed records with headers, CSV traces, JSON reports, routed output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a fitness trace line.
TRACE_COLUMNS = ["timestamp", "heartrate", "altitude", "speed", "ascent", "descent", "temperature"]
TRACE_SCHEMA = ", ".join(f"{c} bigint" for c in TRACE_COLUMNS)
HEADER = "heac"


def to_records(df: DataFrame, key: Column, value: Column, ts_ms: Column, header: Column, topic: Column) -> DataFrame:
    """Rows in the layout of a message sink: topic, key, value, timestamp, headers.

    The same frame goes to ``format("kafka")`` or to files.
    """
    return df.select(
        topic.alias("topic"), key.cast("string").cast("binary").alias("key"), value.cast("binary").alias("value"),
        F.timestamp_millis(ts_ms).alias("timestamp"),
        F.array(F.struct(F.lit(HEADER).alias("key"), header.cast("string").cast("binary").alias("value"))).alias("headers"),
    )


def from_records(records: DataFrame, value_schema: str) -> DataFrame:
    """Values with key, time and the previous time out of the header; empty values are dropped."""
    text = lambda c: c.cast("string")
    prev = F.filter("headers", lambda h: h["key"] == HEADER)[0]["value"]
    return (
        records.filter(F.col("value").isNotNull())
        .select(
            text(F.col("key")).cast("bigint").alias("producer_id"), F.unix_millis("timestamp").alias("ts_ms"),
            text(prev).cast("bigint").alias("prev_ts"), F.from_json(text(F.col("value")), value_schema).alias("value"),
        )
        .filter(F.col("value").isNotNull())
    )


def write_trace(df: DataFrame, path: str, partition: list[str]) -> None:
    """Semicolon lines without a header.

    A writer sorts its rows by folder, so rows are first dealt into parts of a moderate size.
    """
    df.hint("rebalance", "timestamp").write.partitionBy(*partition).option("sep", ";").csv(path)


def read_trace(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    return spark.read.schema(TRACE_SCHEMA + (", " + extra if extra else "")).option("sep", ";").csv(path)


def read_trace_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and malformed lines of a trace; nothing is lost and nothing stops the job."""
    parsed = F.from_csv(
        F.col("value"), TRACE_SCHEMA + ", _corrupt string",
        {"sep": ";", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    rows = spark.read.text(path).select("value", parsed.alias("_r"))
    broken = F.col("_r._corrupt").isNotNull()
    good = rows.filter(~broken).select("_r.*").drop("_corrupt")
    return good, rows.filter(broken).select(F.col("value").alias("line"))


def within_time(df: DataFrame, ts: str, limit_ms: int, keys: list[str]) -> DataFrame:
    """Rows up to a time limit after the trace's first one."""
    first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
    return df.join(first, keys).filter(F.col(ts) <= F.col("_first") + limit_ms).drop("_first")


# The kinds of a token record; exactly one field named after a kind is set.
TOKEN_KINDS = ("transformation", "commit", "status")
TOKEN_SCHEMA = (
    "universe_id bigint, producer_id bigint, ws bigint, kind string, "
    "transformation array<bigint>, commit struct<start:bigint,end:bigint>, status int"
)


def token_record(kind: str, value: Column) -> list[Column]:
    """Columns of a token record of one kind, besides its window key."""
    fields = {f.split(" ")[0]: f.split(" ", 1)[1] for f in TOKEN_SCHEMA.split(", ")[4:]}
    return [F.lit(kind).alias("kind"), *[(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in fields.items()]]


def well_formed(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Token records that carry exactly the one variant their kind names, and the others."""
    one = sum((F.col(k).isNotNull().cast("int") for k in TOKEN_KINDS), F.lit(0)) == 1
    named = F.coalesce(F.element_at(F.array(*[F.col(k).isNotNull() for k in TOKEN_KINDS]), F.array_position(F.array(*map(F.lit, TOKEN_KINDS)), F.col("kind")).cast("int")), F.lit(False))
    known = F.col("kind").isin(*TOKEN_KINDS)
    good = F.coalesce(known, F.lit(False)) & one & F.when(known, named).otherwise(False)
    return tokens.filter(good), tokens.filter(~good)


def restamp(df: DataFrame) -> DataFrame:
    """Results carry the time they were emitted at."""
    return df.withColumn("emitted_at", F.current_timestamp())


def write_routed(df: DataFrame, path: str, route: str) -> None:
    """One folder (topic) per value of the route column; rows are routed where they are."""
    df.write.partitionBy(route).parquet(path)


def direct_partition(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Place rows by ``key mod partitions`` exactly, without hashing."""
    return df.repartitionById(partitions, F.pmod(F.col(key), F.lit(partitions).cast("bigint")).cast("int"))


def read_report(spark: SparkSession, path: str, config: str, data: str) -> DataFrame:
    """Reports ``{config, data[]}``, one row per data entry."""
    df = spark.read.schema(f"config struct<{config}>, data array<struct<{data}>>").json(path)
    return df.select("config.*", F.explode("data").alias("_d")).select("*", "_d.*").drop("_d")

"""Reports over result, membership and benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumveil.operators.history import trim_runs
from sumveil.operators.scan import frequencies, quantile_of_frequencies
from sumveil.session import materialize

# Fields of each encoding with ten buckets, 8-byte words, 16-byte header.
ENCODING_FIELDS = {"sum": 1, "count": 1, "avg": 2, "var": 3, "hist": 10, "max": 10, "min": 10, "reg": 5}
WORD, HEADER = 8, 16


def latency_stats(df: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """Count, mean, exact median, extremes and sample deviation of an integer latency."""
    counts = frequencies(df, keys, value)
    x, c = F.col(value), F.col("_n")
    exact = x.cast("decimal(12,0)")
    basic = counts.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(exact * c).alias("_s"), F.sum(exact * exact * c).alias("_q"),
        F.min(x).alias("min_ms"), F.max(x).alias("max_ms"),
    )
    n, s, q = (F.col(c).cast("double") for c in ("n", "_s", "_q"))
    # Exact sums make the deviation independent of the order of rows; products have 38 digits.
    wide = lambda a, b: F.col(a).cast("decimal(38,0)") * F.col(b).cast("decimal(38,0)")
    deviation = F.when(F.col("n") > 1, F.sqrt((wide("n", "_q") - wide("_s", "_s")).cast("double") / (n * (n - 1))))
    median = quantile_of_frequencies(counts, keys, value, 0.5, out="median_ms")
    return basic.select(
        *keys, "n", (s / n).alias("mean_ms"), "min_ms", "max_ms", deviation.alias("stdev_ms")
    ).join(median, keys)


def latency_comparison(runs: DataFrame, grace_ms: int) -> DataFrame:
    """Private against plain latency per run: trimmed, less grace, with difference and factor."""
    trimmed = trim_runs(materialize(runs, "runs"), ["run", "kind"]).withColumn("latency_ms", F.col("latency_ms") - grace_ms)
    stats = latency_stats(trimmed, ["run", "kind"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(f"{c}_ms"))).alias(f"{c}_{kind}")
    both = stats.groupBy("run").agg(*[of(kind, c) for kind in ("private", "plain") for c in ("mean", "median")])
    return both.withColumn("difference", F.col("median_private") - F.col("median_plain")).withColumn(
        "factor", F.when(F.col("median_plain") != 0, F.col("median_private") / F.col("median_plain"))
    )


def throughputs(runs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Operations a second per key: records over the time they took, null where that is none."""
    seconds = F.sum("latency_ms") / 1000.0
    return runs.groupBy(*keys).agg(F.when(seconds > 0, F.sum("n") / seconds).alias(name))


def rate_report(encode: DataFrame, both: DataFrame, keys: list[str]) -> DataFrame:
    """Throughputs (ops/s) of encode and encode+encrypt to run times and shares."""
    j = encode.join(both, keys, "full_outer")
    rt_encode, rt_both = 1e6 / F.col("tp_encode"), 1e6 / F.col("tp_encode_encrypt")
    share = rt_encode / rt_both
    return j.select(
        *keys, rt_encode.alias("rt_encode_us"), (rt_both - rt_encode).alias("rt_encrypt_us"),
        F.round(share, 2).alias("encode_share"), F.round(1 - share, 2).alias("encrypt_share"),
    )


def encoding_sizes(record_counts: DataFrame, count: str = "n") -> DataFrame:
    """Bytes on the wire and expansion over a plain record, per encoding, for actual record counts."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(e).alias("encoding"), F.lit(f).cast("bigint").alias("fields")) for e, f in ENCODING_FIELDS.items()
    ]))
    size = F.col("_e.fields") * WORD + HEADER
    return record_counts.select("*", rows.alias("_e")).select(
        *[c for c in record_counts.columns if c != count],
        F.col("_e.encoding").alias("encoding"), size.alias("record_bytes"), (F.col(count) * size).alias("total_bytes"),
        (size / F.lit(float(HEADER))).alias("expansion"),
    )


def traffic(diffs_per_window: DataFrame, n_lanes: int) -> DataFrame:
    """Bytes between one controller and the server per window: commit trigger, commit, token trigger, token."""
    changes = F.col("added") + F.col("dropped")
    window, ident = 16, 8
    bytes_ = window + (window + ident) + (window + changes * ident) + (ident + window + n_lanes * WORD)
    return diffs_per_window.select("universe_id", "ws", changes.alias("diffs"), bytes_.cast("bigint").alias("bytes"))


def churn_type(added: Column, dropped: Column) -> Column:
    return (
        F.when((added == 0) & (dropped > 0), "dropped")
        .when((added > 0) & (dropped == 0), "returned")
        .when((added > 0) & (dropped > 0), "combined")
        .otherwise("none")
    )


def membership_history(sizes: DataFrame, universes: DataFrame) -> DataFrame:
    """Universe size per window next to the minimum in ``universes(universe_id, min_size)``."""
    return sizes.join(universes.select("universe_id", "min_size"), "universe_id").select(
        "universe_id", "ws", "members", "min_size", (F.col("members") < F.col("min_size")).alias("below_threshold"),
    )


def report_json(rows: DataFrame, config: dict[str, str], keys: list[str]) -> DataFrame:
    """Result rows as JSON lines that carry the run's settings."""
    settings = F.struct(*[F.lit(v).alias(k) for k, v in config.items()])
    data = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.select(*keys, F.to_json(F.struct(settings.alias("config"), data.alias("data"))).alias("json"))

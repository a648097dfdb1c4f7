"""Queries behind reports, and the parameters of random graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumveil.catalog.registry import query
from sumveil.catalog.sqlviews import DAY, with_views
from sumveil.catalog.window_queries import committed, committed_sum, diffs
from sumveil.operators import chain, membership as mb
from sumveil.plans import parameters as pm, reports as rp
from sumveil.session import materialize
from sumveil.sources import fixtures as fx

W = fx.W
GRACE_MS = 5


@query("A8", with_views(["runs"], """
    SELECT kind, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, median(latency_ms)::DOUBLE AS median_ms,
           min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(stddev_samp(latency_ms), 6) AS stdev_ms
    FROM runs GROUP BY kind"""))
def latency_stats(spark, sf):
    s = rp.latency_stats(fx.runs(spark, sf), ["kind"])
    return s.withColumn("mean_ms", F.round("mean_ms", 6)).withColumn("stdev_ms", F.round("stdev_ms", 6))


_TRIMMED = f"""
    SELECT run, kind, latency_ms - {GRACE_MS} AS latency FROM (
        SELECT *, count(*) OVER (PARTITION BY run, kind) AS kept FROM (
            SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run, kind ORDER BY ws) > 2
                               AND row_number() OVER (PARTITION BY run, kind ORDER BY ws DESC) > 2)) WHERE kept >= 8"""


@query("R1 J8 F7 O4 X6", with_views(["runs"], f"""
    SELECT run, round(a.mean, 6) AS mean_private, a.median AS median_private, round(b.mean, 6) AS mean_plain, b.median AS median_plain,
           a.median - b.median AS difference, round(CASE WHEN b.median <> 0 THEN a.median / b.median END, 6) AS factor
    FROM (SELECT run, avg(latency) AS mean, median(latency)::DOUBLE AS median FROM ({_TRIMMED}) WHERE kind = 'private' GROUP BY run) a
    FULL OUTER JOIN (SELECT run, avg(latency) AS mean, median(latency)::DOUBLE AS median FROM ({_TRIMMED}) WHERE kind = 'plain' GROUP BY run) b
    USING (run)"""))
def bench_compare(spark, sf):
    c = rp.latency_comparison(fx.runs(spark, sf), GRACE_MS)
    rounded = {x: F.round(x, 6) for x in ("mean_private", "mean_plain", "factor")}
    return c.withColumns(rounded).orderBy("run")


_RATE = "SELECT run, CASE WHEN sum(latency_ms) > 0 THEN sum(n)::DOUBLE / (sum(latency_ms)::DOUBLE / 1000.0::DOUBLE) END AS tp FROM runs WHERE kind = '{}' GROUP BY run"


@query("R2 J8 O4", with_views(["runs"], f"""
    SELECT run, round(1e6 / a.tp, 4) AS rt_encode_us, round(1e6 / b.tp - 1e6 / a.tp, 4) AS rt_encrypt_us,
           round((1e6 / a.tp) / (1e6 / b.tp), 2) AS encode_share, round(1 - (1e6 / a.tp) / (1e6 / b.tp), 2) AS encrypt_share
    FROM ({_RATE.format('plain')}) a FULL OUTER JOIN ({_RATE.format('private')}) b USING (run)"""))
def rate_report(spark, sf):
    """Plain runs encode, private ones encode and encrypt."""
    runs = materialize(fx.runs(spark, sf), "runs")
    rates = lambda kind, name: rp.throughputs(runs.filter(F.col("kind") == kind), ["run"], name)
    r = rp.rate_report(rates("plain", "tp_encode"), rates("private", "tp_encode_encrypt"), ["run"])
    return r.withColumns({c: F.round(c, 4) for c in ("rt_encode_us", "rt_encrypt_us")})


@query("R3", with_views(["stdw"], """
    SELECT universe_id, ws, encoding, fields * 8 + 16 AS record_bytes, n * (fields * 8 + 16) AS total_bytes,
           (fields * 8 + 16)::DOUBLE / 16 AS expansion
    FROM (SELECT universe_id, ws, count(*) AS n FROM stdw GROUP BY ALL),
         (VALUES ('sum', 1::BIGINT), ('count', 1), ('avg', 2), ('var', 3), ('hist', 10), ('max', 10), ('min', 10), ('reg', 5)) e(encoding, fields)"""))
def encoding_size(spark, sf):
    counts = chain.with_window(fx.std(spark, sf), W).groupBy("universe_id", "ws").agg(F.count("*").alias("n"))
    return rp.encoding_sizes(counts)


@query("R4", with_views(["committed", "diffs"], """
    SELECT universe_id, ws, coalesce(d, 0) AS diffs, 16 + 24 + 16 + 8 * coalesce(d, 0) + 24 + 24 AS bytes
    FROM (SELECT DISTINCT universe_id, ws FROM committed) LEFT JOIN (SELECT universe_id, ws, count(*) AS d FROM diffs GROUP BY ALL) USING (universe_id, ws)"""))
def traffic_report(spark, sf):
    present = committed(spark, sf)
    windows = present.select("universe_id", "ws").distinct()
    counts = windows.join(mb.diff_counts(mb.membership_diff(present, W)), ["universe_id", "ws"], "left").na.fill(0)
    return rp.traffic(counts, 3)


def _parameters(spark, sf):
    return pm.graph_parameters(fx.universes(spark, sf))


@query("K11", with_views(["parameters"], "SELECT universe_id, members, k, w, rounds, round(expected_degree, 4) AS expected_degree FROM parameters"))
def graph_parameters(spark, sf):
    return _parameters(spark, sf).withColumn("expected_degree", F.round("expected_degree", 4))


@query("R5", with_views(["parameters"], """
    SELECT universe_id, members, k, round(members * 32 / 1000, 4) AS keys_kb,
           round(members * 32 / 1000 + (128 / k) * members * 8 / 1000, 4) AS total_kb FROM parameters"""))
def storage_report(spark, sf):
    return pm.storage_report(_parameters(spark, sf)).withColumns({c: F.round(c, 4) for c in ("keys_kb", "total_kb")})


@query("R6", with_views(["parameters"], """
    SELECT universe_id, members, k, rounds, degree, rounds * degree + members - 1 AS graph_prf, rounds * degree AS graph_add,
           rounds * (degree + members - 1) AS sampled_prf, rounds * degree AS sampled_add,
           rounds * (members - 1) AS clique_prf, rounds * (members - 1) AS clique_add
    FROM (SELECT *, round(expected_degree)::BIGINT AS degree FROM parameters WHERE k IS NOT NULL)"""))
def mask_cost_report(spark, sf):
    return pm.mask_cost_report(_parameters(spark, sf))


@query("R7", with_views(["diffs"], """
    SELECT universe_id, ws, added, dropped, CASE WHEN added = 0 AND dropped > 0 THEN 'dropped' WHEN added > 0 AND dropped = 0 THEN 'returned'
           WHEN added > 0 AND dropped > 0 THEN 'combined' ELSE 'none' END AS type
    FROM (SELECT universe_id, ws, count(*) FILTER (diff = 1) AS added, count(*) FILTER (diff = -1) AS dropped FROM diffs GROUP BY ALL)"""))
def churn_type(spark, sf):
    return mb.diff_counts(diffs(spark, sf)).withColumn("type", rp.churn_type(F.col("added"), F.col("dropped")))


@query("R8 A9", with_views(["diffs", "stduniverses"], """
    SELECT universe_id, ws, members, min_size, members < min_size AS below_threshold FROM (
        SELECT universe_id, ws, sum(sum(diff)) OVER (PARTITION BY universe_id ORDER BY ws)::BIGINT AS members FROM diffs GROUP BY universe_id, ws)
    JOIN stduniverses USING (universe_id)"""))
def membership_history(spark, sf):
    return rp.membership_history(mb.universe_size(diffs(spark, sf)), fx.std_universes(spark, sf))


@query("S14", with_views(["csum"], f"""
    SELECT universe_id, ws, '{{"config":{{"application":"standard","window_ms":"{DAY}"}},"data":{{"s":' || s || ',"n":' || n || '}}}}' AS json FROM csum"""))
def report_json(spark, sf):
    rows = committed_sum(spark, sf).select("universe_id", "ws", "s", "n")
    return rp.report_json(rows, {"application": "standard", "window_ms": str(W)}, ["universe_id", "ws"])

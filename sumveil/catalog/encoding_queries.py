"""Queries on encodings and application profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumveil.catalog.registry import query
from sumveil.catalog.sqlviews import with_views, ws
from sumveil.functions import encodings as enc
from sumveil.functions import vectors
from sumveil.functions.timewin import DAY_MS, idiv
from sumveil.operators.aggregate import add_inputs, merge_maps
from sumveil.operators.chain import with_previous, with_window
from sumveil.plans import profiles as pf
from sumveil.sources import fixtures as fx

# Ten equal buckets over [0, 1000).
BOUNDARIES = [100, 200, 300, 400, 500, 600, 700, 800, 900]
MONTH = 30 * DAY_MS
UW = ["universe_id", "ws"]


def _sql(body: str, *views: str) -> str:
    return with_views(list(views or ("stdw",)), body)


def _std(spark, sf):
    return with_window(fx.std(spark, sf), DAY_MS)


def _sum(cols: dict):
    return [F.sum(c).alias(n) for n, c in cols.items()]


def _std_sums(df, keys=UW):
    x = F.col("value")
    s, q, n = enc.var_lanes(x)
    return df.groupBy(*keys).agg(*_sum({"s": s, "q": q, "n": n}))


@query("E1", _sql("SELECT universe_id, ws, sum(value)::BIGINT AS total FROM stdw GROUP BY ALL"))
def enc_sum(spark, sf):
    (x,) = enc.sum_lanes(F.col("value"))
    return _std(spark, sf).groupBy(*UW).agg(F.sum(x).alias("total"))


@query("E2", _sql("SELECT universe_id, ws, count(*) AS n FROM stdw GROUP BY ALL"))
def enc_count(spark, sf):
    (one,) = enc.count_lanes()
    return _std(spark, sf).groupBy(*UW).agg(F.sum(one).alias("n"))


@query("E3", _sql("SELECT universe_id, ws, round(avg(value), 6) AS mean FROM stdw GROUP BY ALL"))
def enc_avg(spark, sf):
    x, one = enc.avg_lanes(F.col("value"))
    sums = _std(spark, sf).groupBy(*UW).agg(*_sum({"s": x, "n": one}))
    return sums.select(*UW, F.round(enc.decode_avg(F.col("s"), F.col("n")), 6).alias("mean"))


@query("E4 X3", _sql("SELECT universe_id, ws, round(var_pop(value), 4) AS variance FROM stdw GROUP BY ALL"))
def enc_var(spark, sf):
    v = enc.decode_var(F.col("s"), F.col("q"), F.col("n"))
    return _std_sums(_std(spark, sf)).select(*UW, F.round(v, 4).alias("variance"))


@query("E5 X4", _sql("SELECT universe_id, ws, round(stddev_pop(value), 4) AS stddev FROM stdw GROUP BY ALL"))
def enc_stddev(spark, sf):
    v = enc.decode_stddev(F.col("s"), F.col("q"), F.col("n"))
    return _std_sums(_std(spark, sf)).select(*UW, F.round(v, 4).alias("stddev"))


_BUCKET_SQL = "CASE " + " ".join(f"WHEN value < {b} THEN {i}" for i, b in enumerate(BOUNDARIES)) + f" ELSE {len(BOUNDARIES)} END"
_HIST_SQL = f"SELECT universe_id, ws, ({_BUCKET_SQL})::BIGINT AS bucket, count(*) AS n FROM stdw GROUP BY ALL"


def _hist(spark, sf):
    return _std(spark, sf).groupBy(*UW, enc.bucket(F.col("value"), BOUNDARIES).alias("bucket")).agg(F.count("*").alias("n"))


@query("E6", _sql(_HIST_SQL))
def enc_hist(spark, sf):
    return _hist(spark, sf)


@query("E7", _sql(f"SELECT universe_id, ws, coalesce(min(bucket), -1)::BIGINT AS min_bucket FROM ({_HIST_SQL}) WHERE n > 0 GROUP BY universe_id, ws"))
def enc_min_bucket(spark, sf):
    return _hist(spark, sf).groupBy(*UW).agg(enc.decode_min_bucket(F.col("bucket"), F.col("n")).alias("min_bucket"))


@query("E8", _sql(f"SELECT universe_id, ws, coalesce(max(bucket), -1)::BIGINT AS max_bucket FROM ({_HIST_SQL}) WHERE n > 0 GROUP BY universe_id, ws"))
def enc_max_bucket(spark, sf):
    return _hist(spark, sf).groupBy(*UW).agg(enc.decode_max_bucket(F.col("bucket"), F.col("n")).alias("max_bucket"))


@query("E9", _sql("""
    SELECT universe_id, ws, round(regr_intercept(y, value), 4) AS intercept, round(regr_slope(y, value), 6) AS slope
    FROM stdw GROUP BY ALL"""))
def enc_reg(spark, sf):
    names = ["sx", "sxx", "sy", "sxy", "n"]
    lanes = enc.regression_lanes(F.col("value"), F.col("y"))
    sums = _std(spark, sf).groupBy(*UW).agg(*_sum(dict(zip(names, lanes))))
    a, b = enc.decode_regression(*[F.col(c) for c in names])
    return sums.select(*UW, F.round(a, 4).alias("intercept"), F.round(b, 6).alias("slope"))


#: Bits of a packed count: the sum of a bin must stay below 2^32.
PACK_BITS = 32
_Y_BINS = "SELECT universe_id, ws, y AS bin, count(*) AS n FROM stdw GROUP BY ALL"


def _packed(spark, sf, bits=PACK_BITS):
    bins = _std(spark, sf).groupBy(*UW, F.col("y").alias("bin")).agg(F.count("*").alias("n"))
    word = enc.pack_word(F.col("bin"), bits)
    return bins.groupBy(*UW, word.alias("word")).agg(F.sum(enc.pack_value(F.col("n"), F.col("bin"), bits)).alias("packed"))


@query("E11 X1 X2", _sql(f"""
    SELECT universe_id, ws, bin // {64 // PACK_BITS} AS word, sum(n * (1::BIGINT << ((bin % {64 // PACK_BITS}) * {PACK_BITS})::INT))::BIGINT AS packed
    FROM ({_Y_BINS}) GROUP BY ALL"""))
def hist_pack(spark, sf):
    return _packed(spark, sf)


@query("E12 X2", _sql(f"SELECT * FROM ({_Y_BINS})"))
def hist_unpack(spark, sf):
    bins = F.explode(enc.unpack_word(F.col("word"), F.col("packed"), PACK_BITS))
    return _packed(spark, sf).select(*UW, bins.alias("e")).select(*UW, "e.bin", "e.n").filter("n > 0")


@query("E13", with_views(["polar"], f"""
    SELECT universe_id, {ws('ts_ms', MONTH)} AS ws, altitude // 10 + 10 AS bin, sum(heartrate)::BIGINT AS s, count(*) AS n,
           round(sum(heartrate)::DOUBLE / count(*), 6) AS mean
    FROM polar GROUP BY ALL"""))
def bin_group_sum(spark, sf):
    axis = next(b for b in pf.POLAR.bins if b.attr == "altitude")
    df = with_window(fx.polar(spark, sf), MONTH)
    sums = df.groupBy(*UW, axis.index().alias("bin")).agg(F.sum("heartrate").alias("s"), F.count("*").alias("n"))
    return sums.withColumn("mean", F.round(enc.decode_avg(F.col("s"), F.col("n")), 6))


@query("E14", with_views(["polar"], """
    SELECT (altitude // 10)::BIGINT AS scaled, count(*) AS n, min(altitude) AS lo, max(altitude) AS hi FROM polar GROUP BY ALL"""))
def bin_scaled(spark, sf):
    return fx.polar(spark, sf).groupBy(idiv(F.col("altitude"), 10).alias("scaled")).agg(
        F.count("*").alias("n"), F.min("altitude").alias("lo"), F.max("altitude").alias("hi")
    )


def _polar_lane_sql(value: str = "v") -> str:
    parts = []
    for b in pf.POLAR.bins:
        idx = f"{b.attr} // {b.step} - ({b.low})" if b.step > 1 else f"{b.attr} - ({b.low})"
        for field, v in ((b.hist, "1"), (b.grouped, "heartrate")):
            if field:
                parts.append(f"SELECT universe_id, ws, '{field}' AS field, {idx} AS lane, {v} AS v FROM pw")
    for a in pf.POLAR.attrs:
        parts.append(f"SELECT universe_id, ws, '{a}Base' AS field, 0 AS lane, {a} AS v FROM pw")
        parts.append(f"SELECT universe_id, ws, '{a}Base' AS field, 1 AS lane, {a} * {a} AS v FROM pw")
    parts.append("SELECT universe_id, ws, 'count' AS field, 0 AS lane, 1 AS v FROM pw")
    return " UNION ALL ".join(parts)


_OFFSET_SQL = "CASE field " + " ".join(f"WHEN '{f}' THEN {o}" for f, o in pf.offsets(pf.POLAR.fields).items()) + " END"
_YEAR = 360 * DAY_MS


@query("E15 E10 E13 P2", with_views(["polar"], f"""
    SELECT universe_id, ws, field, lane::BIGINT AS lane, ({_OFFSET_SQL} + lane)::BIGINT AS pos, sum(v)::BIGINT AS v
    FROM (WITH pw AS (SELECT *, {ws('ts_ms', _YEAR)} AS ws FROM polar) {_polar_lane_sql()})
    GROUP BY ALL HAVING sum(v) <> 0"""))
def digest_flatten(spark, sf):
    """Polar sums as a dense flat vector and back to lanes."""
    lanes = pf.lane_totals(with_window(fx.polar(spark, sf), _YEAR), UW, pf.POLAR)
    flat = pf.flatten_lanes(lanes.filter(F.col("field") != pf.QUARANTINE), pf.POLAR.fields)
    back = pf.rebuild_lanes(pf.dense_vectors(flat, UW, pf.POLAR.fields), UW, pf.POLAR.fields)
    return pf.flatten_lanes(back, pf.POLAR.fields)


def _half(spark, sf, odd: int):
    df = with_previous(fx.std_events(spark, sf).select("universe_id", "producer_id", "ts_ms", "value", "event_id"), DAY_MS)
    df = df.filter(F.pmod("event_id", F.lit(2)) == odd)
    return df.groupBy(*UW).agg(
        *_sum(dict(zip(["s", "q", "n"], enc.var_lanes(F.col("value"))))), F.min("prev_ts").alias("start"), F.max("ts_ms").alias("end")
    ).select(*UW, F.array("s", "q", "n").alias("v"), "start", "end")


_PREV_SQL = "SELECT *, coalesce(lag(ts_ms) OVER (PARTITION BY producer_id, ws ORDER BY ts_ms), ws - 1) AS prev_ts FROM stdw"


@query("E16", _sql(f"""
    SELECT universe_id, ws, sum(value)::BIGINT AS s, sum(value * value)::BIGINT AS q, count(*) AS n,
           min(prev_ts) AS "start", max(ts_ms) AS "end"
    FROM ({_PREV_SQL}) GROUP BY ALL
    HAVING count(*) FILTER (event_id % 2 = 0) > 0 AND count(*) FILTER (event_id % 2 = 1) > 0"""))
def digest_add(spark, sf):
    a, b = _half(spark, sf, 0).alias("a"), _half(spark, sf, 1).alias("b")
    j = a.join(b, UW)
    return vectors.lanes_to_columns(
        j.select(
            *UW, vectors.add(F.col("a.v"), F.col("b.v")).alias("v"),
            F.least("a.start", "b.start").alias("start"), F.greatest("a.end", "b.end").alias("end"),
        ), "v", ["s", "q", "n"])


@query("E17", _sql("""
    SELECT universe_id, ws, sum(value)::BIGINT AS s, sum(value * value)::BIGINT AS q, count(*) AS n
    FROM stdw WHERE event_id % 2 = 0 GROUP BY ALL
    HAVING (universe_id, ws) IN (SELECT (universe_id, ws) FROM stdw WHERE event_id % 2 = 1)"""))
def digest_sub(spark, sf):
    whole = _std_sums(_std(spark, sf)).select(*UW, F.array("s", "q", "n").alias("v"))
    odd = with_window(fx.std_events(spark, sf), DAY_MS).filter(F.pmod("event_id", F.lit(2)) == 1)
    part = _std_sums(odd).select(*UW, F.array("s", "q", "n").alias("o"))
    rest = whole.join(part, UW).select(*UW, vectors.subtract(F.col("v"), F.col("o")).alias("v"))
    return vectors.lanes_to_columns(rest, "v", ["s", "q", "n"]).filter("n > 0")


@query("E18", _sql("""
    SELECT universe_id, ws, sum(value)::BIGINT AS value, sum(CASE WHEN y % 3 = 0 THEN y ELSE 1 END)::BIGINT AS "count"
    FROM stdw GROUP BY ALL"""))
def input_add(spark, sf):
    """Two thirds of the inputs have no count and stand for one event each."""
    df = _std(spark, sf).withColumn("count", F.when(F.pmod("y", F.lit(3)) == 0, F.col("y")))
    return add_inputs(df, UW, ["value"])


@query("E19 X5", with_views(["web"], f"""
    SELECT universe_id, {ws('ts_ms')} AS ws, page::VARCHAR AS map_key, sum((value * 7) % 1000)::BIGINT AS map_value
    FROM web GROUP BY ALL"""))
def map_merge_sum(spark, sf):
    return merge_maps(with_window(fx.web(spark, sf), DAY_MS), UW, "pageLoadTime")




@query("E20", _sql("""
    SELECT universe_id, ws, count(*) AS n, sum(value)::BIGINT AS s, round(avg(value), 6) AS mean,
           round(var_pop(value), 4) AS variance, round(stddev_pop(value), 4) AS stddev FROM stdw GROUP BY ALL"""))
def digest_stats(spark, sf):
    s, q, n = F.col("s"), F.col("q"), F.col("n")
    return _std_sums(_std(spark, sf)).select(
        *UW, "n", "s", F.round(enc.decode_avg(s, n), 6).alias("mean"),
        F.round(enc.decode_var(s, q, n), 4).alias("variance"), F.round(enc.decode_stddev(s, q, n), 4).alias("stddev"),
    )


@query("P1 E1 E4", _sql("""
    SELECT universe_id, ws, sum(value)::BIGINT AS s, sum(value * value)::BIGINT AS q, count(*) AS n FROM stdw GROUP BY ALL"""))
def app_standard(spark, sf):
    return pf.base_totals(_std(spark, sf), UW, pf.STANDARD).drop("attr")


def _bins_sql(profile, view, size, main):
    index = {b: f'"{b.attr}" // {b.step} - ({b.low})' if b.step > 1 else f'"{b.attr}" - ({b.low})' for b in profile.bins}
    good = "coalesce(" + " AND ".join(f"({idx}) BETWEEN 0 AND {b.n - 1}" for b, idx in index.items()) + ", false)"
    head = f"SELECT universe_id, {ws('ts_ms', size)} AS ws"
    parts = [f"{head}, '{b.attr}' AS axis, ({idx})::BIGINT AS bin, \"{main}\" AS m FROM {view} WHERE {good}" for b, idx in index.items()]
    parts.append(f"{head}, '{pf.QUARANTINE}', NULL, NULL FROM {view} WHERE NOT {good}")
    return with_views([view], "SELECT universe_id, ws, axis, bin, count(*) AS n, sum(m)::BIGINT AS s FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL")


def _bases_sql(profile, view, size):
    parts = [
        f"SELECT universe_id, {ws('ts_ms', size)} AS ws, '{a}' AS attr, \"{a}\" AS x FROM {view}" for a in profile.attrs
    ]
    return with_views([view], "SELECT universe_id, ws, attr, count(*) AS n, sum(x)::BIGINT AS s, sum(x * x)::BIGINT AS q FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL")


def _hist_only(sql):
    return f"SELECT universe_id, ws, axis, bin, n FROM ({sql})"


@query("P2 E6 E14", _hist_only(_bins_sql(pf.POLAR, "polar", MONTH, "heartrate")))
def app_polar_hist(spark, sf):
    """Events per bin, and those off an axis counted beside them."""
    return pf.bin_totals(with_window(fx.polar(spark, sf), MONTH), UW, pf.POLAR).drop("s")


@query("P2 E13", f"SELECT universe_id, ws, axis, bin, s FROM ({_bins_sql(pf.POLAR, 'polar', MONTH, 'heartrate')}) WHERE axis <> 'heartrate'")
def app_polar_groupsum(spark, sf):
    axes = [b.attr for b in pf.POLAR.bins if b.grouped]
    df = with_window(fx.polar(spark, sf), MONTH)
    return pf.bin_totals(df, UW, pf.POLAR).filter(F.col("axis").isin(axes)).drop("n")


@query("P2 E10", _bases_sql(pf.POLAR, "polar", MONTH))
def app_polar_base(spark, sf):
    return pf.base_totals(with_window(fx.polar(spark, sf), MONTH), UW, pf.POLAR)


@query("P3 E6 E14", _hist_only(_bins_sql(pf.CAR, "car", MONTH, "oilTemperature")))
def app_car_hist(spark, sf):
    return pf.bin_totals(with_window(fx.car(spark, sf), MONTH), UW, pf.CAR).drop("s")


@query("P3 E10", _bases_sql(pf.CAR, "car", MONTH))
def app_car_base(spark, sf):
    return pf.base_totals(with_window(fx.car(spark, sf), MONTH), UW, pf.CAR)


@query("P4 E19 X5", with_views(["web"], f"""
    SELECT universe_id, {ws('ts_ms')} AS ws, 'pageExit' AS field, start AS page, count(*) AS v FROM web GROUP BY ALL
    UNION ALL SELECT universe_id, {ws('ts_ms')} AS ws, 'pageView' AS field, page, count(*) AS v FROM web GROUP BY ALL"""))
def app_web_pages(spark, sf):
    return pf.web_pages(with_window(fx.web(spark, sf), DAY_MS), UW)


@query("P4 X5", with_views(["webtimes"], f"""
    SELECT universe_id, {ws('ts_ms')} AS ws, field, page, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS q
    FROM webtimes GROUP BY ALL"""))
def app_web_timing(spark, sf):
    return pf.web_timings(with_window(fx.web(spark, sf), DAY_MS), UW)


@query("P4 X5", with_views(["web"], f"""
    SELECT universe_id, {ws('ts_ms')} AS ws, start AS page, page AS target, count(*) AS v FROM web GROUP BY ALL"""))
def app_web_flow(spark, sf):
    return pf.web_flow(with_window(fx.web(spark, sf), DAY_MS), UW)


@query("P4 X5", with_views(["web"], f"""
    SELECT universe_id, ws, field, page, cell, count(*) AS v FROM (
        SELECT universe_id, {ws('ts_ms')} AS ws, 'clickGrid' AS field, start AS page, x * 11 + gy AS cell FROM web
        UNION ALL SELECT universe_id, {ws('ts_ms')}, 'hoverGrid', start, x * 11 + gy FROM web
        UNION ALL SELECT universe_id, {ws('ts_ms')}, 'hoverGrid', start, x * 11 + gy + 1 FROM web WHERE gy < 10)
    GROUP BY ALL"""))
def app_web_grid(spark, sf):
    return pf.web_grid(with_window(fx.web(spark, sf), DAY_MS), UW)


@query("X7", with_views(["web"], f"""
    SELECT {ws('ts_ms')} AS ws, sum(CASE WHEN page = 0 THEN (value * 7) % 1000 ELSE 0 END)::BIGINT AS load_of_page_0 FROM web GROUP BY ALL"""))
def map_default(spark, sf):
    """Missing map keys read as zero."""
    load = F.coalesce(F.try_element_at("pageLoadTime", F.lit("0")), F.lit(0)).cast("bigint")
    return with_window(fx.web(spark, sf), DAY_MS).groupBy("ws").agg(F.sum(load).alias("load_of_page_0"))

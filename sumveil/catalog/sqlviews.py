"""The input views once more in plain SQL, for the checks of registered queries."""

from __future__ import annotations

from sumveil.sources.fixtures import CAR_RANGES, CLIQUE_SIZE, EVENT_TYPES, FULL_PERCENT, GRAPH_BLOCK, GRAPH_LARGE, GRAPH_W, LEAST_PERCENT, WEB_TIMINGS

DAY = 86_400_000


def pmod(a: str, n: int) -> str:
    return f"((({a}) % {n} + {n}) % {n})"


def ws(ts: str, size: int = DAY) -> str:
    return f"(({ts}) - {pmod(ts, size)})"


_POLAR_TS = f"epoch_us(l_shipdate) // 1000 + (l_orderkey * 8 + l_linenumber) % {DAY}"

# K of the random graph per universe, by the failure bound summed over all j.
_PARAMETERS = """
        SELECT u.universe_id, u.min_size AS members, b.k, (2 ** b.k)::BIGINT AS w,
               ((128 // b.k) * (2 ** b.k))::BIGINT AS rounds, (u.min_size - 1) / (2 ** b.k) AS expected_degree
        FROM {universes} u LEFT JOIN (
            SELECT min_size, CASE WHEN min(k) > 1 THEN min(k) - 1 END::BIGINT AS k
            FROM (SELECT min_size, k, (128 // k) * (2 ** k) * sum(exp(least(
                         j * (1.0::DOUBLE + ln(n::DOUBLE / j) + (n - j) * ln(1.0::DOUBLE - 1.0::DOUBLE / (2 ** k))), 700.0::DOUBLE))) AS bound
                  FROM (SELECT DISTINCT min_size, min_size // 2 AS n FROM {universes} WHERE min_size >= 4),
                       LATERAL (SELECT unnest(range(1, 32)) AS k), LATERAL (SELECT unnest(range(1, n // 2 + 1)) AS j)
                  GROUP BY min_size, k)
            WHERE bound > 1e-5 GROUP BY min_size) b ON u.min_size = b.min_size"""

# name -> (views it needs, body)
VIEWS: dict[str, tuple[list[str], str]] = {
    "std": ([], """
        SELECT 1::BIGINT AS universe_id, user_id AS producer_id, epoch_us(ts) // 1000 AS ts_ms,
               CAST(floor(value) AS BIGINT) AS value,
               CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS y, event_id, event_type
        FROM events"""),
    "std5": (["std"], "SELECT * REPLACE (CASE event_type "
        + " ".join(f"WHEN '{t}' THEN {i}::BIGINT" for i, t in enumerate(EVENT_TYPES, 1)) + " END AS universe_id) FROM std"),
    "clique": (["std"], f"SELECT * REPLACE (producer_id // {CLIQUE_SIZE} AS universe_id) FROM std"),
    "stduniverses": (["std"], f"""
        SELECT universe_id, n * {FULL_PERCENT} // 100 AS full_size, n * {LEAST_PERCENT} // 100 AS min_size
        FROM (SELECT universe_id, count(DISTINCT producer_id) AS n FROM std GROUP BY 1)"""),
    "stdw": (["std"], f"SELECT *, {ws('ts_ms')} AS ws FROM std"),
    "spans": (["stdw"], f"""
        SELECT universe_id, producer_id, ws, n_values, max_ts,
               ws < max(ws) OVER (PARTITION BY universe_id, producer_id) AS moved_on
        FROM (SELECT universe_id, producer_id, ws, count(*) AS n_values, max(ts_ms) AS max_ts
              FROM stdw GROUP BY ALL)"""),
    "complete": (["spans"], f"""
        SELECT universe_id, producer_id, ws FROM spans WHERE moved_on OR max_ts = ws + {DAY} - 1"""),
    "commits": (["stdw"], f"""
        SELECT universe_id, producer_id, ws, ws + {DAY} + 1000 * (producer_id % 8) AS commit_ts
        FROM (SELECT DISTINCT universe_id, producer_id, ws FROM stdw)
        WHERE NOT (producer_id % 10 = 7 AND (ws // {DAY}) % 2 = 0)"""),
    "timely": (["commits"], f"SELECT * FROM commits WHERE commit_ts <= ws + {DAY} + 6000"),
    "committed": (["complete", "timely"], """
        SELECT universe_id, producer_id, ws FROM complete
        INTERSECT SELECT universe_id, producer_id, ws FROM timely"""),
    "psums": (["stdw"], """
        SELECT universe_id, producer_id, ws, sum(value)::BIGINT AS s, sum(value * value)::BIGINT AS q, count(*) AS n
        FROM stdw GROUP BY universe_id, producer_id, ws"""),
    "diffs": (["committed"], f"""
        SELECT coalesce(a.universe_id, b.universe_id) AS universe_id, coalesce(a.ws, b.ws + {DAY}) AS ws,
               coalesce(a.producer_id, b.producer_id) AS producer_id,
               CASE WHEN b.ws IS NULL THEN 1 ELSE -1 END::BIGINT AS diff
        FROM committed a FULL OUTER JOIN committed b
          ON a.universe_id = b.universe_id AND a.producer_id = b.producer_id AND a.ws = b.ws + {DAY}
        WHERE (a.ws IS NULL OR b.ws IS NULL) AND coalesce(a.ws, b.ws + {DAY}) <= (SELECT max(ws) FROM committed)"""),
    "csum": (["psums", "committed"], """
        SELECT universe_id, ws, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q, sum(n)::BIGINT AS n, count(*) AS producers
        FROM psums JOIN committed USING (universe_id, producer_id, ws) GROUP BY universe_id, ws"""),
    "polar": ([], f"""
        SELECT 1::BIGINT AS universe_id, l_suppkey AS producer_id, {_POLAR_TS} AS ts_ms,
               60 + CAST(floor(l_quantity) AS BIGINT) AS heartrate,
               (l_partkey * 37) % 3100 - 100 AS altitude, l_orderkey % 44 AS speed,
               greatest(l_orderkey % 99 - 49, 0) AS ascent, greatest(49 - l_orderkey % 99, 0) AS descent,
               l_partkey % 51 - 10 AS temperature
        FROM lineitem"""),
    "car": ([], f"SELECT 1::BIGINT AS universe_id, l_suppkey AS producer_id, {_POLAR_TS} AS ts_ms, "
        + ", ".join(f'(l_orderkey * {c} + l_partkey) % {w} + ({low}) AS "{a}"' for c, (a, (low, w)) in enumerate(CAR_RANGES.items(), 1))
        + " FROM lineitem"),
    "web": (["std"], """
        SELECT universe_id, producer_id, ts_ms, value, producer_id % 3 AS start,
               CASE WHEN y = producer_id % 3 THEN (y + 1) % 100 ELSE y END AS page, y // 5 AS x, y % 11 AS gy FROM std"""),
    "arrivals": ([], """
        SELECT o_custkey % 4 AS partition, o_custkey AS producer_id, o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS ts_ms
        FROM orders"""),
    "runs": (["stdw"], """
        SELECT producer_id AS run, CASE WHEN event_type IN ('click', 'view') THEN 'plain' ELSE 'private' END AS kind, ws,
               max(value) AS latency_ms, count(*) AS n
        FROM stdw GROUP BY ALL"""),
    "universes": ([], """
        SELECT (CASE WHEN r IS NULL THEN 0 WHEN k IS NULL THEN 100 + r ELSE 1000 + k END)::BIGINT AS universe_id,
               n AS min_size
        FROM (SELECT n_regionkey AS r, n_nationkey AS k, count(*) AS n
              FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey))"""),
    "parameters": (["universes"], _PARAMETERS.format(universes="universes")),
    "gevents": ([], f"""
        SELECT 2 * (o_custkey // {GRAPH_BLOCK}) + (o_custkey % {GRAPH_BLOCK} >= {GRAPH_LARGE})::BIGINT AS universe_id, o_custkey AS producer_id,
               epoch_us(o_orderdate) // 1000 + (o_orderkey * 8) % {DAY} AS ts_ms, (o_orderkey * 37 + o_custkey) % 491 AS value FROM orders"""),
    "gwindows": (["gevents"], f"""
        SELECT *, ws < max(ws) OVER (PARTITION BY universe_id, producer_id) AS moved_on
        FROM (SELECT universe_id, producer_id, {ws('ts_ms', GRAPH_W)} AS ws, sum(value)::BIGINT AS s, sum(value * value)::BIGINT AS q, count(*) AS n, max(ts_ms) AS max_ts
              FROM gevents GROUP BY ALL)"""),
    "gcommitted": (["gwindows"], f"""
        SELECT * FROM gwindows WHERE (moved_on OR max_ts = ws + {GRAPH_W} - 1) AND 1000 * (producer_id % 8) <= 6000
        AND NOT (producer_id % 10 = 7 AND (ws // {GRAPH_W}) % 2 = 0)"""),
    "guniverses": (["gevents"], f"""
        SELECT universe_id, count(DISTINCT producer_id) * {LEAST_PERCENT} // 100 AS min_size FROM gevents GROUP BY 1"""),
    "gparameters": (["guniverses"], _PARAMETERS.format(universes="guniverses")),
    "webtimes": (["web"], " UNION ALL ".join(
        f"SELECT universe_id, ts_ms, '{t}' AS field, page, (value * {f}) % 1000 AS v FROM web" for t, f in WEB_TIMINGS.items())),
}


def with_views(names: list[str], body: str) -> str:
    """The body behind a WITH clause of the views it needs."""
    ordered: list[str] = []

    def need(n: str) -> None:
        for d in VIEWS[n][0]:
            need(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        need(n)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n" + body

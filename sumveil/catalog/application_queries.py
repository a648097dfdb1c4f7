"""All lanes of an application per window: in the clear, and released from ciphertexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumveil.catalog.registry import query
from sumveil.catalog.sqlviews import DAY, with_views, ws
from sumveil.functions.timewin import idiv
from sumveil.operators import chain, commits as cm, masks as mk, release as rl, telescoping as tl
from sumveil.plans import profiles as pf
from sumveil.session import materialize, spread
from sumveil.sources import fixtures as fx

UW = ["universe_id", "ws"]
WINDOW = ["universe_id", "producer_id", "ws"]
YEAR = 360 * DAY
#: Commits count up to so many milliseconds after their window ended.
DEADLINE = 6000
MONTH = 30 * DAY


def _lane_rows(profile: pf.Profile) -> str:
    """UNION of (universe, producer, ws, field, lane, v) over rows ``src``."""
    parts = []
    head = "SELECT universe_id, producer_id, ws"
    for b in profile.bins:
        idx = _index(b)
        for field, v in ((b.hist, "1"), (b.grouped, f'"{profile.main}"')):
            if field:
                parts.append(f"{head}, '{field}' AS field, {idx} AS lane, {v} AS v FROM src")
    for a in profile.attrs:
        parts.append(f"{head}, '{a}Base' AS field, 0 AS lane, \"{a}\" AS v FROM src")
        parts.append(f"{head}, '{a}Base' AS field, 1 AS lane, \"{a}\" * \"{a}\" AS v FROM src")
    parts.append(f"{head}, 'count' AS field, 0 AS lane, 1 AS v FROM src")
    return " UNION ALL ".join(parts)


def _index(b: pf.Bins) -> str:
    return f'"{b.attr}" // {b.step} - ({b.low})' if b.step > 1 else f'"{b.attr}" - ({b.low})'


def _on_axes(profile: pf.Profile) -> str:
    return "coalesce(" + " AND ".join(f"{_index(b)} BETWEEN 0 AND {b.n - 1}" for b in profile.bins) + ", false)"


_WEB_ON_AXES = "coalesce(start BETWEEN 0 AND 2 AND page BETWEEN 0 AND 99 AND x BETWEEN 0 AND 19 AND gy BETWEEN 0 AND 10, false)"


def _web_rows() -> str:
    head = "SELECT universe_id, producer_id, ws"
    parts = [
        f"{head}, 'pageExit' AS field, start AS lane, 1 AS v FROM src", f"{head}, 'pageView', page, 1 FROM src",
        f"{head}, 'page' || start || 'Userflow', page, 1 FROM src", f"{head}, 'count', 0, 1 FROM src",
        f"{head}, 'page' || start || 'ClickGrid', x * 11 + gy, 1 FROM src",
        f"{head}, 'page' || start || 'HoverGrid', x * 11 + gy, 1 FROM src",
        f"{head}, 'page' || start || 'HoverGrid', x * 11 + gy + 1, 1 FROM src WHERE gy < 10",
    ]
    for t, f in fx.WEB_TIMINGS.items():
        v = f"((value * {f}) % 1000)"
        parts += [f"{head}, '{t}Sum', page, {v} FROM src", f"{head}, '{t}SumOfSquares', page, {v} * {v} FROM src", f"{head}, '{t}Count', page, 1 FROM src"]
    return " UNION ALL ".join(parts)


def _sql(view: str, rows: str, good: str, size: int, private: bool) -> str:
    kept = f"SELECT *, {ws('ts_ms', size)} AS ws FROM {view}"
    if private:
        kept = f"""SELECT * FROM (SELECT *, max(ws) OVER (PARTITION BY universe_id, producer_id) AS last_ws,
                          max(ts_ms) OVER (PARTITION BY universe_id, producer_id, ws) AS last_ts FROM ({kept}))
                   WHERE (ws < last_ws OR last_ts = ws + {size} - 1)
                     AND NOT (producer_id % 10 = 7 AND (ws // {size}) % 2 = 0) AND 1000 * (producer_id % 8) <= {DEADLINE}"""
    off = "" if private else f" UNION ALL SELECT universe_id, producer_id, ws, '{pf.QUARANTINE}', 0, 1 FROM kept WHERE NOT {good}"
    return with_views([view], f"""
    SELECT universe_id, ws, field, lane::BIGINT AS lane, sum(v)::BIGINT AS v
    FROM (WITH kept AS ({kept}), src AS (SELECT * FROM kept WHERE {good}) {rows}{off}) GROUP BY ALL HAVING sum(v) <> 0""")


#: A mask group's id is its universe's, shifted by so many bits, and the cohort's number.
GROUP_BITS = 32


def _universe():
    """Universe of a mask group."""
    return F.shiftright("universe_id", GROUP_BITS)


def _cohorts(events):
    """Each cohort of consecutive producers is a mask group with pair keys of its own."""
    cohort = F.shiftleft("universe_id", GROUP_BITS) + idiv(F.col("producer_id"), fx.CLIQUE_SIZE)
    return events.withColumn("universe_id", cohort)


def release_vectors(lanes, present, fields: dict[str, int], bits: dict[str, int], size: int, sent=None, universe: int = 1):
    """Masked release of vectors per mask group: (universe_id, ws, v, producers), v flat.

    ``lanes`` has (group, producer, ws, pos, v) rows.  Lanes are packed into words, which are
    encrypted, masked and added as they are.  Where a producer's lane is beyond what the
    members of a group may add up to, the group's window takes one word a lane.
    """
    packing, flat = pf.Packing(fields, bits, fx.CLIQUE_SIZE), pf.Packing(fields, {}, 1)
    out = materialize(_release(lanes, present, packing, size, sent, universe), "released-groups")
    beyond = out.filter("beyond").select(UW)
    if beyond.limit(1).count():
        few = _release(lanes.join(beyond, UW, "left_semi"), present.join(beyond, UW, "left_semi"), flat, size, sent, universe)
        out = out.filter("not beyond").unionByName(materialize(few, "released-flat-groups"))
    return out.drop("beyond")


def _release(lanes, present, packing, size: int, sent, universe: int):
    wkeys = tl.outer_times(present, fx.stream_keys(present), size)
    pairs = fx.pair_keys(present, fx.CLIQUE_SIZE)
    pairs = pairs.withColumn("universe_id", F.lit(universe << GROUP_BITS) + F.col("universe_id"))
    return rl.release_committed(lanes, wkeys, mk.cohort_masks(present, pairs), packing, sent)


def private_lanes(events, lanes_of, fields: dict[str, int], bits: dict[str, int], size: int, sent=None, universe: int = 1):
    """Masked release of whole vectors: commits, window keys, pairwise masks, tokens, sums.

    Producers with a gap-free window and a commit in time take part.  Masks cancel within
    cohorts; a universe's window is released only if all its cohorts are, whose sums are then
    added up.  Keys, masks and tokens are computed per (producer, window), never per event.
    ``sent`` says of a (producer, window) whether its token arrived; the test keys are those of one ``universe``.
    """
    events = _cohorts(events)
    spans = materialize(chain.window_spans(events, size), "producer-windows")
    in_time = cm.in_time(fx.commits(spans, size), size, DEADLINE)
    present = materialize(cm.committed(chain.complete_windows(spans, size), in_time), "committed")
    # Events lie by group and window before they are taken apart into lanes, so lanes are not shuffled.
    lanes = lanes_of(spread(_windowed(events, size), *UW))
    groups = release_vectors(lanes, present, fields, bits, size, sent, universe)
    whole = rl.whole_universes(groups, present, _universe())
    rows = pf.rebuild_lanes(groups.withColumn("universe_id", _universe()), UW, fields)
    return rows.join(whole, UW, "left_semi").groupBy(*UW, "field", "lane").agg(F.sum("v").alias("v")).filter("v <> 0")


def _windowed(df, size):
    return chain.with_window(df, size)


@query("P2 A2 E15", _sql("polar", _lane_rows(pf.POLAR), _on_axes(pf.POLAR), YEAR, False))
def plain_polar(spark, sf):
    return pf.lane_totals(_windowed(fx.polar(spark, sf), YEAR), UW, pf.POLAR)


@query("P3 A2 E15", _sql("car", _lane_rows(pf.CAR), _on_axes(pf.CAR), YEAR, False))
def plain_car(spark, sf):
    return pf.lane_totals(_windowed(fx.car(spark, sf), YEAR), UW, pf.CAR).filter("v <> 0")


@query("P4 A2 E15", _sql("web", _web_rows(), _WEB_ON_AXES, DAY, False))
def plain_web(spark, sf):
    return pf.web_lane_totals(_windowed(fx.web(spark, sf), DAY), UW)


@query("P2 J1 K3 K4 K6 A4", _sql("polar", _lane_rows(pf.POLAR), _on_axes(pf.POLAR), YEAR, True))
def private_polar(spark, sf):
    return private_lanes(fx.polar(spark, sf), lambda e: pf.fine_lane_totals(e, WINDOW, pf.POLAR), pf.POLAR.fields, pf.POLAR.bits, YEAR)


@query("P3 J1 K3 K4 K6 A4", _sql("car", _lane_rows(pf.CAR), _on_axes(pf.CAR), YEAR, True))
def private_car(spark, sf):
    return private_lanes(fx.car(spark, sf), lambda e: pf.fine_lane_totals(e, WINDOW, pf.CAR), pf.CAR.fields, pf.CAR.bits, YEAR)


@query("P4 J1 K3 K4 K6 A4", _sql("web", _web_rows(), _WEB_ON_AXES, DAY, True))
def private_web(spark, sf):
    return private_lanes(fx.web(spark, sf), lambda e: pf.in_vector(pf.web_position_totals(e, WINDOW), pf.WEB_FIELDS), pf.WEB_FIELDS, pf.WEB_BITS, DAY)

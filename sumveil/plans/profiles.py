"""Encoding profiles: which lanes an application's event contributes to.

A profile is data.  ``bin_totals`` and ``base_totals`` compile it to aggregates;
``lane_totals`` gives the long lane table (field, lane, v) of the same sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumveil.functions import wide
from sumveil.functions.timewin import idiv
from sumveil.functions.wide import Packing
from sumveil.session import spread


@dataclass(frozen=True)
class Bins:
    """One bin axis: ``attr div step`` from ``low``, ``n`` bins.

    ``hist`` names the field that counts events per bin, ``grouped`` the field that
    sums the main attribute per bin.
    """

    attr: str
    low: int
    n: int
    step: int = 1
    hist: str | None = None
    grouped: str | None = None

    def index(self) -> Column:
        v = F.col(self.attr)
        return (idiv(v, self.step) if self.step > 1 else v) - self.low


@dataclass(frozen=True)
class Profile:
    name: str
    main: str
    attrs: tuple[str, ...]
    bins: tuple[Bins, ...] = ()
    order: tuple[str, ...] = dc_field(default=())

    def lanes_of(self, field: str) -> int:
        if field == "count":
            return 1
        for b in self.bins:
            if field in (b.hist, b.grouped):
                return b.n
        return 2

    def bits_of(self, field: str) -> int:
        """Bits of a packed lane: counts per bin 16, sums per bin 32, totals 64."""
        kinds = {b.hist: 16 for b in self.bins} | {b.grouped: 32 for b in self.bins}
        return kinds.get(field, 64)

    @property
    def bits(self) -> dict[str, int]:
        return {f: self.bits_of(f) for f in self.order}

    @property
    def fields(self) -> dict[str, int]:
        """Fields in vector order with their number of lanes."""
        return {f: self.lanes_of(f) for f in self.order}


def packed_longs(n_bins: int, bits: int) -> int:
    """Words a field needs when 64 // bits bins share one."""
    per = 64 // bits
    return -(-n_bins // per)


STANDARD = Profile("standard", "value", ("value",), order=("valueBase", "count"))

_POLAR_BINS = (
    Bins("heartrate", 0, 220, hist="heartrateHist"),
    Bins("altitude", -10, 310, 10, "altitudeHist", "heartrateXaltitude"),
    Bins("speed", 0, 44, 1, "speedHist", "heartrateXspeed"),
    Bins("ascent", 0, 51, 1, "ascentHist", "heartrateXascent"),
    Bins("descent", 0, 51, 1, "descentHist", "heartrateXdescent"),
    Bins("temperature", -10, 51, 1, "temperatureHist", "heartrateXtemperature"),
)

POLAR = Profile(
    "polar", "heartrate",
    ("heartrate", "altitude", "speed", "ascent", "descent", "temperature"),
    _POLAR_BINS,
    # Field order of the flat vector.
    (
        "heartrateHist", "heartrateXaltitude", "heartrateXspeed", "heartrateXascent", "heartrateXdescent",
        "heartrateXtemperature", "altitudeHist", "speedHist", "ascentHist", "descentHist", "temperatureHist",
        "heartrateBase", "altitudeBase", "speedBase", "ascentBase", "descentBase", "temperatureBase", "count",
    ),
)

# Bin start, number of bins and bin width of each vehicle attribute.
_CAR = {
    "vibrationVelocity": (0, 16, 1),
    "vibrationDisplacement": (0, 120, 1),
    "vibrationAcceleration": (0, 40, 1),
    "soundPressure": (0, 120, 1),
    "humidity": (0, 100, 1),
    "speed": (0, 40, 5),
    "fuelLevel": (0, 20, 5),
    "tirePressure": (12, 28, 1),
    "ambientAirTemperature": (-7, 47, 1),
    "oilTemperature": (0, 32, 5),
    "engineTemperature": (0, 20, 5),
}

CAR = Profile(
    "car", "oilTemperature", tuple(_CAR),
    tuple(Bins(a, low, n, step, f"{a}Hist") for a, (low, n, step) in _CAR.items()),
    tuple(f"{a}Hist" for a in _CAR) + tuple(f"{a}Base" for a in _CAR) + ("count",),
)


def in_range(profile: Profile) -> Column:
    """Every binned attribute lies on its axis (a missing attribute does not)."""
    index = [b.index() for b in profile.bins]
    total = index[0]
    for i in index[1:]:
        total = total + i
    # Few, flat conditions: long ones make generated methods too big to be compiled.
    lowest, over = F.least(*index), F.greatest(*[i - b.n for i, b in zip(index, profile.bins)])
    return total.isNotNull() & (lowest >= 0) & (over < 0)


def split_invalid(df: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Encodable rows and quarantined rows."""
    fits = F.coalesce(in_range(profile), F.lit(False))
    return df.filter(in_range(profile)), df.filter(~fits)


#: Axis under which events with a value off its axis are counted.
QUARANTINE = "quarantine"


def _bin_sums(df: DataFrame, keys: list[str], profile: Profile, own: bool, split: bool = False) -> DataFrame:
    """Per (keys, _axis, _bin): count ``_n``, main sum ``_s``; with ``own`` also ``_x`` and ``_q`` of the axis' attribute.

    One row per axis and event is exploded; the axis is a number, which keeps the
    shuffled keys short.  With ``split`` an event off some axis has one row, of axis -1; without,
    an event whose column ``_fits`` is false has none.
    """
    axes = F.array(*[
        F.struct(F.lit(i).alias("axis"), b.index().alias("bin"), F.col(b.attr).alias("x")) for i, b in enumerate(profile.bins)
    ])
    explode = F.explode
    if "_fits" in df.columns:
        axes, explode = F.when(F.col("_fits"), axes), F.explode_outer
    if split:
        off = F.array(F.struct(F.lit(-1).alias("axis"), F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("bigint").alias("x")))
        axes = F.when(F.coalesce(in_range(profile), F.lit(False)), axes).otherwise(off)
    rows = df.select(*keys, F.col(profile.main).alias("_m"), explode(axes).alias("_a"))
    if "_fits" in df.columns:
        rows = rows.filter("_a is not null")
    x = F.col("_a.x")
    extra = [F.sum(x).alias("_x"), F.sum(x * x).alias("_q")] if own else []
    return rows.groupBy(*keys, F.col("_a.axis").alias("_axis"), F.col("_a.bin").alias("_bin")).agg(
        F.count("*").alias("_n"), F.sum("_m").alias("_s"), *extra
    )


def bin_totals(df: DataFrame, keys: list[str], profile: Profile) -> DataFrame:
    """Per (keys, axis, bin): event count ``n`` and sum ``s`` of the main attribute.

    Events with a missing value or one off its axis are in no bin; they are counted as axis
    ``quarantine`` (bin and sum null), in the same pass.
    """
    names = F.array(*[F.lit(b.attr) for b in profile.bins])
    off = F.col("_axis") < 0
    return _bin_sums(df, keys, profile, False, split=True).select(
        *keys, F.when(off, QUARANTINE).otherwise(F.get(names, F.col("_axis"))).alias("axis"), F.col("_bin").alias("bin"),
        F.col("_n").alias("n"), F.when(~off, F.col("_s")).alias("s"),
    )


def base_totals(df: DataFrame, keys: list[str], profile: Profile) -> DataFrame:
    """Per (keys, attr): count ``n``, sum ``s`` and sum of squares ``q``; no row is exploded."""
    aggs = [F.count("*").alias("n")]
    for a in profile.attrs:
        aggs += [F.sum(a).alias(f"s_{a}"), F.sum(F.col(a) * F.col(a)).alias(f"q_{a}")]
    wide = df.groupBy(*keys).agg(*aggs)
    attrs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("attr"), F.col(f"s_{a}").alias("s"), F.col(f"q_{a}").alias("q")) for a in profile.attrs
    ]))
    return wide.select(*keys, "n", attrs.alias("_b")).select(*keys, "_b.attr", "n", "_b.s", "_b.q")


def _lane(lane: Column, n: int) -> Column:
    """The lane, or an error where a value is off its axis: quarantine such events first."""
    off = F.raise_error(F.lit("value off its axis; see split_invalid and web_in_range")).cast("bigint")
    return F.when((lane >= 0) & (lane < n), lane).otherwise(off)


def _slot(offset: int, lane, v: Column) -> Column:
    lane = F.lit(lane) if isinstance(lane, int) else lane
    return F.struct((lane + offset).cast("bigint").alias("pos"), v.alias("v"))


def _bin_slots(profile: Profile, own: bool) -> Column:
    """What a row of :func:`_bin_sums` adds to the flat vector."""
    at = offsets(profile.fields)
    slots = F.array(_slot(n_lanes(profile.fields), 0, F.col("_n")))
    for i, b in enumerate(profile.bins):
        out = [_slot(at[f], _lane(F.col("_bin"), b.n), F.col(v)) for f, v in ((b.hist, "_n"), (b.grouped, "_s")) if f]
        if own:
            base = at[f"{b.attr}Base"]
            out += [_slot(base, 0, F.col("_x")), _slot(base, 1, F.col("_q"))]
            # Every event has one bin on the first axis.
            out += [_slot(at["count"], 0, F.col("_n"))] if i == 0 else []
        slots = F.when(F.col("_axis") == i, F.array(*out)).otherwise(slots)
    return F.explode(slots)


def lane_totals(df: DataFrame, keys: list[str], profile: Profile) -> DataFrame:
    """Long lane table (keys, field, lane, v) of all sums of a profile; empty lanes are absent.

    One pass over the events: per (keys, axis, bin) it sums the count, the main
    attribute, the axis' own attribute and its square.  All fields follow from that
    reduced table; base fields by adding up the bins of their axis.  Events off an axis
    are in none of them but in the field ``quarantine``, which counts them.
    """
    if not profile.bins:
        return name_lanes(fine_lane_totals(df, keys, profile).filter("v <> 0"), profile.fields)
    slots = _bin_sums(df, keys, profile, True, split=True).select(*keys, _bin_slots(profile, True).alias("_l"))
    sums = slots.groupBy(*keys, "_l.pos").agg(F.sum("_l.v").alias("v")).filter("v <> 0")
    return name_lanes(sums, profile.fields | {QUARANTINE: 1})


def fine_lane_totals(df: DataFrame, keys: list[str], profile: Profile) -> DataFrame:
    """The same sums as (keys, pos, v) for fine keys, such as (producer, window).

    There a bin rarely holds more than one event, so adding up bins would shuffle
    about as much as the events; base fields come from a second, unexploded pass.
    Events off an axis are left out; a key that has no others keeps its count of 0, so
    that its producer still sends a vector.
    """
    at = offsets(profile.fields)
    if profile.bins:
        df = df.withColumn("_fits", F.coalesce(in_range(profile), F.lit(False)))
        total = lambda v: F.coalesce(F.sum(F.when(F.col("_fits"), v)), F.lit(0).cast("bigint"))
    else:
        total = F.sum
    wide = [total(F.lit(1).cast("bigint")).alias("_n")]
    slots = [_slot(at["count"], 0, F.col("_n"))]
    for a in profile.attrs:
        wide += [total(F.col(a)).alias(f"_s_{a}"), total(F.col(a) * F.col(a)).alias(f"_q_{a}")]
        slots += [_slot(at[f"{a}Base"], 0, F.col(f"_s_{a}")), _slot(at[f"{a}Base"], 1, F.col(f"_q_{a}"))]
    both = df.groupBy(*keys).agg(*wide).select(*keys, F.explode(F.array(*slots)).alias("_l"))
    if profile.bins:
        # Not filtered but given no bins, so that both passes read the same shuffled events.
        both = both.unionByName(_bin_sums(df, keys, profile, False).select(*keys, _bin_slots(profile, False).alias("_l")))
    return both.select(*keys, "_l.pos", "_l.v").filter((F.col("v") != 0) | (F.col("pos") == at["count"]))


# A layout is the ordered fields of a vector with their numbers of lanes.


def n_lanes(fields: dict[str, int]) -> int:
    return sum(fields.values())


def offsets(fields: dict[str, int]) -> dict[str, int]:
    """Position of each field's first lane in the flat vector."""
    out, at = {}, 0
    for f, n in fields.items():
        out[f] = at
        at += n
    return out


def flatten_lanes(lanes: DataFrame, fields: dict[str, int]) -> DataFrame:
    """Add ``pos``, the position of a lane in the flat vector."""
    starts = F.create_map(*[x for f, o in offsets(fields).items() for x in (F.lit(f), F.lit(o).cast("bigint"))])
    return lanes.withColumn("pos", F.try_element_at(starts, F.col("field")) + F.col("lane"))


def name_lanes(rows: DataFrame, fields: dict[str, int]) -> DataFrame:
    """Replace ``pos`` by field name and lane."""
    starts = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(o).cast("bigint").alias("o")) for f, o in offsets(fields).items()
    ])
    owner = F.element_at(F.filter(starts, lambda e: e["o"] <= F.col("pos")), -1)
    rest = [c for c in rows.columns if c not in ("pos", "v")]
    return rows.withColumn("_f", owner).select(
        *rest, F.col("_f.field").alias("field"), (F.col("pos") - F.col("_f.o")).alias("lane"), "v"
    )


def packed_vectors(rows: DataFrame, keys: list[str], packing: Packing) -> DataFrame:
    """Rows (keys, pos, v) to one packed vector ``v`` per key, zeros filled in, and ``beyond``:
    whether a lane is beyond its limit, so that sums of such vectors might run over.

    A key has each position at most once, so a key's rows are bounded by the layout.
    """
    return wide.scatter(spread(rows, *keys).sortWithinPartitions(*keys), keys, packing)


def dense_vectors(rows: DataFrame, keys: list[str], fields: dict[str, int]) -> DataFrame:
    """Rows (keys, pos, v) to one ``array<bigint>`` per key, one word a lane, zeros filled in."""
    return packed_vectors(rows, keys, Packing(fields, {}, 1)).drop("beyond")


def rebuild_lanes(vectors: DataFrame, keys: list[str], fields: dict[str, int], vector: str = "v") -> DataFrame:
    """Dense vectors back to the long lane table, without zeros."""
    return name_lanes(vectors.select(*keys, F.posexplode(vector).alias("pos", "v")).filter("v <> 0"), fields)


# ---------------------------------------------------------------- web telemetry

# Grid of a main page and the number of pages.
GRID_X, GRID_Y, PAGES, MAIN_PAGES = 20, 11, 100, 3

WEB_TIMINGS = ("pageNetworkTime", "pageTransferTime", "pageLoadTime", "pageServerTime")


def _web_fields() -> dict[str, int]:
    out = {"pageExit": PAGES, "pageView": PAGES}
    for t in WEB_TIMINGS:
        out |= {f"{t}Sum": PAGES, f"{t}SumOfSquares": PAGES, f"{t}Count": PAGES}
    for kind, n in (("Userflow", PAGES), ("ClickGrid", GRID_X * GRID_Y), ("HoverGrid", GRID_X * GRID_Y)):
        out |= {f"page{m}{kind}": n for m in range(MAIN_PAGES)}
    return out | {"count": 1}


WEB_FIELDS = _web_fields()
#: Bits of a packed lane: counts 16, sums of timings 32, the count of events 64.
WEB_BITS = {f: 64 if f == "count" else 32 if f.endswith(("Sum", "SumOfSquares")) else 16 for f in WEB_FIELDS}


def _entries(df: DataFrame, keys: list[str], maps: dict[str, str]) -> DataFrame:
    """Rows (keys, field, key, n) of several map columns; empty maps give none."""
    each = F.array(*[
        F.struct(F.lit(name).alias("field"), F.map_entries(m).alias("entries")) for name, m in maps.items()
    ])
    rows = df.select(*keys, F.explode(each).alias("_f"))
    rows = rows.select(*keys, F.col("_f.field").alias("field"), F.explode("_f.entries").alias("_e"))
    return rows.select(*keys, "field", F.col("_e.key").alias("key"), F.col("_e.value").cast("bigint").alias("n"))


def web_pages(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exit and view counts per page."""
    e = _entries(df, keys, {"pageExit": "pageExit", "pageView": "pageView"})
    return e.groupBy(*keys, "field", F.col("key").cast("bigint").alias("page")).agg(F.sum("n").alias("v"))


def web_timings(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sum and sum of squares of each timing per page."""
    e = _entries(df, keys, {t: t for t in WEB_TIMINGS})
    return e.groupBy(*keys, "field", F.col("key").cast("bigint").alias("page")).agg(
        F.count("*").alias("n"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")
    )


def _parts(rows: DataFrame, names: list[str]) -> DataFrame:
    parts = F.split("key", "_")
    return rows.select("*", *[parts[i].cast("bigint").alias(n) for i, n in enumerate(names)])


def web_flow(df: DataFrame, keys: list[str]) -> DataFrame:
    """Moves from each main page to every page."""
    e = _parts(_entries(df, keys, {"pageUserFlow": "pageUserFlow"}), ["page", "target"])
    return e.groupBy(*keys, "page", "target").agg(F.sum("n").alias("v"))


def web_grid(df: DataFrame, keys: list[str]) -> DataFrame:
    """Clicks and hovers per grid cell of each main page."""
    e = _parts(_entries(df, keys, {"clickGrid": "clickGrid", "hoverGrid": "hoverGrid"}), ["page", "x", "y"])
    cell = F.col("x") * GRID_Y + F.col("y")
    return e.groupBy(*keys, "field", "page", cell.alias("cell")).agg(F.sum("n").alias("v"))


def web_position_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """All sums of web events as (keys, pos, v), in one pass.

    Every map entry of an event adds to positions of the flat vector, and all go
    through one partially aggregated sum with a number as its key.  An event with a key
    off its axis adds to one position behind the vector, and 0 to the count, so that
    its producer still sends a vector.
    """
    at = offsets(WEB_FIELDS)
    slot = lambda pos, v: F.struct(pos.cast("bigint").alias("pos"), v.cast("bigint").alias("v"))
    part = lambda e, i: F.split(e["key"], "_")[i].cast("bigint")
    each = lambda m, fn: F.transform(F.map_entries(m), fn)
    amount = {
        "Sum": lambda e: e["value"],
        "SumOfSquares": lambda e: e["value"].cast("bigint") * e["value"].cast("bigint"),
        "Count": lambda e: F.lit(1),
    }
    by_page = lambda field, v: (lambda e: slot(_lane(e["key"].cast("bigint"), PAGES) + at[field], v(e)))
    # The fields of the main pages follow each other, so the page moves the position.
    by_cell = lambda kind: (lambda e: slot(
        _lane(part(e, 0), MAIN_PAGES) * (GRID_X * GRID_Y) + _lane(part(e, 1), GRID_X) * GRID_Y
        + _lane(part(e, 2), GRID_Y) + at[f"page0{kind}"], e["value"],
    ))
    flow = lambda e: slot(
        _lane(part(e, 0), MAIN_PAGES) * PAGES + _lane(part(e, 1), PAGES) + at["page0Userflow"], e["value"]
    )
    lists = [each(m, by_page(m, amount["Sum"])) for m in ("pageExit", "pageView")]
    lists += [each(t, by_page(t + suffix, v)) for t in WEB_TIMINGS for suffix, v in amount.items()]
    lists += [each("pageUserFlow", flow), each("clickGrid", by_cell("ClickGrid")), each("hoverGrid", by_cell("HoverGrid"))]
    lists.append(F.array(slot(F.lit(at["count"]), F.lit(1))))
    off = F.array(slot(F.lit(n_lanes(WEB_FIELDS)), F.lit(1)), slot(F.lit(at["count"]), F.lit(0)))
    rows = df.select(*keys, F.explode(F.when(web_in_range(), F.concat(*lists)).otherwise(off)).alias("_l"))
    sums = rows.groupBy(*keys, "_l.pos").agg(F.sum("_l.v").alias("v"))
    return sums.filter((F.col("v") != 0) | (F.col("pos") == at["count"]))


def web_lane_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long lane table (keys, field, lane, v) of all sums of web events, with the field ``quarantine``."""
    return name_lanes(web_position_totals(df, keys).filter("v <> 0"), WEB_FIELDS | {QUARANTINE: 1})


def in_vector(rows: DataFrame, fields: dict[str, int]) -> DataFrame:
    """Rows (keys, pos, v) without those behind the vector."""
    return rows.filter(F.col("pos") < n_lanes(fields))


def web_in_range() -> Column:
    """Every map key lies on its axis: pages, main pages and grid cells."""
    page = lambda k: (k.try_cast("bigint") >= 0) & (k.try_cast("bigint") < PAGES)
    part = lambda k, i: F.get(F.split(k, "_"), F.lit(i)).try_cast("bigint")
    main = lambda k: (part(k, 0) >= 0) & (part(k, 0) < MAIN_PAGES)
    cell = lambda k: main(k) & (part(k, 1) >= 0) & (part(k, 1) < GRID_X) & (part(k, 2) >= 0) & (part(k, 2) < GRID_Y)
    flow = lambda k: main(k) & (part(k, 1) >= 0) & (part(k, 1) < PAGES)
    ok = lambda m, test: F.forall(F.map_keys(m), lambda k: F.coalesce(test(k), F.lit(False)))
    checks = [ok("pageUserFlow", flow), ok("clickGrid", cell), ok("hoverGrid", cell)]
    checks += [ok(m, page) for m in ("pageExit", "pageView", *WEB_TIMINGS)]
    total = checks[0]
    for c in checks[1:]:
        total = total & c
    return total

"""Itinerary search for whole tables of requests.

Paths start at a distinct (date, origin) and are shared by all requests from there. A hop
joins the paths with the stored connections on (date, last leg); a path that would enter
an airport twice is dropped at that hop, which equals checking the finished path, because
a repeat in a prefix stays a repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import iso, leg_id, minutes_between, shift_minutes
from skyloom.functions.codes import carrier_family
from skyloom.functions.times import epoch_minute
from skyloom.operators.requests import normalise_requests
from skyloom.storage import drop_stage, stage

SPEC = ["flightdate", "origin", "dest", "depart_after", "arrive_before", "min_stops", "max_stops", "limit"]
SEP = ">"
#: Connections from which a search looks for bounds first, and one leg in how many it does so over.
BOUNDED_FROM = 2_000_000
BOUND_SHARE = 16
#: While nothing is bounded yet, one first leg in how many is grown.
FIRST_SHARE = 4
#: Minutes of UTC in which two landings count as the same time when bounds are worked out.
SLOT = 5
#: A stored table of so many classes at most is sent to every task.
FEW_ROWS = 300_000


def first_legs(legs: DataFrame, starts: DataFrame) -> DataFrame:
    """Paths of one leg from each start, not before its earliest bound.

    A path keeps its lists as joined text, half as wide in a shuffle as arrays of strings:
    ``legs`` AA|12>AA|90, ``route`` >LGA>ATL>DFW>, ``waits`` 55.
    """
    earliest = F.col("earliest")
    begin = starts.select(
        F.col("flightdate").alias("start_date"), F.col("origin").alias("start"), "earliest", "deepest"
    )
    return (
        legs.join(begin, (F.col("origin") == F.col("start")) & (F.col("flightdate") == F.col("start_date")))
        .filter(earliest.isNull() | (F.col("scheduled_departure_time") >= earliest))
        .select(
            "flightdate",
            "start",
            "deepest",
            F.concat_ws(
                "|", "reporting_airline", F.col("flight_number_reporting_airline").cast("string")
            ).alias("legs"),
            F.concat(F.lit(SEP), "origin", F.lit(SEP), "dest", F.lit(SEP)).alias("route"),
            leg_id().alias("last"),
            F.col("dest").alias("at"),
            F.col("scheduled_departure_time").alias("departs"),
            F.col("scheduled_departure_utc").alias("departs_utc"),
            F.col("scheduled_arrival_time").alias("arrives"),
            F.col("scheduled_arrival_utc").alias("arrives_utc"),
            F.col("scheduled_duration_minutes").alias("air_minutes"),
            F.lit("").alias("waits"),
            F.lit(0).alias("waiting"),
        )
    )


def revisits(route: Column, airport: Column) -> Column:
    return F.contains(route, F.concat(F.lit(SEP), airport, F.lit(SEP)))


def _bare(level: DataFrame) -> DataFrame:
    """Paths of one leg without what follows from their start and end."""
    return level.drop("route", "waits", "waiting", "arrives", "arrives_utc")


def extend(
    paths: DataFrame, connections: DataFrame, acyclic: bool = True, most: DataFrame | None = None
) -> DataFrame:
    """One more leg on every path.

    The leg comes before the date in the join key: its first bytes tell rows apart, so the
    sort of a sort-merge join is decided on the key prefix. ``most`` (see ``Limits``) drops what
    takes too long, before any text is put together.
    """
    hop = connections.select(
        F.col("from_leg").alias("last"),
        "flightdate",
        "to_leg",
        "to_dest",
        F.col("layover_minutes").alias("wait"),
        "to_block",
        "to_arrives",
        "to_arrives_utc",
    )
    out = paths.join(hop, ["last", "flightdate"])
    if "route" not in paths.columns:
        route = F.concat(F.lit(SEP), "start", F.lit(SEP), "at", F.lit(SEP))
        out = out.withColumns({"route": route, "waits": F.lit(""), "waiting": F.lit(0)})
    if acyclic:
        out = out.filter(~revisits(F.col("route"), F.col("to_dest")))
    if most is not None:
        taken = F.col("air_minutes") + F.col("waiting") + F.col("wait") + F.col("to_block")
        after = most.select("flightdate", "start", F.col("prev").alias("at"), F.col("at").alias("to_dest"), F.col("slot").alias("to_slot"), "most")
        out = out.withColumn("to_slot", _slot(epoch_minute("to_arrives_utc")))
        out = out.join(after, ["flightdate", "start", "at", "to_dest", "to_slot"])
        out = out.filter(F.col("most").isNull() | (taken <= F.col("most")))
    wait = F.col("wait").cast("string")
    return out.select(
        "flightdate",
        "start",
        "deepest",
        F.concat_ws(SEP, "legs", F.substring_index("to_leg", "|", 2)).alias("legs"),
        F.concat("route", "to_dest", F.lit(SEP)).alias("route"),
        F.col("to_leg").alias("last"),
        F.col("to_dest").alias("at"),
        "departs",
        "departs_utc",
        F.col("to_arrives").alias("arrives"),
        F.col("to_arrives_utc").alias("arrives_utc"),
        (F.col("air_minutes") + F.col("to_block")).alias("air_minutes"),
        F.when(F.col("waits") == "", wait).otherwise(F.concat_ws(SEP, "waits", wait)).alias("waits"),
        (F.col("waiting") + F.col("wait")).alias("waiting"),
    )


def chains(
    starts: DataFrame, wanted: DataFrame, legs: DataFrame, connections: DataFrame, max_stops: int, mixed: bool,
    limits: Limits | None = None, some: int = 0, until: list[DataFrame] | None = None,
) -> list[DataFrame]:
    """Acyclic paths by number of stops, 0..max_stops.

    A level that is both answered from and extended is written once. The last hop only
    reads connections that land where somebody wants to go, before the latest deadline of
    those who want it (none, if one of them has no deadline).

    With ``limits`` a path, or a connection, that cannot become one of the best is dropped as soon
    as that is known. ``some`` grows the paths over one leg in so many only. ``until`` (see
    ``latest_landings``) drops what lands too late for any deadline.
    """
    deadline = F.col("arrive_before") if "arrive_before" in wanted.columns else F.lit(None).cast("timestamp_ntz")
    ends = wanted.groupBy("flightdate", F.col("dest").alias("to_dest")).agg(
        F.when(F.count(deadline) == F.count("*"), F.max(deadline)).alias("latest")
    )
    level = first_legs(legs, starts)
    if until is not None:
        level = _in_time(level, until[max_stops], "at", "arrives_utc")
    levels = [level]
    for stops in range(1, max_stops + 1):
        hops = connections
        if until is not None and stops < max_stops:
            hops = _in_time(hops, until[max_stops - stops], "to_dest", "to_arrives_utc")
        if some:
            hops = hops.filter(_in_sample(max_stops, stops, some, first=limits is None))
            if stops == 1 and limits is None:
                level = level.filter(_chosen("last", FIRST_SHARE if max_stops > 1 else some))
            if stops == 2 or max_stops == 1:
                level = level.filter(_chosen("last", some))
        if stops == max_stops:
            hops = hops.join(ends, ["flightdate", "to_dest"]).filter(
                F.col("latest").isNull() | (F.col("to_arrives") < F.col("latest"))
            )
        if mixed:
            level = level.filter(F.col("deepest") >= stops)
        most = None
        if limits is not None:
            level, hops, most = limits.cut(level, hops, stops)
        level = extend(_bare(level) if stops == 1 else level, hops, most=most)
        if stops < max_stops:
            level = stage(level, f"paths-{stops}")
        levels.append(level)
    return levels


def latest_landings(
    specs: DataFrame, legs: DataFrame, connections: DataFrame, max_stops: int, hop: DataFrame | None = None
) -> list[DataFrame]:
    """By number of hops still allowed: flightdate, at, ``until``. Who lands there later, in UTC, meets
    no deadline of any spec, whatever connections follow; null if any landing may do. A row per airport
    and date at most.

    Local deadlines are put on the UTC scale by the least that an airport's clock is ahead of it. ``hop``
    (see ``fewest_hop_minutes``) stands for the connections, which are not read once more then.
    """
    hop = fewest_hop_minutes(connections) if hop is None else hop
    ends = specs.groupBy("flightdate", F.col("dest").alias("at")).agg(_known_or_null(F.max, "arrive_before").alias("latest"))
    ahead = legs.groupBy("flightdate", F.col("dest").alias("at")).agg(
        F.min(F.col("scheduled_arrival_time") - F.col("scheduled_arrival_utc")).alias("ahead")
    )
    ends = ends.join(ahead, ["flightdate", "at"], "left").select("flightdate", "at", (F.col("latest") - F.col("ahead")).alias("until"))
    steps = [stage(ends, "landings-0")]
    for hops in range(1, max_stops + 1):
        onward = hop.join(steps[-1].withColumnRenamed("at", "to_dest"), ["flightdate", "to_dest"])
        onward = onward.filter(F.col("until").isNull() | (F.col("out_slot") <= _slot(epoch_minute("until"))))
        # The end of the slot in which one must be there.
        slot = onward.groupBy("flightdate", F.col("hub").alias("at")).agg(F.max("in_slot").alias("slot"))
        lands = shift_minutes(F.expr("timestamp_ntz'1970-01-01 00:00:00'"), (F.col("slot") + 1) * SLOT)
        every = steps[-1].unionByName(slot.select("flightdate", "at", lands.alias("until")))
        steps.append(stage(every.groupBy("flightdate", "at").agg(_known_or_null(F.max, "until").alias("until")), f"landings-{hops}"))
    return steps


def _in_time(rows: DataFrame, until: DataFrame, airport: str, lands: str) -> DataFrame:
    kept = rows.join(until.withColumnRenamed("at", airport), ["flightdate", airport])
    return kept.filter(F.col("until").isNull() | F.col(lands).isNull() | (F.col(lands) <= F.col("until"))).drop("until")


def _chosen(leg: str, share: int) -> Column:
    return F.pmod(F.xxhash64(leg), F.lit(share)) == 0


def _in_sample(max_stops: int, stops: int, some: int, first: bool) -> Column:
    """Connections that the paths over one leg in ``some`` take as their hop ``stops``."""
    if max_stops == 1 or stops == 2:
        return _chosen("from_leg", some)
    if stops > 2:
        return F.lit(True)
    return _chosen("to_leg", some) & (_chosen("from_leg", FIRST_SHARE) if first else F.lit(True))


def _slot(minute: Column) -> Column:
    return F.floor(minute / SLOT).cast("int")


def _with_slots(connections: DataFrame) -> DataFrame:
    """``in_slot`` and ``out_slot``: when the first leg lands, and when the second does."""
    lands = epoch_minute("to_arrives_utc")
    return connections.withColumns({"in_slot": _slot(lands - _hop_minutes()), "out_slot": _slot(lands)})


#: What a search reads of a connection.
SEARCHED = [
    "flightdate", "from_leg", "to_leg", "from_origin", "hub", "to_dest", "layover_minutes", "to_block", "to_arrives", "to_arrives_utc",
]
HOP = ["flightdate", "from_origin", "hub", "to_dest", "in_slot", "out_slot"]
CLASS = ["flightdate", "start", "prev", "at", "slot"]


def fewest_hop_minutes(connections: DataFrame) -> DataFrame:
    """Fewest minutes of any connection between the same airports at the same times. At most a row per
    three airports and two times, whatever the number of connections; a null slot if one has no times."""
    return stage(_with_slots(connections).groupBy(*HOP).agg(F.min(_hop_minutes()).alias("minutes")), "fewest-hop-minutes")


class Limits:
    """How many minutes a path may have taken and still be among the best of some spec.

    ``asked`` holds flightdate, start, dest and ``bound``: no answer of the pair takes longer; null
    if that is not known. Paths are told apart by start, the airport before the last, the last, and the
    slot of time in which they land there: what is left to do takes at least the fewest minutes
    of any connections that lead on from the same airports at the same time. A pair without any such way
    bounds nothing. All tables here are made of such classes and not of paths.
    """

    def __init__(
        self, asked: DataFrame, connections: DataFrame, max_stops: int,
        hop: DataFrame | None = None, until: DataFrame | None = None, first: DataFrame | None = None,
    ):
        self.asked, self.max_stops, self.first = asked, max_stops, first
        self.hop = fewest_hop_minutes(connections) if hop is None else hop
        ends = self.hop.select("flightdate", F.col("hub").alias("prev"), F.col("to_dest").alias("at"), F.col("out_slot").alias("slot"))
        ends = ends.distinct().join(asked.select("flightdate", F.col("dest").alias("at")).distinct(), ["flightdate", "at"])
        if until is not None:
            ends = ends.join(until, ["flightdate", "at"])
            ends = ends.filter(F.col("until").isNull() | (F.col("slot") <= _slot(epoch_minute("until"))))
        rest = ends.select("flightdate", "prev", "at", "slot", F.col("at").alias("dest"), F.lit(0).alias("rest"))
        #: By number of hops still allowed: flightdate, prev, at, slot, dest, fewest minutes.
        self.rest = [stage(rest, "fewest-minutes-0")]
        for hops in range(1, max_stops):
            onward = self._onward(self.hop, hops - 1).filter(F.col("dest") != F.col("from_origin"))
            names = {"from_origin": "prev", "hub": "at", "in_slot": "slot"}
            onward = onward.withColumnsRenamed(names).withColumn("rest", F.col("minutes") + F.col("rest"))
            every = self.rest[-1].unionByName(onward.select(*self.rest[-1].columns))
            every = every.groupBy("flightdate", "prev", "at", "slot", "dest").agg(F.min("rest").alias("rest"))
            self.rest.append(stage(every, f"fewest-minutes-{hops}"))

    def _onward(self, hops: DataFrame, left: int) -> DataFrame:
        """Hops beside every airport that ``left`` more of them reach, and how soon."""
        rest = self.rest[left].withColumnsRenamed({"prev": "hub", "at": "to_dest", "slot": "out_slot"})
        return hops.join(rest, ["flightdate", "hub", "to_dest", "out_slot"])

    def _ways(self, taken: DataFrame, stops: int) -> DataFrame:
        """Hops that may follow on paths of so few minutes, and the minutes after which one must be there."""
        taken = taken.withColumnsRenamed({"prev": "from_origin", "at": "hub", "slot": "in_slot"})
        ways = taken.join(self.hop, ["flightdate", "from_origin", "hub", "in_slot"]).filter(F.col("to_dest") != F.col("start"))
        ways = self._onward(ways, self.max_stops - stops).join(self.asked, ["flightdate", "start", "dest"])
        ways = ways.withColumn("most", F.col("bound") - F.col("rest")).groupBy(*HOP, "start", "fewest", "minutes")
        ways = ways.agg(_known_or_null(F.max, "most").alias("most"))
        return stage(ways.filter(F.col("most").isNull() | (F.col("fewest") + F.col("minutes") <= F.col("most"))), f"ways-{stops}")

    def useful(self, connections: DataFrame) -> DataFrame:
        """Connections that can be part of an answer, at any place in it."""
        ways = [self._ways(self.first, 1)]
        for stops in range(2, self.max_stops + 1):
            ended = ways[-1].groupBy("flightdate", "start", F.col("hub").alias("prev"), F.col("to_dest").alias("at"), F.col("out_slot").alias("slot"))
            taken = ended.agg(F.min(F.col("fewest") + F.col("minutes")).alias("fewest"))
            ways.append(self._ways(taken, stops))
        return _capped(connections, stage(_at_most(reduce(DataFrame.unionByName, ways), HOP, "fewest"), "hop-caps"))

    def cut(self, level: DataFrame, hops: DataFrame, stops: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Before the join: paths and connections that no answer is made of are left out. Beside them, the
        minutes that a path may have taken after the hop: flightdate, start, prev, at, slot, most."""
        taken = self.first if stops == 1 and self.first is not None else fewest_taken(level, stops)
        ways = self._ways(taken, stops)
        kept = _capped(hops, stage(_at_most(ways, HOP, "fewest"), f"hop-caps-{stops}"))
        before = _at_most(ways, ["flightdate", "start", "from_origin", "hub", "in_slot"], "minutes")
        before = stage(before.withColumnsRenamed({"from_origin": "prev", "hub": "at", "in_slot": "slot"}), f"allowed-before-{stops}")
        level = _classes(level).join(before, CLASS).filter(F.col("most").isNull() | (F.col("taken") <= F.col("most")))
        after = ways.groupBy("flightdate", "start", "hub", "to_dest", "out_slot").agg(_known_or_null(F.max, "most").alias("most"))
        after = stage(after.withColumnsRenamed({"hub": "prev", "to_dest": "at", "out_slot": "slot"}), f"allowed-{stops}")
        return level.drop("prev", "slot", "taken", "most"), kept, after


def _classes(level: DataFrame) -> DataFrame:
    prev = F.substring_index(F.substring_index("route", SEP, -3), SEP, 1)
    return level.withColumns(
        {"prev": prev, "slot": _slot(epoch_minute("arrives_utc")), "taken": F.col("air_minutes") + F.col("waiting")}
    )


def fewest_taken(level: DataFrame, stops: int) -> DataFrame:
    """By class of paths: flightdate, start, prev, at, slot, fewest minutes that one of them took."""
    return stage(_classes(level).groupBy(*CLASS).agg(F.min("taken").alias("fewest")), f"fewest-taken-{stops}")


def _at_most(ways: DataFrame, by: list[str], minutes: str) -> DataFrame:
    left = ways.withColumn("left", F.col("most") - F.col(minutes))
    return left.groupBy(*by).agg(_known_or_null(F.max, "left").alias("most"))


def _capped(connections: DataFrame, caps: DataFrame) -> DataFrame:
    """Connections within the cap of their class, ``caps`` being a stored table."""
    if caps.count() <= FEW_ROWS:
        caps = F.broadcast(caps)  # its size is known: the connections need not be shuffled
    kept = _with_slots(connections).join(caps, HOP)
    return kept.filter(F.col("most").isNull() | (_hop_minutes() <= F.col("most"))).select(*connections.columns)


def _hop_minutes() -> Column:
    return F.col("layover_minutes") + F.col("to_block")


def _known_or_null(of, column: str) -> Column:
    return F.when(F.count(column) == F.count(F.lit(1)), of(column))


def _found(levels: list[DataFrame], ask: DataFrame, least: int = 0) -> DataFrame:
    """The paths that answer a spec, with all columns of both. None is asked to have fewer than ``least`` stops."""
    paths = reduce(
        DataFrame.unionByName,
        [level.drop("last", "deepest").withColumn("stops", F.lit(k)) for k, level in enumerate(levels) if k >= least],
    )
    fits = (
        F.col("stops").between(F.col("min_stops"), F.col("max_stops"))
        & (F.col("depart_after").isNull() | (F.col("departs") >= F.col("depart_after")))
        & (F.col("arrive_before").isNull() | (F.col("arrives") < F.col("arrive_before")))
    )
    found = paths.join(ask, ["start", "at", "flightdate"]).filter(fits)
    found = found.withColumn("total_minutes", F.col("air_minutes") + F.col("waiting"))
    if "bound" in ask.columns:
        total, until = F.col("total_minutes"), F.col("departs_until")
        last = (total == F.col("bound")) & (until.isNull() | (F.col("departs_utc") <= until))
        found = found.filter(F.col("bound").isNull() | (total < F.col("bound")) | last)
    return found


def _bounds(found: DataFrame) -> DataFrame:
    """spec, bound, departs_until: total and departure (UTC, null if any) of the ``limit``-th best of ``found``,
    which may be any share of all paths: more paths can only lower it. Counted per total and minute, no path is sorted."""
    by = ["total_minutes", "departs_utc"]
    counts = found.filter(F.col("total_minutes").isNotNull()).groupBy("spec", "limit", *by).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("spec").orderBy("total_minutes", F.col("departs_utc").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") >= F.col("limit"))
    # The first row that reaches the limit, and only that one.
    reached = reached.filter(F.col("upto") - F.col("n") < F.col("limit"))
    return reached.select("spec", F.col("total_minutes").alias("bound"), F.col("departs_utc").alias("departs_until"))


def _block_apart(legs: DataFrame) -> bool:
    """Whether the UTC times of every leg that has them are its block time apart."""
    departs, arrives = F.col("scheduled_departure_utc"), F.col("scheduled_arrival_utc")
    block = epoch_minute(arrives) - epoch_minute(departs) == F.col("scheduled_duration_minutes")
    return legs.filter(departs.isNotNull() & arrives.isNotNull() & ~F.coalesce(block, F.lit(False))).isEmpty()


def solve_specs(
    specs: DataFrame, legs: DataFrame, connections: DataFrame, bounded_from: int | None = None
) -> DataFrame:
    """Ranked itineraries of distinct, valid request specs (``spec`` is their number).

    From ``bounded_from`` connections on (``BOUNDED_FROM``), paths over a share of the legs are grown first. Their
    ``limit``-th best is a bound for each spec: of all paths, those that take longer are dropped
    before they are shuffled or ranked. A first round looks at few legs, so that it takes the same time however many
    there are; its bounds make the second, over one in ``BOUND_SHARE``, cheap. Answers are the same with and without.
    """
    bounds = specs.agg(
        F.max("max_stops"), F.min("max_stops"), F.max("limit"), F.count("arrive_before"), F.min("min_stops")
    ).first()
    max_stops, mixed, max_limit, least = bounds[0] or 0, bounds[0] != bounds[1], bounds[2] or 1, bounds[4] or 0
    # A start without any bound on one of its requests must keep all its legs.
    starts = specs.groupBy("flightdate", "origin").agg(
        F.when(F.count("depart_after") == F.count("*"), F.min("depart_after")).alias("earliest"),
        F.max("max_stops").alias("deepest"),
    )
    ask = specs.select(
        "spec",
        "flightdate",
        F.col("origin").alias("start"),
        F.col("dest").alias("at"),
        "depart_after",
        "arrive_before",
        "min_stops",
        "max_stops",
        "limit",
    )
    limits = until = hop = None
    size = connections.count() if max_stops > 0 else 0
    if max_stops > 0 and size >= (BOUNDED_FROM if bounded_from is None else bounded_from) and _block_apart(legs):
        reach = connections.select(*SEARCHED)
        hop = fewest_hop_minutes(reach)
        if not hop.filter(F.col("in_slot").isNull() | F.col("out_slot").isNull()).isEmpty():
            hop = None  # a connection without times can follow at any time
    if hop is not None:
        if bounds[3]:
            until = latest_landings(specs, legs, reach, max_stops, hop)
            reach = _in_time(reach, until[max_stops - 1], "to_dest", "to_arrives_utc")
        share = BOUND_SHARE * max(1, size // (BOUND_SHARE * BOUNDED_FROM)) if BOUNDED_FROM else BOUND_SHARE
        ask = ask.withColumns({"bound": F.lit(None).cast("int"), "departs_until": F.lit(None).cast("timestamp_ntz")})
        first = fewest_taken(first_legs(legs, starts), 1)
        near = reach
        if max_stops <= 2:
            sampled = [_in_sample(max_stops, k, share, first=True) for k in range(1, max_stops + 1)]
            near = stage(reach.filter(reduce(Column.__or__, sampled)), "sampled-connections")
        for rough, some in ((True, share), (False, BOUND_SHARE)):
            levels = chains(starts, specs, legs, near, max_stops, mixed, limits, some, until)
            bound = _bounds(_found(levels, ask, least)).withColumnsRenamed({"bound": "lower", "departs_until": "earlier"})
            # What is found lies within the bounds so far; too little of it leaves them as they are.
            ask = ask.join(bound, "spec", "left").withColumns({
                "departs_until": F.when(F.col("lower").isNotNull(), F.col("earlier")).otherwise(F.col("departs_until")),
                "bound": F.coalesce("lower", "bound"),
            }).drop("lower", "earlier")
            ask = stage(ask, "bounded-specs")
            for level in levels[1:-1]:
                drop_stage(level)
            pairs = ask.groupBy("flightdate", "start", F.col("at").alias("dest"))
            pairs = stage(pairs.agg(_known_or_null(F.max, "bound").alias("bound")), "bounded-pairs")
            limits = Limits(pairs, reach, max_stops, hop, until and until[0], first)
            if rough:
                if near is not reach:
                    drop_stage(near)
                near = stage(limits.useful(reach), "useful-connections")
        connections = near
    levels = chains(starts, specs, legs, connections, max_stops, mixed, limits, until=until)
    found = _found(levels, ask, least)
    # The literal bound lets Spark cut each task's share before the shuffle, so a request
    # with millions of paths never gathers them in one task.
    best = Window.partitionBy("spec").orderBy(
        F.col("total_minutes").asc_nulls_last(), F.col("departs_utc").asc_nulls_last(), "legs", "route"
    )
    ranked = found.withColumn("rank", F.row_number().over(best))
    ranked = ranked.filter(F.col("rank") <= max_limit).filter(F.col("rank") <= F.col("limit"))
    leg_list = F.split("legs", SEP)
    return ranked.select(
        "spec",
        "rank",
        "stops",
        F.transform(leg_list, lambda x: F.replace(x, F.lit("|"), F.lit(""))).alias("flights"),
        _route_list().alias("route"),
        F.transform(leg_list, lambda x: F.split_part(x, F.lit("|"), F.lit(1))).alias("carriers"),
        "departs",
        "arrives",
        "departs_utc",
        "arrives_utc",
        "air_minutes",
        F.when(F.col("waits") == "", F.array())
        .otherwise(F.split("waits", SEP))
        .cast("array<int>")
        .alias("layover_minutes"),
        "total_minutes",
    )


def _route_list() -> Column:
    return F.split(F.btrim("route", F.lit(SEP)), SEP)


def _spec_key() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in SPEC])


def of_days(df: DataFrame, days: list) -> DataFrame:
    """Literal dates prune the partitions of a stored table before anything is read."""
    return df.filter(F.col("flightdate").isin(*days)) if days else df.filter("false")


def _days(df: DataFrame) -> list:
    """The distinct dates of requests: as many as there are days in the calendar they cover."""
    return [r[0] for r in df.select("flightdate").filter("flightdate is not null").distinct().collect()]


def search(
    requests: DataFrame,
    legs: DataFrame,
    connections: DataFrame,
    served: bool = False,
    built: DataFrame | None = None,
) -> DataFrame:
    """Answer every request: status, and up to ``limit`` itineraries by total journey time.

    ``bad_request`` carries the fault; ``not_built`` refuses a connecting search on a date
    without connections rather than passing nonstops off as the whole answer; ``empty``
    says whether its date could have been searched. Equal requests are solved once.

    ``built`` holds the dates that have connections; without it they are looked up among the
    dates asked for. Legs and connections of other dates are not read.
    """
    asked = normalise_requests(requests, served)
    if built is None:
        built = of_days(connections, _days(asked))
    built = built.select("flightdate").distinct().withColumn("searchable", F.lit(True))
    asked = asked.join(built, "flightdate", "left").withColumn(
        "searchable", F.coalesce("searchable", F.lit(False))
    )
    refused = (F.col("max_stops") > 0) & ~F.col("searchable")
    asked = asked.withColumn(
        "status",
        F.when(F.col("error").isNotNull(), "bad_request").when(refused, "not_built").otherwise("ok"),
    )
    # Both tables are stored: every level of the search reads the specs, and a stored table
    # has a known size, so Spark can tell whether it may be broadcast. The spec number is
    # drawn in the writing task itself, so a retried task cannot leave two numberings.
    asked = stage(asked.withColumn("key", F.when(F.col("status") == "ok", _spec_key())), "requests")
    ok = asked.filter(F.col("key").isNotNull())
    specs = ok.select("key", *SPEC).distinct()
    specs = stage(specs.withColumn("spec", F.monotonically_increasing_id()), "specs")
    days = _days(specs)
    answers = solve_specs(specs, of_days(legs, days), of_days(connections, days))
    numbered = ok.join(specs.select("key", "spec"), "key").join(answers, "spec", "left")
    # Refused requests skip the join, where they would all share one null key.
    refused = asked.filter(F.col("key").isNull())
    out = numbered.unionByName(refused, allowMissingColumns=True)
    empty = (F.col("status") == "ok") & F.col("rank").isNull()
    return out.select(
        "request_id",
        F.when(empty, "empty").otherwise(F.col("status")).alias("status"),
        "error",
        "searchable",
        *[c for c in answers.columns if c != "spec"],
    )


def as_text(itineraries: DataFrame) -> DataFrame:
    """Times as ISO text, ready for JSON."""
    times = ("departs", "arrives", "departs_utc", "arrives_utc")
    return itineraries.withColumns({c: iso(c) for c in times})


def itinerary_counts(legs: DataFrame, connections: DataFrame, max_stops: int = 2) -> DataFrame:
    """Acyclic itineraries per date, pair and number of stops, and the shortest journey.

    The last hop of two or more is counted and not listed: paths that go the same way into a leg
    are one row, connections from it to one airport another, and the two meet once.
    """
    starts = legs.select("flightdate", "origin").distinct()
    starts = starts.withColumn("earliest", F.lit(None).cast("timestamp_ntz")).withColumn(
        "deepest", F.lit(max_stops)
    )
    wanted = legs.select("flightdate", "dest").distinct()
    listed = chains(starts, wanted, legs, connections, max_stops, mixed=False) if max_stops < 2 else []
    if max_stops >= 2:
        listed = [first_legs(legs, starts)]
        for _ in range(max_stops - 1):
            level = extend(listed[-1], connections)
            listed.append(stage(level, f"paths-{len(listed)}") if len(listed) < max_stops - 1 else level)
    minutes = F.col("air_minutes") + F.col("waiting")
    pair = ["flightdate", F.col("start").alias("origin"), F.col("at").alias("dest")]
    best = [F.count(F.lit(1)).alias("itineraries"), F.min(minutes).alias("best_minutes")]
    if max_stops < 2:
        counts = [level.groupBy(*pair).agg(*best) for level in listed]
    else:
        ways = listed[-1].groupBy("flightdate", "start", "at", "route", "last").agg(*best)
        ways = stage(ways, "itinerary-ways")
        onward = connections.join(wanted.withColumnRenamed("dest", "to_dest"), ["flightdate", "to_dest"], "left_semi")
        onward = onward.groupBy("flightdate", F.col("from_leg").alias("last"), "to_dest").agg(
            F.count(F.lit(1)).alias("n"), F.min(_hop_minutes()).alias("minutes")
        )
        last = ways.join(onward, ["last", "flightdate"]).filter(~revisits(F.col("route"), F.col("to_dest")))
        counts = [level.groupBy(*pair).agg(*best) for level in listed[:-1]]
        counts.append(ways.groupBy(*pair).agg(F.sum("itineraries").alias("itineraries"), F.min("best_minutes").alias("best_minutes")))
        counts.append(
            last.groupBy("flightdate", F.col("start").alias("origin"), F.col("to_dest").alias("dest")).agg(
                F.sum(F.col("itineraries") * F.col("n")).alias("itineraries"),
                F.min(F.col("best_minutes") + F.col("minutes")).alias("best_minutes"),
            )
        )
    return reduce(DataFrame.unionByName, [c.withColumn("stops", F.lit(k)) for k, c in enumerate(counts)])


def by_stops(itineraries: DataFrame) -> DataFrame:
    """Re-rank each request's itineraries by stops first, then journey time."""
    order = Window.partitionBy("request_id").orderBy(
        "stops", F.col("total_minutes").asc_nulls_last(), F.array_join("flights", ">")
    )
    return itineraries.withColumn("rank", F.row_number().over(order))


def by_arrival(itineraries: DataFrame) -> DataFrame:
    """Re-rank by absolute arrival, comparable across airports."""
    order = Window.partitionBy("request_id").orderBy(
        F.col("arrives_utc").asc_nulls_last(), F.array_join("flights", ">")
    )
    return itineraries.withColumn("rank", F.row_number().over(order))


def itinerary_audit(itineraries: DataFrame, min_layover: int = 45, max_layover: int = 300) -> DataFrame:
    """Count itineraries that break an invariant; all but the first column must be zero."""
    rows = itineraries.filter(F.col("rank").isNotNull())
    waits = F.aggregate("layover_minutes", F.lit(0), lambda a, x: a + x)
    families = F.array_distinct(F.transform("carriers", lambda c: carrier_family(c)))
    span = minutes_between("departs_utc", "arrives_utc")
    timed = F.col("total_minutes").isNotNull()
    previous = F.lag("total_minutes").over(Window.partitionBy("request_id").orderBy("rank"))
    rows = rows.withColumn("previous", previous)
    return rows.agg(
        F.count("*").alias("itineraries"),
        F.count_if(F.col("previous") > F.col("total_minutes")).alias("unsorted"),
        F.count_if(timed & (F.col("total_minutes") != F.col("air_minutes") + waits)).alias("wrong_total"),
        F.count_if(timed & (F.col("total_minutes") != span)).alias("wrong_span"),
        F.count_if(F.size("route") != F.size(F.array_distinct("route"))).alias("cyclic"),
        F.count_if(F.size(families) != 1).alias("mixed_family"),
        F.count_if(F.size("flights") != F.col("stops") + 1).alias("wrong_stops"),
        F.count_if(
            F.exists("layover_minutes", lambda x: (x < min_layover) | (x > max_layover))
        ).alias("outside_window"),
    )


def chain_check(legs: DataFrame, connections: DataFrame, max_stops: int = 3) -> DataFrame:
    """Over every chain of 1..max_stops connections: how many have a leg that does not start where
    the one before ended, by the ends that the legs themselves state.

    Each edge is judged once, by its two legs; chains are counted, not listed: those of all edges,
    less those of sound edges only. A leg that is not in the table has no ends.
    """
    ends = legs.select("flightdate", leg_id().alias("leg"), "origin", "dest")
    first = ends.select("flightdate", F.col("leg").alias("from_leg"), F.col("dest").alias("ends_at"))
    second = ends.select("flightdate", F.col("leg").alias("to_leg"), F.col("origin").alias("starts_at"))
    edges = connections.select("flightdate", "from_leg", "to_leg")
    edges = edges.join(first, ["flightdate", "from_leg"], "left").join(second, ["flightdate", "to_leg"], "left")
    sound = F.coalesce(F.col("ends_at") == F.col("starts_at"), F.lit(False))
    edges = stage(edges.select("flightdate", "from_leg", "to_leg", sound.alias("sound")), "judged-edges")
    level = edges.groupBy("flightdate", F.col("to_leg").alias("last")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("sound").alias("good")
    )
    counts = []
    for stops in range(1, max_stops + 1):
        if stops > 1:
            hop = edges.withColumnRenamed("from_leg", "last")
            level = level.join(hop, ["flightdate", "last"]).groupBy("flightdate", F.col("to_leg").alias("last")).agg(
                F.sum("n").alias("n"), F.sum(F.when(F.col("sound"), F.col("good")).otherwise(0)).alias("good")
            )
        if stops < max_stops:
            level = stage(level, f"chain-counts-{stops}")
        total, good = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))
        counts.append(level.agg(total.alias("chains"), (total - good).alias("broken")).withColumn("stops", F.lit(stops)))
    return reduce(DataFrame.unionByName, counts)


def cyclic_census(
    legs: DataFrame, connections: DataFrame, max_stops: int = 3, origin: str | None = None, dest: str | None = None
) -> DataFrame:
    """Unguarded chains per date and depth: how many enter an airport twice, and how many come back
    to the start. Chains of up to three legs are rows by start, second airport and last leg; those of four are counted.

    Along a chain r0, r1, ... neighbours differ and no connection goes straight back, so with up
    to three stops only r3 = r0, r4 = r0 and r4 = r1 can happen; of these only the first and the
    last together. Hence cyclic = |r3 = r0| + |r4 = r0| + |r4 = r1| - |both|.
    """
    if max_stops > 3:
        raise ValueError("the census is worked out for up to three stops")
    leg = ["flightdate", "last"]
    hops = connections.select("flightdate", "from_leg", "to_leg", "from_origin", "to_dest")
    first = hops.filter(F.col("from_origin") == origin) if origin else hops
    # What is counted ends at ``dest``, if one is asked for.
    at_end = F.col("to_dest") == dest if dest else F.lit(True)
    flown = legs.filter(F.col("origin") == origin) if origin else legs
    flown = flown.filter(F.col("dest") == dest) if dest else flown

    def alone(rows: DataFrame, stops: int) -> DataFrame:
        """Chains of so many stops, none of which can be cyclic."""
        none = F.lit(0).cast("bigint")
        return rows.groupBy("flightdate").agg(F.count(F.lit(1)).alias("chains")).select(
            "flightdate", F.lit(stops).alias("stops"), "chains", none.alias("cyclic"), none.alias("back_to_origin")
        )

    parts = [alone(flown, 0)]
    if max_stops >= 1:
        parts.append(alone(first.filter(at_end), 1))
    if max_stops >= 2:
        # Ways into the last leg by start, and then one leg more: each row is (start, second airport, last leg).
        # Rows are dealt out by leg, once for counting and the join.
        into = first.select("flightdate", F.col("to_leg").alias("last"), F.col("from_origin").alias("start"))
        into = into.repartition(*leg).groupBy(*leg, "start").agg(F.count(F.lit(1)).alias("n"))
        hop = hops.select("flightdate", F.col("from_leg").alias("last"), F.col("to_leg").alias("next"), F.col("from_origin").alias("second"), "to_dest")
        chain = into.join(hop, leg).drop("last").withColumnRenamed("next", "last")
        n, home = F.col("n"), F.col("start") == F.col("to_dest")  # r3 = r0
        count = lambda value, name: F.coalesce(F.sum(value), F.lit(0)).alias(name)
        two = [count(F.when(at_end, n), "chains"), count(F.when(at_end & home, n), "home")]
        by_stops = [F.struct(F.lit(2).alias("stops"), "chains", F.col("home").alias("cyclic"), F.col("home").alias("back_to_origin"))]
    if max_stops >= 3:
        # Beside a last leg: how many connections lead on from it, in all and to each airport.
        out = hops.filter(at_end).select("flightdate", F.col("from_leg").alias("last"), F.col("to_dest").alias("end"))
        out = out.repartition(*leg).groupBy(*leg, "end").agg(F.count(F.lit(1)).alias("out"))
        end = F.when(F.col("end").isNotNull(), F.struct("end", "out"))
        out = out.groupBy(*leg).agg(F.sum("out").alias("out"), F.map_from_entries(F.collect_list(end)).alias("ends"))
        chain = chain.join(out, leg, "left")
        to = lambda airport: F.try_element_at("ends", F.col(airport))
        two += [
            count(n * F.col("out"), "chains3"),
            count(F.when(home, n * F.col("out")), "home3"),
            count(n * to("start"), "home4"),  # r4 = r0
            count(n * to("second"), "second4"),  # r4 = r1
            count(F.when(home, n * to("second")), "both"),
        ]
        back = F.col("home3") + F.col("home4")
        cyclic = back + F.col("second4") - F.col("both")
        by_stops.append(F.struct(F.lit(3).alias("stops"), F.col("chains3").alias("chains"), cyclic.alias("cyclic"), back.alias("back_to_origin")))
    if max_stops >= 2:
        parts.append(chain.groupBy("flightdate").agg(*two).select("flightdate", F.inline(F.array(*by_stops))))
    return reduce(DataFrame.unionByName, parts).filter(F.col("chains") > 0)

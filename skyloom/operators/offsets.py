"""Station offsets recovered from the legs, and the UTC times that follow from them.

For any leg, (local arrival - local departure) - block = offset(dest) - offset(origin).
Each directed pair thus gives one difference; the differences of a date form a graph, and
one known station puts the whole date on the UTC scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import minutes_between, shift_minutes, wrap_offset
from skyloom.schema import OFFSET_ANCHOR, STRONG_PAIR_FLIGHTS
from skyloom.storage import stage

DAY = 1440


class OffsetError(RuntimeError):
    """The records of a date do not determine its offsets."""


@dataclass(frozen=True)
class Solution:
    offsets: DataFrame  # flightdate, airport, offset_minutes
    issues: DataFrame  # flightdate, issue, detail


def pair_deltas(legs: DataFrame, by_date: bool = True) -> DataFrame:
    """Per directed pair: flights, smallest and largest difference.

    min = max says 'exactly one difference' and, unlike a collected set, merges map-side.
    An arrival stamped a day early is off by 1440, which the fold removes.
    """
    key = ["flightdate", "origin", "dest"] if by_date else ["origin", "dest"]
    apparent = minutes_between("scheduled_departure_time", "scheduled_arrival_time")
    delta = F.pmod(apparent - F.col("scheduled_duration_minutes") + 2 * DAY, F.lit(DAY))
    return (
        legs.filter(F.col("scheduled_duration_minutes").isNotNull())
        .select(*key, delta.alias("delta"))
        .groupBy(*key)
        .agg(
            F.count("*").alias("flights"),
            F.min("delta").alias("low"),
            F.max("delta").alias("high"),
        )
    )


def offset_deltas(legs: DataFrame, by_date: bool = True) -> DataFrame:
    """Pairs with exactly one difference."""
    pairs = pair_deltas(legs, by_date).filter(F.col("low") == F.col("high"))
    return pairs.withColumnRenamed("low", "delta").drop("high")


def contradictory_pairs(legs: DataFrame, by_date: bool = True) -> DataFrame:
    """Pairs with several differences: a data fault on one date, a clock change over many."""
    return pair_deltas(legs, by_date).filter(F.col("low") != F.col("high"))


def solve_offsets(
    deltas: DataFrame,
    anchor: tuple[str, int] = OFFSET_ANCHOR,
    dates: DataFrame | None = None,
    min_flights: int = STRONG_PAIR_FLIGHTS,
) -> Solution:
    """Solve all dates at once, one frontier join per round.

    The pair table holds at most airports^2 rows per date, whatever the number of legs.
    A round finds the neighbours of the stations found in the round before; every station
    not on the anchor's component is reported, and every pair is checked in the end, the
    thin ones included, so the order in which pairs are used cannot hide a conflict. Pairs with
    ``min_flights`` flights are used first, so that a faulty thin pair is the one reported.
    """
    anchor_code, anchor_minutes = anchor
    spark = deltas.sparkSession
    deltas = stage(deltas.select("flightdate", "origin", "dest", "flights", "delta"), "pair-deltas")
    edges = deltas.select("flightdate", F.col("origin").alias("here"), F.col("dest").alias("there"), "delta", "flights")
    edges = edges.union(edges.select("flightdate", "there", "here", -F.col("delta"), "flights"))
    stations = edges.select("flightdate", F.col("here").alias("airport")).distinct()

    known = stations.filter(F.col("airport") == anchor_code).withColumn(
        "value", F.pmod(F.lit(anchor_minutes), F.lit(DAY))
    )
    known = frontier = stage(known, "offsets-round")
    # Pairs that several flights agree on first; then one step over a thin pair, whose far
    # end may lead back to firm ones.
    firm = edges.filter(F.col("flights") >= min_flights)
    while not frontier.isEmpty():
        while not frontier.isEmpty():
            frontier = stage(_next_stations(frontier, firm, known), "offsets-round")
            known = known.union(frontier)
        frontier = stage(_next_stations(known, edges, known), "offsets-round")
        known = known.union(frontier)

    offsets = known.select("flightdate", "airport", wrap_offset("value").alias("offset_minutes"))
    return Solution(offsets, _issues(spark, deltas, stations, known, anchor_code, dates))


def _next_stations(frontier: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Stations one pair away from the frontier that aren't known yet."""
    return (
        frontier.withColumnRenamed("airport", "here")
        .join(edges, ["flightdate", "here"])
        .groupBy("flightdate", F.col("there").alias("airport"))
        .agg(F.min(F.pmod(F.col("value") + F.col("delta"), F.lit(DAY))).alias("value"))
        .join(known.select("flightdate", "airport"), ["flightdate", "airport"], "left_anti")
    )


def _issues(spark, deltas, stations, known, anchor_code, dates) -> DataFrame:
    start = known.select("flightdate", F.col("airport").alias("origin"), F.col("value").alias("from_value"))
    end = known.select("flightdate", F.col("airport").alias("dest"), F.col("value").alias("to_value"))
    gap = F.pmod(F.col("from_value") + F.col("delta") - F.col("to_value"), F.lit(DAY))
    conflict = (
        deltas.join(start, ["flightdate", "origin"])
        .join(end, ["flightdate", "dest"])
        .filter(gap != 0)
        .select(
            "flightdate",
            F.lit("conflict").alias("issue"),
            F.concat_ws("->", "origin", "dest").alias("detail"),
        )
    )
    solved_dates = known.select("flightdate").distinct()
    all_dates = stations.select("flightdate").distinct()
    no_anchor = all_dates.join(solved_dates, "flightdate", "left_anti").select(
        "flightdate", F.lit("no_anchor").alias("issue"), F.lit(anchor_code).alias("detail")
    )
    disconnected = (
        stations.join(known.select("flightdate", "airport"), ["flightdate", "airport"], "left_anti")
        .join(solved_dates, "flightdate", "left_semi")
        .select("flightdate", F.lit("disconnected").alias("issue"), F.col("airport").alias("detail"))
    )
    fractional = known.filter(F.pmod("value", F.lit(60)) != 0).select(
        "flightdate", F.lit("not_whole_hour").alias("issue"), F.col("airport").alias("detail")
    )
    issues = conflict.union(no_anchor).union(disconnected).union(fractional)
    if dates is not None:
        empty = dates.select(F.col("flightdate").cast("date").alias("flightdate")).join(
            all_dates, "flightdate", "left_anti"
        )
        issues = issues.union(
            empty.select("flightdate", F.lit("no_pairs").alias("issue"), F.lit("").alias("detail"))
        )
    return issues


def require_solved(solution: Solution) -> DataFrame:
    """The offsets, or an error that counts the issues and names the first."""
    found = solution.issues.orderBy("flightdate", "issue", "detail").take(5)
    if found:
        lines = "; ".join(f"{r.flightdate} {r.issue} {r.detail}" for r in found)
        raise OffsetError(f"offsets are not determined, {solution.issues.count()} issues: {lines}")
    return solution.offsets


def solved_dates(solution: Solution) -> DataFrame:
    """The offsets of the dates without any issue."""
    bad = solution.issues.select("flightdate").distinct()
    return solution.offsets.join(bad, "flightdate", "left_anti")


def pair_support(deltas: DataFrame, min_flights: int = STRONG_PAIR_FLIGHTS) -> DataFrame:
    """Per date: pairs that several flights agree on, pairs that hang on few, and the
    stations only the latter reach."""
    strong = F.col("flights") >= min_flights
    per_station = (
        deltas.select("flightdate", F.explode(F.array("origin", "dest")).alias("airport"), strong.alias("strong"))
        .groupBy("flightdate", "airport")
        .agg(F.bool_or("strong").alias("strong"))
    )
    stations = per_station.groupBy("flightdate").agg(
        F.count("*").alias("stations"), F.count_if(~F.col("strong")).alias("thin_stations")
    )
    pairs = deltas.groupBy("flightdate").agg(
        F.count_if(strong).alias("strong_pairs"), F.count_if(~strong).alias("thin_pairs")
    )
    return pairs.join(stations, "flightdate")


def utc_times(legs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add both UTC times and move the local arrival to its own date.

    A leg without block time or without an offset at either end keeps what it has. The
    offset table is small but grows with the dates, so Spark's own size check decides
    between broadcast and shuffle.
    """
    at_origin = offsets.select("flightdate", F.col("airport").alias("origin"), F.col("offset_minutes").alias("off_o"))
    at_dest = offsets.select("flightdate", F.col("airport").alias("dest"), F.col("offset_minutes").alias("off_d"))
    joined = legs.join(at_origin, ["flightdate", "origin"], "left").join(at_dest, ["flightdate", "dest"], "left")
    solved = F.col("off_o").isNotNull() & F.col("off_d").isNotNull()
    dep_utc = F.when(
        solved & F.col("scheduled_duration_minutes").isNotNull(),
        shift_minutes("scheduled_departure_time", -F.col("off_o")),
    )
    joined = joined.withColumn("scheduled_departure_utc", dep_utc).withColumn(
        "scheduled_arrival_utc", shift_minutes("scheduled_departure_utc", "scheduled_duration_minutes")
    )
    repaired = F.coalesce(shift_minutes("scheduled_arrival_utc", "off_d"), "scheduled_arrival_time")
    columns = [repaired.alias(c) if c == "scheduled_arrival_time" else F.col(c) for c in legs.columns]
    return joined.select(*columns, "scheduled_departure_utc", "scheduled_arrival_utc")


def utc_roundtrip(legs: DataFrame, loaded: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per date: does arrival UTC + offset(dest) give back the clock the file stated?"""
    from skyloom.schema import LEG_KEY

    stated = loaded.select(*LEG_KEY, F.col("scheduled_arrival_time").alias("stated"))
    at_dest = offsets.select("flightdate", F.col("airport").alias("dest"), "offset_minutes")
    rows = legs.filter(F.col("scheduled_arrival_utc").isNotNull())
    rows = rows.join(stated, list(LEG_KEY)).join(at_dest, ["flightdate", "dest"])
    back = shift_minutes("scheduled_arrival_utc", "offset_minutes")
    clock = F.date_format(back, "HH:mm") == F.date_format("stated", "HH:mm")
    span = minutes_between("scheduled_departure_utc", "scheduled_arrival_utc")
    return rows.groupBy("flightdate").agg(
        F.count("*").alias("legs"),
        F.count_if(clock).alias("same_clock"),
        F.count_if(back == F.col("scheduled_arrival_time")).alias("same_arrival"),
        F.count_if(span == F.col("scheduled_duration_minutes")).alias("same_block"),
        F.count_if(F.col("scheduled_arrival_utc") <= F.col("scheduled_departure_utc")).alias("not_forward"),
    )


def local_duration_audit(loaded: DataFrame) -> DataFrame:
    """Per date: how often subtracting the two local clocks gives the block time."""
    apparent = minutes_between("scheduled_departure_time", "scheduled_arrival_time")
    return loaded.groupBy("flightdate").agg(
        F.count("*").alias("legs"),
        F.count_if(apparent == F.col("scheduled_duration_minutes")).alias("agrees"),
        F.count_if(apparent < 0).alias("negative"),
    )


def overnight_audit(legs: DataFrame, cutoff_hour: int = 15) -> DataFrame:
    """Per date: legs landing on another local or UTC day, and same-day deadlines they pass."""
    rows = legs.filter(F.col("scheduled_arrival_utc").isNotNull())
    landed = F.col("scheduled_arrival_time").cast("date")
    deadline = F.timestamp_add("HOUR", F.lit(cutoff_hour), F.col("flightdate").cast("timestamp_ntz"))
    return rows.groupBy("flightdate").agg(
        F.count("*").alias("legs"),
        F.count_if(landed > F.col("flightdate")).alias("next_day"),
        F.count_if(landed < F.col("flightdate")).alias("previous_day"),
        F.count_if(
            F.col("scheduled_arrival_utc").cast("date") > F.col("scheduled_departure_utc").cast("date")
        ).alias("utc_next_day"),
        F.count_if((landed > F.col("flightdate")) & (F.col("scheduled_arrival_time") < deadline)).alias(
            "false_accepts"
        ),
    )


def utc_coverage(legs: DataFrame, dates: DataFrame) -> DataFrame:
    """Per requested date: legs and how many carry each time; a missing date counts zero."""
    found = legs.groupBy("flightdate").agg(
        F.count("*").alias("total"),
        F.count("scheduled_departure_utc").alias("dep_utc"),
        F.count("scheduled_arrival_utc").alias("arr_utc"),
        F.count("scheduled_arrival_time").alias("arr_local"),
    )
    out = dates.select("flightdate").distinct().join(found, "flightdate", "left")
    return out.na.fill(0, ["total", "dep_utc", "arr_utc", "arr_local"]).withColumn(
        "loaded", F.col("total") > 0
    )


def offset_changes(offsets: DataFrame, first, second) -> DataFrame:
    """Stations whose offset differs between two dates."""

    def at(day, name):
        return offsets.filter(F.col("flightdate") == F.lit(day).cast("date")).select(
            "airport", F.col("offset_minutes").alias(name)
        )

    both = at(first, "first_offset").join(at(second, "second_offset"), "airport")
    return both.filter(F.col("first_offset") != F.col("second_offset"))


def airports_without_offset(legs: DataFrame, offsets: DataFrame) -> DataFrame:
    from skyloom.operators.legs import airports_per_date

    return airports_per_date(legs).join(
        offsets.select("flightdate", F.col("airport").alias("code")), ["flightdate", "code"], "left_anti"
    )

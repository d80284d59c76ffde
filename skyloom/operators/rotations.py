"""Aircraft rotations: what an aircraft flew before, delays handed on, cancellations after breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import leg_id, minutes_between
from skyloom.operators.ordered import HOT_ROWS, hot_keys, with_previous
from skyloom.storage import stage

#: Minutes that an aircraft needs on the ground; what is beyond is slack.
MIN_TURN = 30


def _rows(legs: DataFrame) -> DataFrame:
    return legs.select(
        "flightdate",
        leg_id().alias("leg"),
        F.col("reporting_airline").alias("carrier"),
        F.col("flight_number_reporting_airline").alias("number"),
        F.col("tail_number").alias("tail"),
        "origin",
        "dest",
        F.col("scheduled_departure_utc").alias("departs"),
        F.col("scheduled_arrival_utc").alias("arrives"),
        F.coalesce("departure_delay_minutes", F.lit(0)).alias("dep_delay"),
        F.coalesce("arrival_delay_minutes", F.lit(0)).alias("arr_delay"),
    )


def rotations(legs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each leg of an aircraft with the one before it, over all dates, stored: ``whole`` if that
    ended where this one starts, ``ground_minutes`` from its arrival to this departure.

    Order is UTC departure, then the leg's text. An aircraft's first leg has nulls. Legs
    without a tail number or a UTC time are left out; ``untracked`` counts them.
    """
    # A leg's text is made of other columns, so it is put together where it is needed: not shuffled, not stored.
    rows = _rows(legs).drop("leg").withColumn("id", F.monotonically_increasing_id())
    tracked = rows.filter(F.col("tail").isNotNull() & F.col("departs").isNotNull())
    take = ["id", "flightdate", "carrier", "number", "origin", "dest", "arrives", "arr_delay"]
    linked = with_previous(tracked, "tail", "departs", [_leg()], take, hot_rows=hot_rows)
    p = F.col("previous")
    linked = stage(
        linked.select(
            "id", "tail", "flightdate", "carrier", "number", "origin", "dest", "departs", "dep_delay", "arr_delay",
            p["id"].alias("previous_id"), p["flightdate"].alias("previous_date"), p["carrier"].alias("previous_carrier"),
            p["number"].alias("previous_number"), p["origin"].alias("previous_origin"), p["dest"].alias("previous_dest"),
            p["arr_delay"].alias("previous_delay"), minutes_between(p["arrives"], "departs").alias("ground_minutes"),
        ),
        "rotations",
    )
    return linked.withColumns(
        {
            "leg": _leg(),
            "previous_leg": F.when(F.col("previous_id").isNotNull(), _leg("previous_")),
            "whole": F.col("previous_dest") == F.col("origin"),
        }
    )


def _leg(prefix: str = "") -> Column:
    """``leg_id`` of the columns as they are named here."""
    carrier, number, origin, dest = (F.col(prefix + c) for c in ("carrier", "number", "origin", "dest"))
    return F.concat_ws("|", carrier, number.cast("string"), origin, dest)


def rotation_breaks(linked: DataFrame) -> DataFrame:
    """Per carrier of the earlier leg: links, those that start elsewhere, their share."""
    links = linked.filter(F.col("previous_id").isNotNull()).groupBy(F.col("previous_carrier").alias("carrier"))
    counts = links.agg(F.count(F.lit(1)).alias("links"), F.count_if(~F.col("whole")).alias("broken"))
    return counts.withColumn("rate", F.col("broken") / F.col("links"))


def untracked(legs: DataFrame) -> DataFrame:
    """Per carrier: legs, those without a tail number, those without a UTC time."""
    return legs.groupBy(F.col("reporting_airline").alias("carrier")).agg(
        F.count(F.lit(1)).alias("legs"),
        F.count_if(F.col("tail_number").isNull()).alias("no_tail"),
        F.count_if(F.col("tail_number").isNotNull() & F.col("scheduled_departure_utc").isNull()).alias("no_time"),
    )


def propagated_delay(linked: DataFrame, min_turn: int = MIN_TURN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Minutes that delays hand on along whole rotations: tail, flightdate, leg, own, handed_on, total.

    ``own`` is the departure delay that the aircraft's late arrival does not explain. A leg takes
    over the total of the one before less the slack on the ground, not below 0, and adds its own.
    So its total is max(p, t + q) of the total t before, with p = own, q = own - slack. Let s be the
    sum of q up to a leg: then its total is s plus the largest p - s so far in its chain, two running
    windows along each aircraft's legs. Aircraft of more than ``hot_rows`` legs are done in rounds.
    """
    chained = F.coalesce("whole", F.lit(False))
    slack = F.greatest(F.col("ground_minutes") - min_turn, F.lit(0))
    inherited = F.when(chained, F.greatest(F.col("previous_delay") - slack, F.lit(0))).otherwise(0)
    rows = linked.withColumn("own", F.greatest(F.col("dep_delay") - inherited, F.lit(0)).cast("long")).select(
        "id", "tail", "flightdate", "carrier", "number", "origin", "dest", "departs", "own",
        F.when(chained, F.col("previous_id")).alias("to"), (F.col("own") - slack).alias("q"),
    )
    hot = hot_keys(rows, "tail", hot_rows)
    usual = rows if hot is None else rows.join(hot, "tail", "left_anti")
    usual = usual.withColumn("starts", F.col("to").isNull()).drop("id", "to").repartition("tail")
    upto = Window.partitionBy("tail").orderBy("departs", _leg()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usual = usual.withColumns({"s": F.sum("q").over(upto), "chain": F.count_if("starts").over(upto)})
    # Chains are numbered in order, so the largest of the pairs so far is one of this chain.
    best = F.max(F.struct("chain", (F.col("own") - F.col("s")).alias("lead"))).over(upto)
    usual = usual.withColumn("total", F.col("s") + best["lead"]).withColumn("leg", _leg())
    done = usual.select("tail", "flightdate", "leg", "own", (F.col("total") - F.col("own")).alias("handed_on"), "total")
    return done if hot is None else done.unionByName(_in_rounds(rows.join(hot, "tail", "left_semi")))


def _in_rounds(rows: DataFrame) -> DataFrame:
    """The functions max(p, t + q) compose to such functions. Each round replaces a leg's function by
    that of twice as many legs and its pointer by that one's pointer, until all point to the start of
    their chain: rounds grow with the logarithm of the longest chain, and no task holds a chain.
    """
    rows = stage(rows.withColumn("leg", _leg()).select("id", "tail", "flightdate", "leg", "own", "to", "q"), "delays-0")
    chain = rows.select("id", "to", F.col("own").alias("p"), "q")
    number = 0
    while not chain.filter(F.col("to").isNotNull()).isEmpty():
        number += 1
        target = chain.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("p").alias("p2"), F.col("q").alias("q2"))
        step = chain.filter(F.col("to").isNotNull()).join(target, "to").select(
            "id", F.col("to2").alias("to"), F.greatest("p", F.col("p2") + F.col("q")).alias("p"), (F.col("q") + F.col("q2")).alias("q")
        )
        chain = stage(step.unionByName(chain.filter(F.col("to").isNull())), f"delays-{number}")
    total = chain.select("id", F.col("p").alias("total"))
    return rows.join(total, "id").select("tail", "flightdate", "leg", "own", (F.col("total") - F.col("own")).alias("handed_on"), "total")


def cancellation_after_break(legs: DataFrame, cancelled: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Scheduled legs, flown or cancelled, by what the aircraft did before: ``whole`` if the last leg
    it flew ended where this one was to start, ``broken`` if elsewhere, ``first`` if it flew none.

    An as-of join: the last flown leg is taken for each scheduled one, by UTC departure. A leg that
    is both flown and cancelled (in repeated records) counts as flown. Legs without a tail number or
    a UTC time are ``untracked``.
    """
    plan = ["flightdate", "leg", "tail", "origin", "dest", "departs"]
    flown = _rows(legs).select(*plan, F.lit(True).alias("flown"))
    missed = _rows(cancelled).select(*plan).distinct().join(flown.select("flightdate", "leg"), ["flightdate", "leg"], "left_anti")
    every = stage(flown.unionByName(missed.withColumn("flown", F.lit(False))), "scheduled")
    seen = with_previous(every, "tail", "departs", ["leg"], ["dest"], F.col("flown"), hot_rows=hot_rows)
    state = (
        F.when(F.col("tail").isNull() | F.col("departs").isNull(), "untracked")
        .when(F.col("previous").isNull(), "first")
        .when(F.col("previous")["dest"] == F.col("origin"), "whole")
        .otherwise("broken")
    )
    counts = seen.groupBy(state.alias("rotation")).agg(F.count(F.lit(1)).alias("scheduled"), F.count_if(~F.col("flown")).alias("cancelled"))
    return counts.withColumn("rate", F.col("cancelled") / F.col("scheduled"))

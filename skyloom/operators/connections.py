"""Bookable connections: the interval self-join of legs at their shared airport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import carrier_family, leg_id
from skyloom.functions.times import epoch_minute
from skyloom.schema import AMBIGUOUS_CARRIERS, MAX_LAYOVER, MIN_LAYOVER
from skyloom.storage import stage

# Rows a side of one part of a hot group: a task forms at most the square of it as pairs.
HOT_ROWS = 10_000
# Names of what tells the legs of one side apart.
LEG = ("number", "far", "airline")


class BuildError(RuntimeError):
    """A requested date has no connections for a reason the caller must fix."""


def _hot_groups(
    arrivals: DataFrame, departures: DataFrame, key: list[str], hot_rows: int, landed: DataFrame | None = None
) -> DataFrame:
    """Groups that would form more than hot_rows² pairs, or hold many times hot_rows on one
    side, and into how many parts to cut each side. Stored, so that Spark knows the table's
    true size when it chooses how to join it. ``landed`` are the arrivals once each, ``arrivals``
    those in every slot they look into."""
    # A slot holds at most what its airport, carrier and date hold. These are few and merge where
    # the legs are read, so slots are only counted where one of them could be hot at all.
    wide = [c for c in key if c != "slot"]
    broad = [c for c in wide if c != "hub"]
    counted = lambda a, d, by: a.select(*by, F.lit(1).alias("a"), F.lit(0).alias("d")).unionAll(
        d.select(*by, F.lit(0).alias("a"), F.lit(1).alias("d"))
    ).groupBy(*by).agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    pairs = F.col("a").cast("double") * F.col("d")
    is_hot = (pairs > float(hot_rows) ** 2) | (F.greatest("a", "d") > 20 * hot_rows)
    landed = arrivals if landed is None else landed
    # Carriers first: fewer still, and where none of a date is large, its airports are not counted.
    if 0 < len(broad) < len(wide):
        large = stage(counted(landed, departures, broad).filter(is_hot).select(*broad), "hot-carriers")
        landed, departures = (side.join(large, broad, "left_semi") for side in (landed, departures))
        arrivals = arrivals.join(large, broad, "left_semi")
    suspects = stage(counted(landed, departures, wide).filter(is_hot).select(*wide), "hot-airports")
    inside = lambda side: side.join(suspects, wide, "left_semi")
    hot = counted(inside(arrivals), inside(departures), key).filter(is_hot)
    return stage(
        hot.select(
            *key,
            F.ceil(F.col("a") / hot_rows).cast("int").alias("a_parts"),
            F.ceil(F.col("d") / hot_rows).cast("int").alias("d_parts"),
        ),
        "hot-groups",
    )


def _split(side: DataFrame, hot: DataFrame, key: list[str], own: str, other: str, by=("leg",)) -> DataFrame:
    """A row of a hot group takes one part of its own side and is repeated for each part of
    the other, so every pair still meets exactly once. Other rows are untouched."""
    side = side.join(hot, key, "left")
    parts = F.greatest(F.coalesce(f"{own}_parts", F.lit(1)), F.lit(1))
    repeats = F.greatest(F.coalesce(f"{other}_parts", F.lit(1)), F.lit(1))
    return (
        side.withColumn(f"{own}_part", F.pmod(F.xxhash64(*by), parts).cast("int"))
        .withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), repeats - 1)))
        .drop("a_parts", "d_parts")
    )


def build_connections(
    legs: DataFrame,
    min_layover: int = MIN_LAYOVER,
    max_layover: int = MAX_LAYOVER,
    strict_carrier: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every pair of legs of one date where the second leaves the airport the first reaches,
    under the same (family) carrier, after min..max UTC minutes, not back to the start.

    The window is turned into an equality: departures fall into slots of the window's
    width and an arrival looks into the two slots its window can touch. Groups that hold
    too many pairs for a task are cut on both sides. What the search needs of the second
    leg is stored with the connection, so that a hop costs one join and not two.
    """
    if min_layover > max_layover:
        raise ValueError("min_layover exceeds max_layover")
    carrier = F.col("reporting_airline") if strict_carrier else carrier_family("reporting_airline")
    width = max(max_layover - min_layover + 1, 30)
    timed = legs.filter(
        F.col("scheduled_arrival_utc").isNotNull() & F.col("scheduled_departure_utc").isNotNull()
    )
    arrives = epoch_minute("scheduled_arrival_utc")
    # The leg's text is made of columns that the join needs anyway, so it is put together after it.
    named = [F.col("reporting_airline").alias("airline"), F.col("flight_number_reporting_airline").alias("number")]
    arrivals = timed.select(
        "flightdate",
        F.col("dest").alias("hub"),
        carrier.alias("carrier"),
        *named,
        F.col("origin").alias("far"),
        arrives.alias("lands"),
    )
    first_slot = F.floor((F.col("lands") + min_layover) / width)
    last_slot = F.floor((F.col("lands") + max_layover) / width)
    landed = arrivals
    arrivals = arrivals.withColumn("slot", F.explode(F.sequence(first_slot, last_slot)))
    departures = timed.select(
        "flightdate",
        F.col("origin").alias("hub"),
        carrier.alias("carrier"),
        *named,
        F.col("dest").alias("far"),
        F.col("scheduled_duration_minutes").alias("to_block"),
        F.col("scheduled_departure_time").alias("to_departs"),
        F.col("scheduled_arrival_time").alias("to_arrives"),
        F.col("scheduled_arrival_utc").alias("to_arrives_utc"),
        epoch_minute("scheduled_departure_utc").alias("leaves"),
    ).withColumn("slot", F.floor(F.col("leaves") / width))

    # The slot leads: it is a number that tells dates and hours apart, so the sort of the
    # join is mostly decided on the key prefix.
    key = ["slot", "hub", "carrier", "flightdate"]
    hot = _hot_groups(arrivals, departures, key, hot_rows, landed)
    arrivals = _side(_split(arrivals, hot, key, "a", "d", LEG), "from", "from_origin")
    departures = _side(_split(departures, hot, key, "d", "a", LEG), "to", "to_dest")
    layover = F.col("leaves") - F.col("lands")
    carried = ["to_block", "to_departs", "to_arrives", "to_arrives_utc"]
    return (
        arrivals.join(departures, [*key, "a_part", "d_part"])
        .filter(layover.between(min_layover, max_layover) & (F.col("to_dest") != F.col("from_origin")))
        .select(
            "flightdate",
            _leg_text("from_carrier", "from_number", "from_origin", "hub").alias("from_leg"),
            _leg_text("to_carrier", "to_number", "hub", "to_dest").alias("to_leg"),
            "from_origin",
            "hub",
            "to_dest",
            "from_carrier",
            "to_carrier",
            layover.cast("int").alias("layover_minutes"),
            F.concat("to_carrier", F.col("to_number").cast("string")).alias("to_flight"),
            *carried,
        )
    )


def _side(rows: DataFrame, prefix: str, far: str) -> DataFrame:
    names = {"airline": f"{prefix}_carrier", "number": f"{prefix}_number", "far": far}
    return rows.withColumnsRenamed(names)


def _leg_text(carrier: str, number: str, origin: str, dest: str) -> Column:
    """``leg_id`` of a leg whose columns have other names."""
    return F.concat_ws("|", carrier, F.col(number).cast("string"), origin, dest)


def unbuilt_dates(connections: DataFrame, legs: DataFrame, dates: DataFrame) -> DataFrame:
    """flightdate, total, reason of the requested dates that got no connections though they could
    not have had any: ``no_legs`` or ``no_utc``."""
    from skyloom.operators.offsets import utc_coverage

    built = connections.select("flightdate").distinct()
    empty = utc_coverage(legs, dates).join(built, "flightdate", "left_anti")
    reason = F.when(F.col("total") == 0, "no_legs").when(F.col("dep_utc") == 0, "no_utc")
    return empty.select("flightdate", "total", reason.alias("reason")).filter(F.col("reason").isNotNull())


def require_built(connections: DataFrame, legs: DataFrame, dates: DataFrame) -> None:
    """Raise where requested dates got no connections, naming all of them and why."""
    said = []
    for row in unbuilt_dates(connections, legs, dates).orderBy("flightdate").collect():  # a row a date
        if row.reason == "no_legs":
            said.append(f"{row.flightdate}: no legs are loaded, nothing to connect")
        else:
            said.append(f"{row.flightdate}: {row.total} legs but no UTC times; solve the offsets first")
    if said:
        raise BuildError("; ".join(said))


def searchable_dates(connections: DataFrame) -> DataFrame:
    return connections.select("flightdate").distinct()


def is_searchable(connections: DataFrame, day) -> bool:
    """Stops at the first row of the date's partition; never counts."""
    return not connections.filter(F.col("flightdate") == F.lit(day).cast("date")).limit(1).isEmpty()


def connections_per_date(connections: DataFrame) -> DataFrame:
    return connections.groupBy("flightdate").agg(F.count("*").alias("connections"))


def readiness(connections: DataFrame) -> DataFrame:
    return connections.agg(F.count("*").alias("connections")).withColumn("ready", F.col("connections") > 0)


def connection_invariants(
    connections: DataFrame, legs: DataFrame, min_layover: int = MIN_LAYOVER, max_layover: int = MAX_LAYOVER
) -> DataFrame:
    """Re-derive each edge's rules from the two legs it names; every count but the first
    must be zero."""

    def side(prefix):
        return legs.select(
            "flightdate",
            leg_id().alias(f"{prefix}_leg"),
            F.col("origin").alias(f"{prefix}_o"),
            F.col("dest").alias(f"{prefix}_d"),
            F.col("scheduled_departure_utc").alias(f"{prefix}_dep"),
            F.col("scheduled_arrival_utc").alias(f"{prefix}_arr"),
        )

    edges = connections.select("flightdate", "from_leg", "to_leg", "layover_minutes")
    edges = edges.join(side("from"), ["flightdate", "from_leg"], "left")
    edges = edges.join(side("to"), ["flightdate", "to_leg"], "left")
    real = F.timestamp_diff("MINUTE", F.col("from_arr"), F.col("to_dep"))

    def broken(rule: Column) -> Column:
        return F.count_if(~F.coalesce(rule, F.lit(False)))

    return edges.agg(
        F.count("*").alias("edges"),
        broken(F.col("from_d") == F.col("to_o")).alias("hub_mismatch"),
        broken(F.col("to_d") != F.col("from_o")).alias("backtrack"),
        broken(F.col("layover_minutes").between(min_layover, max_layover)).alias("outside_window"),
        broken(F.col("layover_minutes") == real).alias("wrong_layover"),
    )


def carrier_edge_audit(connections: DataFrame) -> DataFrame:
    """Edges, edges between two codes of one family, edges between unrelated carriers."""
    a, b = F.col("from_carrier"), F.col("to_carrier")
    return connections.agg(
        F.count("*").alias("edges"),
        F.count_if(a != b).alias("cross_family"),
        F.count_if(carrier_family(a) != carrier_family(b)).alias("mismatched"),
    )


def ambiguous_carrier_share(connections: DataFrame, codes=AMBIGUOUS_CARRIERS) -> DataFrame:
    """Edges inside a carrier that sells under several parents, per code and of all."""
    inside = (F.col("from_carrier") == F.col("to_carrier")) & F.col("from_carrier").isin(*codes)
    per_code = connections.groupBy(F.when(inside, F.col("from_carrier")).alias("carrier")).agg(
        F.count("*").alias("edges")
    )
    total = connections.agg(F.count("*").alias("all_edges"))
    return (
        per_code.filter(F.col("carrier").isNotNull())
        .join(F.broadcast(total))
        .withColumn("share", F.col("edges") / F.col("all_edges"))
    )

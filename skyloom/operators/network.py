"""The aggregated route network and questions of topology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.storage import stage


def routes(legs: DataFrame, airports: DataFrame | None = None) -> DataFrame:
    """One row per directed airport pair over all dates."""
    out = legs.groupBy("origin", "dest").agg(
        F.count("*").alias("flights"),
        F.count_distinct("reporting_airline").alias("carriers"),
        F.min("flightdate").alias("first_date"),
        F.max("flightdate").alias("last_date"),
    )
    return between_known(out, airports) if airports is not None else out


def between_known(route_table: DataFrame, airports: DataFrame) -> DataFrame:
    """Routes whose two ends both exist as airports."""
    at_origin = airports.select(F.col("code").alias("origin"))
    at_dest = airports.select(F.col("code").alias("dest"))
    return route_table.join(at_origin, "origin", "left_semi").join(at_dest, "dest", "left_semi")


def route_uniqueness(route_table: DataFrame) -> DataFrame:
    return route_table.agg(
        F.count("*").alias("edges"), F.count_distinct("origin", "dest").alias("distinct_pairs")
    )


def _edges(route_table: DataFrame, min_flights: int | None) -> DataFrame:
    if min_flights is not None:
        route_table = route_table.filter(F.col("flights") >= min_flights)
    return route_table.select(F.col("origin").alias("here"), F.col("dest").alias("there"))


def reach(
    route_table: DataFrame, max_legs: int, origins: list[str] | None = None, min_flights: int | None = None
) -> DataFrame:
    """(origin, airport, legs): airports within 1..max_legs legs and the fewest legs of a walk.

    The origin itself counts once a walk returns to it. Each step is made distinct, so it
    holds at most airports^2 rows however many walks there are.
    """
    edges = _edges(route_table, min_flights)
    step = edges.select(F.col("here").alias("origin"), F.col("there").alias("airport"))
    if origins:
        step = step.filter(F.col("origin").isin(*origins))
    steps = [step.withColumn("legs", F.lit(1))]
    for legs in range(2, max_legs + 1):
        step = (
            step.withColumnRenamed("airport", "here")
            .join(edges, "here")
            .select("origin", F.col("there").alias("airport"))
            .distinct()
        )
        steps.append(step.withColumn("legs", F.lit(legs)))
    found = reduce(DataFrame.unionByName, steps)
    return found.groupBy("origin", "airport").agg(F.min("legs").alias("legs"))


def reach_counts(
    route_table: DataFrame, max_legs: int, origins: list[str] | None = None, min_flights: int | None = None
) -> DataFrame:
    """Airports within 1, 2, ... max_legs legs of each origin."""
    found = reach(route_table, max_legs, origins, min_flights)
    within = [F.count_if(F.col("legs") <= k).alias(f"within_{k}") for k in range(1, max_legs + 1)]
    return found.groupBy("origin").agg(*within)


def fewest_legs(
    route_table: DataFrame,
    origins: list[str] | None = None,
    dest: str | None = None,
    min_flights: int | None = None,
) -> DataFrame:
    """One path with the fewest legs per (origin, airport); the smallest route text wins ties.

    Level by level with a visited set: no bound on the length, and no path is listed twice.
    Stops when nothing new is found, or when every origin has found ``dest``.
    """
    edges = stage(_edges(route_table, min_flights).filter(F.col("here") != F.col("there")), "edges")
    start = edges.select(F.col("here").alias("origin")).distinct()
    if origins:
        start = start.filter(F.col("origin").isin(*origins))
    seen = frontier = start.select("origin", F.col("origin").alias("airport"), F.col("origin").alias("route"))
    found, legs = [], 0
    while True:
        legs += 1
        level = (
            frontier.withColumnRenamed("airport", "here")
            .join(edges, "here")
            .groupBy("origin", F.col("there").alias("airport"))
            .agg(F.min("route").alias("route"))
            .join(seen.select("origin", "airport"), ["origin", "airport"], "left_anti")
            .select("origin", "airport", F.concat_ws(">", "route", "airport").alias("route"))
        )
        frontier = stage(level, "fewest-legs")
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("legs", F.lit(legs)))
        seen = seen.unionByName(frontier)
        if dest is not None:
            done = frontier.filter(F.col("airport") == dest).select("origin")
            frontier = frontier.join(done, "origin", "left_anti")
    if not found:
        return edges.limit(0).select(
            F.col("here").alias("origin"), F.col("there").alias("dest"), F.lit("").alias("route"), F.lit(0).alias("legs")
        )
    paths = reduce(DataFrame.unionByName, found).withColumnRenamed("airport", "dest")
    return paths.filter(F.col("dest") == dest) if dest is not None else paths


def _paths(
    route_table: DataFrame, origin: str, dest: str, max_legs: int, keep: Column, once_to_dest: bool
) -> DataFrame:
    """Paths origin -> dest of 1..max_legs legs; ``keep`` is checked at every step."""
    edges = _edges(route_table, None)
    level = edges.filter(F.col("here") == origin).select(
        F.array("here", "there").alias("route"),
        F.array(F.concat_ws(">", "here", "there")).alias("used"),
        F.col("there").alias("at"),
    )
    found = [level]
    for legs in range(2, max_legs + 1):
        if once_to_dest:
            level = level.filter(F.col("at") != dest)
        step = edges.filter(F.col("there") == dest) if legs == max_legs else edges
        level = (
            level.join(step, F.col("at") == F.col("here"))
            .withColumn("edge", F.concat_ws(">", "here", "there"))
            .filter(keep)
            .select(
                F.array_append("route", F.col("there")).alias("route"),
                F.array_append("used", F.col("edge")).alias("used"),
                F.col("there").alias("at"),
            )
        )
        found.append(level)
    out = reduce(DataFrame.unionByName, found).filter(F.col("at") == dest)
    return out.select("route", (F.size("route") - 1).alias("legs"))


def acyclic_routes(
    route_table: DataFrame, origin: str, dest: str, max_legs: int = 3, limit: int | None = 10
) -> DataFrame:
    """Routes without a repeated airport, fewest legs first."""
    keep = ~F.array_contains("route", F.col("there"))
    out = _paths(route_table.filter(F.col("origin") != F.col("dest")), origin, dest, max_legs, keep, True)
    if limit is None:
        return out
    return out.orderBy("legs", F.array_join("route", ">")).limit(limit)


def acyclic_routes_of(route_table: DataFrame, pairs: DataFrame, max_legs: int = 3, limit: int = 10) -> DataFrame:
    """origin, dest, rank, route, legs: ``acyclic_routes`` of every pair (origin, dest) at once.

    Paths are grown once per origin for all its destinations. The last leg only goes to wanted
    ones, and a pair that has ``limit`` routes is not asked again for more legs.
    """
    edges = stage(_edges(route_table, None).filter(F.col("here") != F.col("there")), "route-edges")
    wanted = stage(pairs.select("origin", "dest").filter(F.col("origin") != F.col("dest")).distinct(), "route-pairs")
    starts = wanted.select(F.col("origin").alias("here")).distinct()
    level = edges.join(starts, "here").select(
        F.col("here").alias("origin"), F.array("here", "there").alias("route"), F.col("there").alias("at")
    )
    order = Window.partitionBy("origin", "dest").orderBy(F.array_join("route", ">"))
    found = []
    for legs in range(1, max_legs + 1):
        hits = (
            level.join(wanted.withColumn("at", F.col("dest")), ["origin", "at"])
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= limit)
            .select("origin", "dest", "rank", "route", F.lit(legs).alias("legs"))
        )
        found.append(stage(hits, f"routes-{legs}"))
        if legs == max_legs:
            break
        have = reduce(DataFrame.unionByName, found).groupBy("origin", "dest").agg(F.count(F.lit(1)).alias("n"))
        wanted = wanted.join(have.filter(F.col("n") >= limit), ["origin", "dest"], "left_anti")
        wanted = stage(wanted, "route-pairs")
        grown = level.join(wanted.select("origin").distinct(), "origin").join(edges, F.col("at") == F.col("here"))
        if legs + 1 == max_legs:
            grown = grown.join(wanted.withColumnRenamed("dest", "there"), ["origin", "there"], "left_semi")
        level = grown.filter(~F.array_contains("route", F.col("there"))).select(
            "origin", F.array_append("route", F.col("there")).alias("route"), F.col("there").alias("at")
        )
        level = stage(level, f"route-paths-{legs + 1}")
    best = Window.partitionBy("origin", "dest").orderBy("legs", "rank")
    return (
        reduce(DataFrame.unionByName, found)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
    )


def trail_paths(route_table: DataFrame, origin: str, dest: str, max_legs: int = 3) -> DataFrame:
    """Routes without a repeated edge; an airport may come again."""
    return _paths(route_table, origin, dest, max_legs, ~F.array_contains("used", F.col("edge")), False)


def walk_paths(route_table: DataFrame, origin: str, dest: str, max_legs: int = 3) -> DataFrame:
    return _paths(route_table, origin, dest, max_legs, F.lit(True), False)


def path_modes(route_table: DataFrame, origin: str, dest: str, max_legs: int = 3) -> DataFrame:
    """How many paths each path mode admits."""
    modes = {
        "walk": walk_paths(route_table, origin, dest, max_legs),
        "trail": trail_paths(route_table, origin, dest, max_legs),
        "acyclic": acyclic_routes(route_table, origin, dest, max_legs, limit=None),
    }
    return reduce(
        DataFrame.unionByName,
        [
            paths.groupBy("legs").agg(F.count("*").alias("paths")).withColumn("mode", F.lit(name))
            for name, paths in modes.items()
        ],
    )


def connection_only_pairs(legs: DataFrame, connections: DataFrame, nonstop: bool = False) -> DataFrame:
    """Per date: pairs some connection serves and no nonstop does (or, inverted, both do)."""
    served = connections.groupBy("flightdate", F.col("from_origin").alias("origin"), F.col("to_dest").alias("dest"))
    served = served.agg(F.count("*").alias("options"))
    direct = legs.select("flightdate", "origin", "dest").distinct()
    return served.join(direct, ["flightdate", "origin", "dest"], "left_semi" if nonstop else "left_anti")


def hub_overstatement(route_table: DataFrame, connections: DataFrame) -> DataFrame:
    """Per pair: hubs the route network claims against hubs with a timed connection of one
    carrier."""
    edges = _edges(route_table, None)
    out_legs = edges.select(F.col("here").alias("origin"), F.col("there").alias("hub"))
    in_legs = edges.select(F.col("here").alias("hub"), F.col("there").alias("dest"))
    different = (
        (F.col("origin") != F.col("dest")) & (F.col("hub") != F.col("origin")) & (F.col("hub") != F.col("dest"))
    )
    claimed = out_legs.join(in_legs, "hub").filter(different)
    claimed = claimed.groupBy("origin", "dest").agg(F.count("*").alias("claimed_hubs"))
    timed = (
        connections.filter(F.col("from_carrier") == F.col("to_carrier"))
        .groupBy(F.col("from_origin").alias("origin"), F.col("to_dest").alias("dest"))
        .agg(F.count_distinct("hub").alias("timed_hubs"))
    )
    return claimed.join(timed, ["origin", "dest"], "left").na.fill(0, ["timed_hubs"])


def two_stop_counts(connections: DataFrame) -> DataFrame:
    """Two-stop chains per date and pair, without listing them.

    Around each middle leg the starts and the ends are counted first; a leg then meets
    starts x ends, never in-edges x out-edges.
    """
    before = connections.groupBy("flightdate", F.col("to_leg").alias("leg"), F.col("from_origin").alias("origin"))
    before = before.agg(F.count("*").alias("ways_in"))
    after = connections.groupBy("flightdate", F.col("from_leg").alias("leg"), F.col("to_dest").alias("dest"))
    after = after.agg(F.count("*").alias("ways_out"))
    return (
        before.join(after, ["flightdate", "leg"])
        .filter(F.col("origin") != F.col("dest"))
        .groupBy("flightdate", "origin", "dest")
        .agg(F.sum(F.col("ways_in") * F.col("ways_out")).alias("paths"))
    )


def densest_pair(connections: DataFrame) -> DataFrame:
    return two_stop_counts(connections).orderBy(F.col("paths").desc(), "flightdate", "origin", "dest").limit(1)


def probe_pairs(legs: DataFrame, connections: DataFrame, min_options=10, min_skew=120) -> DataFrame:
    """Connection-only pairs that exercise the clock hazards, with a deadline two hours past
    the earliest true arrival, the hardest first."""
    from skyloom.functions import leg_id, minutes_between, shift_minutes

    first = legs.select(
        "flightdate",
        leg_id().alias("from_leg"),
        F.col("scheduled_departure_time").alias("departs"),
        F.col("scheduled_duration_minutes").alias("from_block"),
    )
    direct = legs.select("flightdate", F.col("origin").alias("from_origin"), F.col("dest").alias("to_dest")).distinct()
    edges = connections.join(direct, ["flightdate", "from_origin", "to_dest"], "left_anti")
    edges = edges.join(first, ["flightdate", "from_leg"])
    overnight = F.col("to_arrives").cast("date") > F.col("flightdate")
    apparent = minutes_between("departs", "to_arrives")
    skew = F.abs(apparent - F.col("from_block") - F.col("to_block"))
    return (
        edges.groupBy("flightdate", F.col("from_origin").alias("origin"), F.col("to_dest").alias("dest"))
        .agg(
            F.count("*").alias("options"),
            F.max(skew).alias("tz_skew"),
            F.count_if(overnight).alias("overnights"),
            F.min(F.when(~overnight, F.col("to_arrives"))).alias("earliest_real"),
        )
        .filter(
            (F.col("options") >= min_options)
            & (F.col("tz_skew") >= min_skew)
            & (F.col("overnights") > 0)
            & F.col("earliest_real").isNotNull()
        )
        .withColumn("deadline", shift_minutes("earliest_real", F.lit(120)))
        .drop("earliest_real")
        .orderBy(F.col("tz_skew").desc(), F.col("options").desc(), "flightdate", "origin", "dest")
    )

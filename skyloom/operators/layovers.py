"""Two-leg questions on local hub clocks, without stored connections.

Both clocks at one hub share a zone, so subtracting them is sound there. Questions that
only count pairs are answered from per-minute histograms: their size depends on the
minutes of a day, not on the legs, and no pair is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import flight_label, minutes_between
from skyloom.functions.times import epoch_minute
from skyloom.schema import MAX_LAYOVER, MIN_LAYOVER
from skyloom.storage import stage


def one_stop(
    legs: DataFrame,
    origin: str,
    dest: str,
    day,
    min_layover: int = MIN_LAYOVER,
    max_layover: int = MAX_LAYOVER,
    limit: int = 10,
    interline: bool = False,
) -> DataFrame:
    """One-stop options, second leg on the same or the next date, one operating carrier."""
    day = F.lit(day).cast("date")
    first = legs.filter(
        (F.col("flightdate") == day) & (F.col("origin") == origin) & (F.col("dest") != dest)
    ).select(
        F.col("dest").alias("via"),
        F.col("reporting_airline").alias("carrier"),
        flight_label().alias("first_flight"),
        F.col("scheduled_departure_time").alias("departs"),
        F.col("scheduled_arrival_time").alias("lands"),
        F.col("scheduled_duration_minutes").alias("first_block"),
    )
    second = legs.filter(
        F.col("flightdate").between(day, F.date_add(day, 1))
        & (F.col("dest") == dest)
        & (F.col("origin") != origin)
    ).select(
        F.col("origin").alias("via"),
        F.col("reporting_airline").alias("carrier"),
        flight_label().alias("second_flight"),
        F.col("scheduled_departure_time").alias("leaves"),
        F.col("scheduled_arrival_time").alias("arrives"),
        F.col("scheduled_duration_minutes").alias("second_block"),
    )
    if interline:
        pairs = first.join(second.drop("carrier"), "via")
    else:
        pairs = first.join(second, ["via", "carrier"])
    layover = minutes_between("lands", "leaves")
    return (
        pairs.filter(layover.between(min_layover, max_layover))
        .select(
            F.array("first_flight", "second_flight").alias("flights"),
            "via",
            "departs",
            "arrives",
            layover.alias("layover"),
            (F.col("first_block") + F.col("second_block")).alias("air_minutes"),
        )
        .orderBy(F.col("departs").asc_nulls_last(), "flights")
        .limit(limit)
    )


def one_stop_of(
    legs: DataFrame,
    requests: DataFrame,
    min_layover: int = MIN_LAYOVER,
    max_layover: int = MAX_LAYOVER,
    limit: int = 10,
) -> DataFrame:
    """``one_stop`` of every request (request_id, origin, dest, flightdate) at once.

    Equal questions are answered once. First legs from asked origins meet second legs into asked
    destinations in slots of time as wide as the layover window, at one airport and carrier; only
    what makes a connection meets the questions. What is kept per question is cut to ``limit``
    rows before the shuffle.
    """
    asked = requests.select("flightdate", "origin", "dest").distinct()
    minutes = F.col("scheduled_duration_minutes")
    first = legs.select(
        "flightdate",
        "origin",
        F.col("dest").alias("via"),
        F.col("reporting_airline").alias("carrier"),
        flight_label().alias("first_flight"),
        F.col("scheduled_departure_time").alias("departs"),
        F.col("scheduled_arrival_time").alias("lands"),
        minutes.alias("first_block"),
    )
    second = legs.select(
        F.col("flightdate").alias("second_date"),
        F.col("origin").alias("via"),
        "dest",
        F.col("reporting_airline").alias("carrier"),
        flight_label().alias("second_flight"),
        F.col("scheduled_departure_time").alias("leaves"),
        F.col("scheduled_arrival_time").alias("arrives"),
        minutes.alias("second_block"),
    )
    layover = minutes_between("lands", "leaves")
    width = max(max_layover - min_layover + 1, 30)
    slot = lambda column, plus: F.floor((epoch_minute(column) + plus) / width)
    first = first.filter(F.col("lands").isNotNull()).join(asked.select("flightdate", "origin").distinct(), ["flightdate", "origin"], "left_semi")
    first = first.withColumn("slot", F.explode(F.sequence(slot("lands", min_layover), slot("lands", max_layover))))
    second = second.join(asked.select("dest").distinct(), "dest", "left_semi").withColumn("slot", slot("leaves", 0))
    today_or_next = F.col("second_date").between(F.col("flightdate"), F.date_add("flightdate", 1))
    options = (
        first.join(second, ["slot", "via", "carrier"])
        .filter(today_or_next & layover.between(min_layover, max_layover))
        .filter((F.col("via") != F.col("dest")) & (F.col("via") != F.col("origin")))
        .join(asked, ["flightdate", "origin", "dest"])
        .select(
            "flightdate",
            "origin",
            "dest",
            F.array("first_flight", "second_flight").alias("flights"),
            "via",
            "departs",
            "arrives",
            layover.alias("layover"),
            (F.col("first_block") + F.col("second_block")).alias("air_minutes"),
        )
    )
    order = Window.partitionBy("flightdate", "origin", "dest").orderBy(F.col("departs").asc_nulls_last(), "flights")
    ranked = options.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return requests.select("request_id", "flightdate", "origin", "dest").join(
        ranked, ["flightdate", "origin", "dest"]
    ).drop("flightdate", "origin", "dest")


def _histogram(legs: DataFrame, hubs: list[str] | None = None) -> DataFrame:
    """Per date, hub, far end and local minute: legs that land and legs that leave.

    A leg is one arrival at its destination and one departure at its origin; both are
    counted in one pass.
    """
    landing = F.struct(
        F.col("dest").alias("hub"),
        F.col("origin").alias("other"),
        epoch_minute("scheduled_arrival_time").alias("minute"),
        F.lit(1).alias("landed"),
        F.lit(0).alias("left"),
    )
    leaving = F.struct(
        F.col("origin").alias("hub"),
        F.col("dest").alias("other"),
        epoch_minute("scheduled_departure_time").alias("minute"),
        F.lit(0).alias("landed"),
        F.lit(1).alias("left"),
    )
    events = (
        legs.filter(F.col("origin") != F.col("dest"))
        .select("flightdate", F.explode(F.array(landing, leaving)).alias("e"))
        .select("flightdate", "e.*")
        .filter(F.col("minute").isNotNull())
    )
    if hubs:
        events = events.filter(F.col("hub").isin(*hubs))
    return events.groupBy("flightdate", "hub", "other", "minute").agg(
        F.sum("landed").alias("landed"), F.sum("left").alias("left")
    )


#: A minute after all others.
_LAST = 1 << 40


def _pairs(histogram: DataFrame, windows: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """Per date and hub, for each window (low, high): pairs whose departure is low..high minutes after
    the arrival, less those that lead back to where they began; None leaves that end open.

    A sweep: departures add to a running sum, at the hub and for each far end. An arrival reads it
    where its window ends and, with a minus, just before the window begins. All windows share
    one pass, one sort for the hub and one for the far ends.
    """
    marks = []
    for name, (low, high) in windows.items():
        ends = F.lit(_LAST) if high is None else F.col("minute") + high
        marks.append(F.struct(ends.alias("minute"), F.lit(name).alias("name"), F.col("landed").alias("weight")))
        if low is not None:
            marks.append(F.struct((F.col("minute") + (low - 1)).alias("minute"), F.lit(name).alias("name"), (-F.col("landed")).alias("weight")))
    where = ["flightdate", "hub", "other"]
    leaving = histogram.filter(F.col("left") > 0).select(*where, "minute", "left", F.lit(0).alias("reads"))
    arrivals = histogram.filter(F.col("landed") > 0).select(*where, F.explode(F.array(*marks)).alias("mark"))
    reading = arrivals.select(*where, "mark.*", F.lit(0).alias("left"), F.lit(1).alias("reads"))
    rows = leaving.unionByName(reading, allowMissingColumns=True)
    upto = (Window.unboundedPreceding, Window.currentRow)
    at_hub = Window.partitionBy("flightdate", "hub").orderBy("minute", "reads").rowsBetween(*upto)
    back = Window.partitionBy(*where).orderBy("minute", "reads").rowsBetween(*upto)
    seen = rows.withColumn("seen", F.sum("left").over(at_hub) - F.sum("left").over(back)).filter("reads = 1")
    counts = [F.sum(F.when(F.col("name") == name, F.col("weight") * F.col("seen")).otherwise(0)).alias(name) for name in windows]
    return seen.groupBy("flightdate", "hub").agg(*counts)


def hub_pair_counts(
    legs: DataFrame, low: int | None = MIN_LAYOVER, high: int | None = MAX_LAYOVER, hubs: list[str] | None = None
) -> DataFrame:
    """Any-carrier pairs per date and hub, with different start and end airports."""
    return _pairs(_histogram(legs, hubs), {"pairs": (low, high)})


def hub_connections(legs: DataFrame, low: int = MIN_LAYOVER, high: int = MAX_LAYOVER) -> DataFrame:
    """Any-carrier connections in the local window, per date and hub."""
    return hub_pair_counts(legs, low, high).filter(F.col("pairs") > 0)


def negative_layovers(legs: DataFrame) -> DataFrame:
    """What the join yields without the time-order predicate: all pairs, and impossible ones."""
    counts = _pairs(_histogram(legs), {"negative": (None, -1), "total": (None, None)})
    return counts.groupBy("flightdate").agg(F.sum("negative").alias("negative"), F.sum("total").alias("total"))


def hub_layover_stats(legs: DataFrame, hubs: list[str], low: int = 45, high: int = 480) -> DataFrame:
    """Shortest and longest any-carrier layover in the window, and the number of pairs,
    per date and hub.

    For each minute the first departure that follows and the first one to another airport
    than that are enough: one of the two does not lead back to where the arrival came from.
    The longest layover is the same question on the reversed clock.
    """
    histogram = stage(_histogram(legs, hubs), "hub-minutes")  # read three times
    reversed_clock = histogram.withColumn("minute", -F.col("minute"))
    shortest = _shortest_gap(histogram, low, high).withColumnRenamed("gap", "min_layover")
    longest = _shortest_gap(reversed_clock, -high, -low).withColumn("max_layover", -F.col("gap")).drop("gap")
    key = ["flightdate", "hub"]
    return shortest.join(longest, key).join(_pairs(histogram, {"pairs": (low, high)}), key)


def _shortest_gap(histogram: DataFrame, low: int, high: int) -> DataFrame:
    """Per date and hub: fewest minutes from an arrival to a departure elsewhere."""
    hub = ["flightdate", "hub"]
    order = Window.partitionBy(*hub).orderBy("minute", "other")
    turned = F.lag("other").over(order) != F.col("other")
    departures = histogram.filter(F.col("left") > 0).withColumn("turn", F.when(turned, F.col("minute")))
    later = order.rowsBetween(1, Window.unboundedFollowing)
    departures = departures.withColumn("next_other", F.min("turn").over(later))
    per_minute = departures.groupBy(*hub, "minute").agg(
        F.min(F.struct("minute", "other", "next_other")).alias("first")
    )
    arrivals = histogram.filter(F.col("landed") > 0).select(*hub, "minute", F.col("other").alias("start"))
    rows = arrivals.unionByName(per_minute, allowMissingColumns=True)
    ahead = Window.partitionBy(*hub).orderBy("minute").rangeBetween(low, high)
    rows = rows.withColumn("ahead", F.min("first").over(ahead)).filter(F.col("start").isNotNull())
    elsewhere = F.when(F.col("ahead.other") != F.col("start"), F.col("ahead.minute")).otherwise(
        F.col("ahead.next_other")
    )
    gap = elsewhere - F.col("minute")
    return rows.filter(gap.between(low, high)).groupBy(*hub).agg(F.min(gap).alias("gap"))

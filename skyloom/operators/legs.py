"""Records -> legs, and the plain lookups over legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import at_time, flight_label, leg_id
from skyloom.schema import LEG_KEY


def is_valid(strict: bool = False) -> Column:
    """Key present and not cancelled; ``strict`` also rejects blanks and origin = dest."""
    ok = F.col("cancelled") == 0
    for column in LEG_KEY:
        ok = ok & F.col(column).isNotNull()
    if strict:
        for column in LEG_KEY[1:]:
            ok = ok & (F.trim(F.col(column).cast("string")) != "")
        ok = ok & (F.col("origin") != F.col("dest"))
    return ok


def valid_legs(records: DataFrame, strict: bool = False) -> DataFrame:
    return records.filter(is_valid(strict))


def cancelled_legs(records: DataFrame) -> DataFrame:
    """Records with a whole key that were cancelled: a side table, as legs hold what flew."""
    whole = F.col("cancelled") == 1
    for column in LEG_KEY:
        whole = whole & F.col(column).isNotNull()
    return records.filter(whole)


def project_legs(records: DataFrame) -> DataFrame:
    """The fifteen leg columns. Both arrival clocks are put on the departure date here;
    ``offsets.utc_times`` moves the scheduled one to the date it belongs to."""
    return records.select(
        F.col("flightdate").cast("date").alias("flightdate"),
        "reporting_airline",
        "flight_number_reporting_airline",
        "origin",
        "dest",
        at_time("flightdate", "crsdeptime").alias("scheduled_departure_time"),
        at_time("flightdate", "crsarrtime").alias("scheduled_arrival_time"),
        at_time("flightdate", "deptime").alias("actual_departure_time"),
        at_time("flightdate", "arrtime").alias("actual_arrival_time"),
        F.col("crselapsedtime").cast("int").alias("scheduled_duration_minutes"),
        F.col("actualelapsedtime").cast("int").alias("actual_duration_minutes"),
        F.col("distance").cast("float").alias("distance_miles"),
        "tail_number",
        F.col("depdelay").cast("int").alias("departure_delay_minutes"),
        F.col("arrdelay").cast("int").alias("arrival_delay_minutes"),
    )


def with_leg_id(legs: DataFrame) -> DataFrame:
    return legs.withColumn("leg_id", leg_id())


def on_date(df: DataFrame, day) -> DataFrame:
    return df.filter(F.col("flightdate") == F.lit(day).cast("date"))


def between_dates(df: DataFrame, start, end) -> DataFrame:
    """Half-open: start <= date < end."""
    d = F.col("flightdate")
    return df.filter((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))


def depart_after(legs: DataFrame, bound: Column) -> DataFrame:
    """Local clock at the origin, bound included."""
    return legs.filter(F.col("scheduled_departure_time") >= bound)


def arrive_before(legs: DataFrame, bound: Column) -> DataFrame:
    """Local clock at the destination on its own date, bound excluded."""
    return legs.filter(F.col("scheduled_arrival_time") < bound)


def departures_by_hour(legs: DataFrame, from_hour: int, to_hour: int, airports=None) -> DataFrame:
    hour = F.hour("scheduled_departure_time")
    out = legs.filter((hour >= from_hour) & (hour < to_hour))
    return out.filter(F.col("origin").isin(*airports)) if airports else out


def direct_flights(legs: DataFrame, origin: str, dest: str, day) -> DataFrame:
    return (
        on_date(legs, day)
        .filter((F.col("origin") == origin) & (F.col("dest") == dest))
        .select(
            flight_label().alias("flight"),
            F.col("scheduled_departure_time").alias("departs"),
            F.col("scheduled_arrival_time").alias("arrives"),
            F.col("scheduled_duration_minutes").alias("minutes"),
        )
        .orderBy(F.col("departs").asc_nulls_last(), "flight")
    )


def direct_flights_of(legs: DataFrame, requests: DataFrame) -> DataFrame:
    """The nonstops of every request (request_id, origin, dest, flightdate), in one join."""
    asked = requests.select("request_id", "origin", "dest", "flightdate")
    return legs.join(asked, ["flightdate", "origin", "dest"]).select(
        "request_id",
        flight_label().alias("flight"),
        F.col("scheduled_departure_time").alias("departs"),
        F.col("scheduled_arrival_time").alias("arrives"),
        F.col("scheduled_duration_minutes").alias("minutes"),
    )


def airports(legs: DataFrame) -> DataFrame:
    """Every code seen at either end."""
    ends = legs.select(F.col("origin").alias("code")).union(legs.select(F.col("dest").alias("code")))
    return ends.distinct()


def airports_per_date(legs: DataFrame) -> DataFrame:
    """Both ends as rows, one scan."""
    return legs.select("flightdate", F.explode(F.array("origin", "dest")).alias("code")).distinct()


def carriers(legs: DataFrame) -> DataFrame:
    return legs.select(F.col("reporting_airline").alias("code")).distinct()


def leg_endpoints(legs: DataFrame, airport_table: DataFrame, carrier_table: DataFrame) -> DataFrame:
    """Legs whose origin, destination and carrier all exist in the entity tables."""
    at_origin = airport_table.select(F.col("code").alias("origin"))
    at_dest = airport_table.select(F.col("code").alias("dest"))
    by = carrier_table.select(F.col("code").alias("reporting_airline"))
    return (
        legs.join(at_origin, "origin").join(at_dest, "dest").join(by, "reporting_airline").select(legs["*"])
    )

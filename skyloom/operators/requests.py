"""Search requests as a table: normalising, validating, and making a workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.schema import DEFAULT_LIMIT, DEFAULT_MAX_STOPS, SERVED_MAX_LIMIT, SERVED_MAX_STOPS

DATE = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
CLOCK = "^[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?$"
STAMP = f"^{DATE}T[0-9]{{1,2}}:[0-9]{{1,2}}(:[0-9]{{1,2}})?$"
SPACED = f"^{DATE} [0-9]{{1,2}}:[0-9]{{1,2}}$"


def _airport(column: str) -> Column:
    """Trimmed, upper-case three letters, else null."""
    code = F.upper(F.trim(F.col(column)))
    return F.when(code.rlike(r"^\p{L}{3}$"), code)


def _day(text: Column) -> Column:
    """Year-month-day with one- or two-digit parts, else null."""
    return F.when(text.rlike(f"^{DATE}$"), F.try_to_date(text, "yyyy-M-d"))


def _stamp_text(column: str) -> Column:
    """A bound as full date-and-time text: a clock reading is put on the search date, never
    rolled past midnight."""
    text = F.trim(F.col(column))
    on_day = F.concat(F.date_format("flightdate", "yyyy-MM-dd"), F.lit("T"), text)
    return (
        F.when(text.rlike(CLOCK), on_day)
        .when(text.rlike(SPACED), F.translate(text, " ", "T"))
        .when(text.rlike(STAMP), text)
    )


def _moment(column: str) -> Column:
    """The local time a full text states; null for a day or clock reading that does not exist."""
    parts = F.transform(F.split(column, "[-T:]"), lambda x: x.cast("int"))
    second = F.coalesce(F.get(parts, F.lit(5)), F.lit(0))
    return F.try_make_timestamp_ntz(*[F.get(parts, F.lit(i)) for i in range(5)], second)


def normalise_requests(requests: DataFrame, served: bool = False) -> DataFrame:
    """Typed request columns plus ``error``: the first fault found, null if none.

    Missing optional columns and null stops or limit take the defaults. ``served`` adds the
    caps of the public service.
    """
    optional = {
        "depart_after": F.lit(None).cast("string"),
        "arrive_before": F.lit(None).cast("string"),
        "max_stops": F.lit(DEFAULT_MAX_STOPS),
        "min_stops": F.lit(0),
        "limit": F.lit(DEFAULT_LIMIT),
    }
    for name, value in optional.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, value)
    df = requests.withColumn("flightdate", _day(F.trim("date")))
    df = df.withColumns({f"{c}_text": _stamp_text(c) for c in ("depart_after", "arrive_before")})
    df = df.select(
        "request_id",
        _airport("origin").alias("origin"),
        _airport("dest").alias("dest"),
        "flightdate",
        _moment("depart_after_text").alias("depart_after"),
        _moment("arrive_before_text").alias("arrive_before"),
        F.coalesce(F.col("min_stops").cast("int"), F.lit(0)).alias("min_stops"),
        F.coalesce(F.col("max_stops").cast("int"), F.lit(DEFAULT_MAX_STOPS)).alias("max_stops"),
        F.coalesce(F.col("limit").cast("int"), F.lit(DEFAULT_LIMIT)).alias("limit"),
        F.col("depart_after").isNotNull().alias("has_after"),
        F.col("arrive_before").isNotNull().alias("has_before"),
    )
    fault = (
        F.when(F.col("origin").isNull(), "origin")
        .when(F.col("dest").isNull(), "dest")
        .when(F.col("origin") == F.col("dest"), "same_airport")
        .when(F.col("flightdate").isNull(), "date")
        .when(F.col("has_after") & F.col("depart_after").isNull(), "depart_after")
        .when(F.col("has_before") & F.col("arrive_before").isNull(), "arrive_before")
        .when(F.col("limit") < 1, "limit")
        .when((F.col("min_stops") < 0) | (F.col("max_stops") < F.col("min_stops")), "stops")
    )
    if served:
        fault = fault.when(F.col("max_stops") > SERVED_MAX_STOPS, "max_stops_cap").when(
            F.col("limit") > SERVED_MAX_LIMIT, "limit_cap"
        )
    return df.withColumn("error", fault).drop("has_after", "has_before")


def busiest_origins(legs: DataFrame, day=None, top: int = 60) -> DataFrame:
    """Airports by departures, ties by code."""
    if day is not None:
        legs = legs.filter(F.col("flightdate") == F.lit(day).cast("date"))
    return (
        legs.groupBy(F.col("origin").alias("code"))
        .agg(F.count("*").alias("flights"))
        .orderBy(F.col("flights").desc(), "code")
        .limit(top)
    )


def request_workload(
    legs: DataFrame, dates: DataFrame, top: int = 60, sample: int | None = None, seed: int = 0, **columns
) -> DataFrame:
    """Requests for all ordered pairs of the busiest origins on all given dates.

    ``sample`` keeps that many by a seeded hash, so the same seed gives the same workload.
    The pool is one array of at most ``top`` codes, exploded twice per date.
    """
    pool = busiest_origins(legs, top=top).agg(F.array_sort(F.collect_list("code")).alias("pool"))
    pairs = (
        dates.select("flightdate")
        .distinct()
        .join(F.broadcast(pool))
        .withColumn("origin", F.explode("pool"))
        .withColumn("dest", F.explode("pool"))
        .filter(F.col("origin") != F.col("dest"))
    )
    date = F.date_format("flightdate", "yyyy-MM-dd")
    out = pairs.select(
        F.concat_ws("-", "origin", "dest", date).alias("request_id"),
        "origin",
        "dest",
        date.alias("date"),
        *[F.lit(v).alias(c) for c, v in columns.items()],
    )
    if sample is not None:
        out = out.orderBy(F.md5(F.concat(F.col("request_id"), F.lit(f"#{seed}"))), "request_id").limit(sample)
    return out

"""The jobs a user runs, over tables in one folder:

    loaded/       legs as loaded, by date          airports/ carriers/ routes/
    cancelled/    cancelled legs, by date           daily/    flights per route and carrier, by date
    offsets/      station offsets, by date         legs/     legs with UTC times, by date
    connections/  bookable connections, by date    built/    dates with connections, and how many

Every job replaces whole dates, so it may be run again at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import connections as conn
from skyloom.operators import legs as leg
from skyloom.operators import offsets, rotations
from skyloom.operators.search import search
from skyloom.schema import MAX_LAYOVER, MIN_LAYOVER
from skyloom.sources import scan
from skyloom.sources.tables import drop_dates, replace_dates, upsert_legs, verify_written
from skyloom.storage import drop_path, path_exists, stage

ENTITIES = ("airports", "carriers", "routes")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def load(
    spark: SparkSession,
    source: str,
    root: str,
    file: str | None = None,
    strict: bool = False,
    allow_unreadable: bool = False,
) -> dict[str, int]:
    """Load all files of a folder, or one, and refresh what describes all loaded legs.

    A folder with files that cannot be read is refused unless that is allowed. What was solved
    and built for the dates touched no longer holds and goes, so that a search refuses them
    until they are solved and connected again.
    """
    records = (
        scan.scan_strict(spark, source, file) if file else scan.scan_records(spark, source, allow_unreadable)
    )
    add_records(spark, records, root, strict)
    return {name: verify_written(spark, f"{root}/{name}") for name in ("loaded", *ENTITIES)}


def retire(spark: SparkSession, root: str, dates: list[str], names=("built", "connections", "legs", "offsets")) -> None:
    """Take what was solved and built for the dates out of service; ``built`` goes first, so that
    a search refuses a date before anything else of it changes."""
    for name in names:
        drop_dates(spark, f"{root}/{name}", dates)


def add_records(spark: SparkSession, records: DataFrame, root: str, strict: bool = False) -> list[str]:
    """Merge typed records into the tables of the folder; the dates touched must be solved and
    connected again. Cancelled legs go to a table of their own."""
    touched = upsert_legs(
        leg.project_legs(leg.valid_legs(records, strict)), f"{root}/loaded", before=lambda days: retire(spark, root, days)
    )
    upsert_legs(leg.project_legs(leg.cancelled_legs(records)), f"{root}/cancelled")
    if touched:
        refresh(spark, root, touched)
    return touched


def refresh(spark: SparkSession, root: str, dates: list[str] | None = None) -> None:
    """Airports, carriers and routes of everything loaded, not of the last file alone.

    They come from ``daily``, flights per date, route and carrier; of that only the named dates are
    counted anew (all dates if none are named or nothing is counted yet).
    """
    counted = path_exists(spark, f"{root}/daily")
    dates = dates if counted else None
    loaded = _of_dates(table(spark, root, "loaded"), dates)
    daily = loaded.groupBy("flightdate", "origin", "dest", "reporting_airline").agg(F.count("*").alias("flights"))
    if dates is None:
        drop_path(spark, f"{root}/daily")
    replace_dates(daily, f"{root}/daily", dates)
    daily = spark.read.schema(daily.schema).parquet(f"{root}/daily")
    routes = daily.groupBy("origin", "dest").agg(
        F.sum("flights").alias("flights"),
        F.count_distinct("reporting_airline").alias("carriers"),
        F.min("flightdate").alias("first_date"),
        F.max("flightdate").alias("last_date"),
    )
    for name, df in {"airports": leg.airports(daily), "carriers": leg.carriers(daily), "routes": routes}.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def _of_dates(df: DataFrame, dates: list[str] | None) -> DataFrame:
    return df if dates is None else df.filter(F.col("flightdate").isin(*[F.lit(d).cast("date") for d in dates]))


def _date_table(spark: SparkSession, df: DataFrame, dates: list[str] | None) -> DataFrame:
    if dates is None:
        return df.select("flightdate").distinct()
    return spark.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d").alias("flightdate"))


def solve_dates(spark: SparkSession, root: str, dates: list[str] | None = None) -> None:
    """Solve the offsets of the dates (all if none are named) and write their UTC times.

    Dates without an issue are written; the others are reported after that, and keep nothing
    from before.
    """
    loaded = _of_dates(table(spark, root, "loaded"), dates)
    wanted = _date_table(spark, loaded, dates)
    named = dates or [str(r.flightdate) for r in wanted.collect()]
    solution = offsets.solve_offsets(offsets.offset_deltas(loaded), dates=wanted)
    solved = stage(offsets.solved_dates(solution), "solved")
    retire(spark, root, named, ("built", "connections"))  # they were built on the former times
    replace_dates(solved, f"{root}/offsets", named)
    good = loaded.join(solved.select("flightdate").distinct(), "flightdate", "left_semi")
    replace_dates(offsets.utc_times(good, solved), f"{root}/legs", named)
    offsets.require_solved(solution)


def connect_dates(
    spark: SparkSession,
    root: str,
    dates: list[str] | None = None,
    min_layover: int = MIN_LAYOVER,
    max_layover: int = MAX_LAYOVER,
    strict_carrier: bool = False,
) -> None:
    """Rebuild the connections of the dates; their offsets must be solved.

    The new connections are written aside and checked first: a build that fails leaves the
    stored dates as they were.
    """
    legs = _of_dates(table(spark, root, "legs"), dates)
    wanted = _date_table(spark, legs, dates)
    named = dates or [str(r.flightdate) for r in wanted.collect()]
    edges = stage(conn.build_connections(legs, min_layover, max_layover, strict_carrier), "edges", "flightdate")
    conn.require_built(edges, legs, wanted)
    drop_dates(spark, f"{root}/built", named)  # while connections change, the date is refused
    replace_dates(edges, f"{root}/connections", named)
    replace_dates(conn.connections_per_date(edges), f"{root}/built", named)


def rotation_links(spark: SparkSession, root: str, dates: list[str] | None = None) -> DataFrame:
    """Every solved leg of an aircraft beside the one before it."""
    return rotations.rotations(_of_dates(table(spark, root, "legs"), dates))


def cancellations(spark: SparkSession, root: str, dates: list[str] | None = None) -> DataFrame:
    """Cancel rates by what the aircraft did before, over the solved dates."""
    legs = _of_dates(table(spark, root, "legs"), dates)
    missed = legs.select(*table(spark, root, "loaded").columns).limit(0)
    if path_exists(spark, f"{root}/cancelled"):
        missed = _of_dates(table(spark, root, "cancelled"), dates)
    missed = offsets.utc_times(missed, table(spark, root, "offsets"))
    return rotations.cancellation_after_break(legs, missed)


def built_dates(spark: SparkSession, root: str) -> DataFrame:
    """flightdate, connections: a row a date, written with the connections."""
    if path_exists(spark, f"{root}/built"):
        return spark.read.schema("connections long, flightdate date").parquet(f"{root}/built")
    return conn.connections_per_date(table(spark, root, "connections"))


def search_table(spark: SparkSession, root: str, requests: DataFrame, served: bool = False) -> DataFrame:
    legs, connections = table(spark, root, "legs"), table(spark, root, "connections")
    return search(requests, legs, connections, served, built_dates(spark, root))

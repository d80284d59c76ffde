"""The stage tables that the registered queries share, each written once per session."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import connections as conn
from skyloom.operators import legs as leg
from skyloom.operators import network, offsets, rotations
from skyloom.operators.requests import request_workload
from skyloom.operators.search import search
from skyloom.sources.fleet_records import FLEET_FIRST, fleet_records
from skyloom.sources.order_records import STATIONS, order_records
from skyloom.sources.tables import one_per_key
from skyloom.storage import shared_root, stage

_open: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, str(sf_dir).rstrip("/"))
    if key not in _open:
        _open[key] = Tables(spark, key[1])
    return _open[key]


class Tables:
    """records -> loaded -> offsets -> legs -> connections, routes; built when first used.

    They are read whole, so they are written as they come: dealing them out by date would
    shuffle every row once more, three times on the way to the connections.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def records(self) -> DataFrame:
        return stage(order_records(self.spark, self.sf_dir), "records")

    @cached_property
    def loaded(self) -> DataFrame:
        """Legs as loaded, arrival still on the departure date."""
        valid = leg.valid_legs(self.records, strict=True)
        return stage(one_per_key(leg.project_legs(valid)), "loaded")

    @cached_property
    def solution(self) -> offsets.Solution:
        return offsets.solve_offsets(offsets.offset_deltas(self.loaded), dates=self.dates)

    @cached_property
    def offsets(self) -> DataFrame:
        return stage(offsets.require_solved(self.solution), "offsets")

    @cached_property
    def legs(self) -> DataFrame:
        """Legs with UTC times and the repaired arrival."""
        return stage(offsets.utc_times(self.loaded, self.offsets), "legs")

    @cached_property
    def connections(self) -> DataFrame:
        return stage(conn.build_connections(self.legs), "connections")

    @cached_property
    def built(self) -> DataFrame:
        return stage(conn.connections_per_date(self.connections), "built")

    @cached_property
    def strict_connections(self) -> DataFrame:
        return conn.build_connections(self.legs, strict_carrier=True)

    @cached_property
    def routes(self) -> DataFrame:
        return stage(network.routes(self.loaded, self.airports), "routes")

    @property
    def airports(self) -> DataFrame:
        return leg.airports(self.loaded)

    @property
    def dates(self) -> DataFrame:
        return self.loaded.select("flightdate").distinct()

    def workload(self, **columns) -> DataFrame:
        return request_workload(self.loaded, self.built.select("flightdate"), **columns)

    def answers(self, **columns) -> DataFrame:
        return search(self.workload(**columns), self.legs, self.connections, built=self.built)

    @cached_property
    def fleet(self) -> Fleet:
        return Fleet(self.spark, self.sf_dir)

    @cached_property
    def month_files(self) -> str:
        """A folder of CSV files of the records as text, two months of different headers, with
        cells that don't convert."""
        n, day = F.col("flight_number_reporting_airline"), F.to_date("flightdate")
        later = F.dayofmonth(day) >= 18
        date = F.when(later, F.date_add(day, 31)).otherwise(day)
        junk = lambda every, text, value: F.when(F.pmod(n, F.lit(every)) == 0, text).otherwise(value)
        cells = {
            "Year": F.year(date).cast("string"),
            "Month": F.month(date).cast("string"),
            "FlightDate": junk(23, "2025-02-30", F.date_format(date, "yyyy-MM-dd")),
            "Reporting_Airline": F.col("reporting_airline"),
            "Flight_Number_Reporting_Airline": junk(17, "N/A", junk(13, F.concat(n.cast("string"), F.lit(".0")), n.cast("string"))),
            "Origin": F.col("origin"),
            "Dest": F.col("dest"),
            "CRSDepTime": junk(19, "2560", F.date_format("crsdeptime", "HHmm")),
            "Distance": junk(11, "far", F.col("distance").cast("string")),
        }
        text = self.records.select(later.alias("later"), *[c.alias(k) for k, c in cells.items()], n.alias("n"))
        path = f"{shared_root(self.spark)}/skyloom/{self.spark.sparkContext.applicationId}/months-{uuid.uuid4().hex[:12]}"
        writer = lambda df: df.write.mode("append").option("header", True).csv(path)
        writer(text.filter("not later").drop("later", "n"))
        agency = F.when(F.pmod("n", F.lit(29)) != 0, F.lit("19805")).alias("DOT_ID_Reporting_Airline")
        writer(text.filter("later").select(agency, *reversed(cells)))
        return path

    @property
    def raw_requests(self) -> DataFrame:
        """Requests as typed by users, well and badly formed, one per event."""
        e, k = F.col("event_id"), F.pmod("event_id", F.lit(16))

        def station(index):
            codes = F.array(*[F.lit(c) for c in STATIONS])
            return F.element_at(codes, (F.pmod(index, F.lit(len(STATIONS))) + 1).cast("int"))

        origin, dest = station(F.col("user_id")), station(e * 7)
        day = F.concat(F.lit("2025-07-"), (14 + F.pmod(e, F.lit(9))).cast("string"))
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet").select(
            e.alias("request_id"),
            F.when(k == 1, F.concat(F.lit(" "), F.lower(origin), F.lit("  ")))
            .when(k == 2, F.lit("LG1"))
            .when(k == 3, F.lit("  "))
            .otherwise(origin)
            .alias("origin"),
            F.when(k == 4, F.lit("12")).when(k == 5, F.lit(None)).otherwise(dest).alias("dest"),
            F.when(k == 6, F.lit("18/07/2025"))
            .when(k == 7, F.lit("2025-13-01"))
            .when(k == 8, F.lit(" 2025-7-18 "))
            .otherwise(day)
            .alias("date"),
            F.when(k == 9, F.lit("9am"))
            .when(k == 10, F.lit("25:00"))
            .when(k == 11, F.lit("9:05"))
            .when(k == 12, F.lit("2025-07-18T08:00"))
            .when(k == 13, F.lit(" "))
            .alias("depart_after"),
            F.when(k == 14, F.lit("15:00"))
            .when(k == 15, F.lit("2025-07-19 01:30"))
            .when(k == 8, F.lit("noon"))
            .alias("arrive_before"),
            F.pmod(e, F.lit(3)).cast("int").alias("max_stops"),
            F.when(F.pmod(e, F.lit(11)) == 0, 1).otherwise(0).alias("min_stops"),
            F.when(F.pmod(e, F.lit(29)) == 0, 0).otherwise(1 + F.pmod(e, F.lit(5))).cast("int").alias("limit"),
        )

    @property
    def request_log(self) -> DataFrame:
        """Timed requests, one per event."""
        name = (
            F.when(F.pmod("event_id", F.lit(50)) == 0, "Aggregated")
            .when(F.pmod("user_id", F.lit(2)) == 0, "nonstop lookup")
            .otherwise("itinerary search {0,2}")
        )
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet").select(
            name.alias("name"),
            F.col("value").alias("response_ms"),
            (F.col("event_type") == "error").alias("failed"),
            F.col("ts").alias("at"),
            F.col("event_type").alias("kind"),
        )


class Fleet(Tables):
    """The same tables from the records of aircraft rotations over two months."""

    @cached_property
    def records(self) -> DataFrame:
        return stage(fleet_records(self.spark, self.sf_dir), "fleet-records")

    @cached_property
    def solution(self) -> offsets.Solution:
        """Solved once for all dates: no station changes its clock, and a date has few legs a pair."""
        once = self.loaded.withColumn("flightdate", F.lit(FLEET_FIRST).cast("date"))
        return offsets.solve_offsets(offsets.offset_deltas(once), dates=once.select("flightdate").distinct())

    @cached_property
    def offsets(self) -> DataFrame:
        solved = offsets.require_solved(self.solution).drop("flightdate")
        ends = self.records.select(F.to_date("flightdate").alias("flightdate"), "origin", "dest")
        return stage(leg.airports_per_date(ends).join(solved, F.col("code") == F.col("airport")).drop("code"), "fleet-offsets")

    @cached_property
    def cancelled(self) -> DataFrame:
        """Cancelled legs with UTC times, beside the flown ones."""
        missed = stage(one_per_key(leg.project_legs(leg.cancelled_legs(self.records))), "fleet-cancelled")
        return offsets.utc_times(missed, self.offsets)

    @cached_property
    def rotations(self) -> DataFrame:
        return rotations.rotations(self.legs)

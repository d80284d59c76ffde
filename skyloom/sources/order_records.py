"""On-time records derived from the order tables, as stand-in flight data.

One record per order line. Airports are the 25 nations, carriers are blocks of 100
parts (so the number of carriers grows with the data and a carrier's network keeps its
size), the week is the one of 2025-07-14. Each station has a fixed true offset, which
only the oracle may use: the records hold local clocks and block time alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



# Station code of each nation, by nation key.
STATIONS = (
    "ATL", "DFW", "DEN", "ORD", "PHX", "CLT", "LAX", "LAS", "MCO", "SEA", "MIA", "IAH", "JFK",
    "EWR", "SFO", "DTW", "BOS", "MSP", "LGA", "PHL", "SLC", "BWI", "SAN", "HNL", "GUM",
)

# Code of the first carriers; later ones are X16, X17, ...
CARRIERS = (
    "AA", "MQ", "DL", "9E", "OO", "YX", "UA", "WN", "OH", "AS", "QX", "B6", "NK", "F9", "HA", "G4",
)

FIRST_DATE = "2025-07-14"
DATES = 7
_A, _R = 1, 3


def _pick(values, index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _true_offset(nation: Column, weekday: Column) -> Column:
    """Whole hours in (-720, 720]; every third station moves its clock on the fifth date."""
    moved = F.when((nation % 3 == 0) & (weekday >= 4), 60).otherwise(0)
    return 60 * F.pmod(nation * 7, F.lit(24)) - 660 + moved


def _clock(minute: Column) -> Column:
    minute = F.pmod(minute, F.lit(1440))
    return F.make_timestamp_ntz(
        F.lit(1900), F.lit(1), F.lit(1), F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)), F.lit(0)
    )


def _flag_rank(flag: Column) -> Column:
    """Where a return flag lies among "A" and "R"; the smallest flag has the smallest rank. Minima of
    numbers are kept in a hash table, those of text sort all lines."""
    return F.when(flag < "A", 0).when(flag == "A", _A).when(flag < "R", 2).when(flag == "R", _R).when(flag.isNotNull(), 4)


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    # Lines are merged before they meet their order: the map-side half leaves at most seven
    # rows per order and task, so an order with very many lines is no hot key of the join.
    line = table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("pk"),
        F.min("l_suppkey").alias("sk"),
        F.min("l_quantity").cast("int").alias("qty"),
        F.min(_flag_rank(F.col("l_returnflag"))).alias("rf"),
    )
    order = table("orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("ck"))
    line = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.join(table("supplier"), F.col("sk") == F.col("s_suppkey"))
    line = line.join(table("customer"), F.col("ck") == F.col("c_custkey"))

    # Worked out column by column: one expression nested in another many times over makes code
    # too long for Java to compile, and it is interpreted row by row.
    ok, ln, pk = F.col("ok"), F.col("ln"), F.col("pk")
    o, d, weekday = F.col("o"), F.col("d"), F.col("weekday")
    line = line.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), "pk", "sk", "qty", "rf",
        F.col("s_nationkey").alias("o"), F.col("c_nationkey").alias("d"),
        F.pmod("l_orderkey", F.lit(DATES)).alias("weekday"),
    )
    line = line.select(
        "*",
        F.floor(pk / 100).alias("carrier"),
        (45 + 15 * F.abs(o - d)).alias("block"),
        (F.pmod(pk * 37 + ln * 113, F.lit(288)) * 5).alias("dep"),
        (F.pmod(pk + ln * 7, F.lit(61)) - 10).alias("dep_delay"),
        _true_offset(o, weekday).alias("off_o"),
        _true_offset(d, weekday).alias("off_d"),
        F.date_add(F.lit(FIRST_DATE).cast("date"), weekday.cast("int")).alias("day"),
    )
    line = line.select(
        "*",
        (F.col("dep") - F.col("off_o") + F.col("block") + F.col("off_d")).alias("arr"),
        (F.col("dep_delay") + F.pmod(F.col("sk"), F.lit(21)) - 10).alias("arr_delay"),
    )
    carrier, block, dep, arr, dep_delay, arr_delay, day = (
        F.col(c) for c in ("carrier", "block", "dep", "arr", "dep_delay", "arr_delay", "day")
    )
    cancelled = (
        F.when(F.col("qty") == 50, F.lit(1.0))
        .when((F.col("qty") == 1) & (F.col("rf") == _A), F.lit(None).cast("double"))
        .otherwise(F.lit(0.0))
    )
    flown = F.col("qty") != 50

    return line.select(
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        day.cast("timestamp_ntz").alias("flightdate"),
        F.coalesce(_pick(CARRIERS, carrier), F.concat(F.lit("X"), carrier.cast("string"))).alias(
            "reporting_airline"
        ),
        (ok * 10 + ln).alias("flight_number_reporting_airline"),
        F.when(F.col("qty") != 3, F.concat(F.lit("N"), F.floor(pk / 5).cast("string"))).alias("tail_number"),
        _pick(STATIONS, o).alias("origin"),
        _pick(STATIONS, d).alias("dest"),
        _clock(dep).alias("crsdeptime"),
        _clock(arr).alias("crsarrtime"),
        F.when(flown, _clock(dep + dep_delay)).alias("deptime"),
        F.when(flown, _clock(arr + arr_delay)).alias("arrtime"),
        F.when(~((F.col("qty") == 2) & (F.col("rf") == _R)), block.cast("double")).alias("crselapsedtime"),
        F.when(flown, (block + arr_delay - dep_delay).cast("double")).alias("actualelapsedtime"),
        (50 + 110 * F.abs(o - d)).cast("double").alias("distance"),
        F.when(flown, dep_delay.cast("double")).alias("depdelay"),
        F.when(flown, arr_delay.cast("double")).alias("arrdelay"),
        cancelled.alias("cancelled"),
    )

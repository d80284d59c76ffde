"""Records of aircraft that fly day rotations from a base, derived from the order tables.

An order is a day of an aircraft, its distinct lines are the legs: out to a spoke and back, at last
home. Sixty-two consecutive orders are one aircraft, two months of it. A day of one leg leaves the
aircraft away from home, so that the next day starts out of position; the first leg of such a day
is cancelled more often. Lines that an order repeats are repeated records of one leg, with other
delays. Five stations are hubs, so most pairs have no nonstop; 250 aircraft make a carrier. The
stations' true offsets (no clock changes) are known to the oracle only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.sources.order_records import CARRIERS, STATIONS, _clock, _pick

FLEET_FIRST = "2025-07-01"
FLEET_DAYS, FLEET_CARRIER = 62, 250


def fleet_offset(station: Column) -> Column:
    return -60 * (3 + station % 7)


def fleet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").cast("long").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").cast("int").alias("qty"),
    )
    ok, ln = F.col("ok"), F.col("ln")
    # Days of one leg, merged before the shuffle: smallest and largest line are the same.
    single = raw.groupBy("ok").agg(F.min("ln").alias("low"), F.max("ln").alias("high")).filter("low = high")
    away = single.select((ok + 1).alias("ok"), F.lit(True).alias("away"))
    # Lines are numbered where an order's rows lie, so that they are dealt out once.
    order = Window.partitionBy("ok")
    rows = raw.filter(ok.isNotNull()).withColumn("k", F.dense_rank().over(order.orderBy(ln.asc_nulls_last())).cast("long"))
    rows = rows.withColumn("k", F.when(ln.isNotNull(), F.col("k")))
    rows = rows.withColumn("n", F.coalesce(F.max("k").over(order), F.lit(0))).join(away, "ok", "left")
    n, k = F.col("n"), F.col("k")
    aircraft, base = F.floor(ok / FLEET_DAYS), 5 * (F.floor(ok / FLEET_DAYS) % 5)
    spoke = lambda leg: (base + 1 + (ok * 3 + leg * 5) % 5) % 25

    def lands(leg):
        return (
            F.when((leg == n) & (n > 1), base)
            .when(leg % 2 == 1, spoke(leg))
            .when(leg == n - 1, (spoke(leg - 1) + 1) % 25)
            .otherwise(base)
        )

    origin, dest = F.when(k == 1, base).otherwise(lands(k - 1)), lands(k)
    rows = rows.select("*", aircraft.alias("aircraft"), base.alias("base"), origin.alias("o"), dest.alias("d"))
    o, d = F.col("o"), F.col("d")
    apart = F.least(F.abs(o - d), 25 - F.abs(o - d))
    block = 40 + 5 * apart
    leaves = (ok % FLEET_DAYS) * 1440 + 300 - fleet_offset(F.col("base")) + (k - 1) * 180 + (ok * 13 + ln * 7) % 60
    dep, arr = leaves + fleet_offset(o), leaves + block + fleet_offset(d)
    dep_delay = F.pmod(F.col("pk") + ln * 7, F.lit(61)) - 10
    arr_delay = dep_delay + F.pmod(F.col("sk"), F.lit(21)) - 10
    stranded = F.coalesce("away", F.lit(False)) & (ok % FLEET_DAYS > 0) & (k == 1)
    flown = ~((F.col("qty") == 50) | (stranded & (F.col("qty") <= 20)))
    day = F.date_add(F.lit(FLEET_FIRST).cast("date"), F.floor(dep / 1440).cast("int"))
    carrier = F.floor(F.col("aircraft") / FLEET_CARRIER)
    return rows.select(
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        day.cast("timestamp_ntz").alias("flightdate"),
        F.coalesce(_pick(CARRIERS, carrier), F.concat(F.lit("X"), carrier.cast("string"))).alias("reporting_airline"),
        (ok * 10 + ln).alias("flight_number_reporting_airline"),
        F.when(F.col("qty") != 3, F.concat(F.lit("N"), F.col("aircraft").cast("string"))).alias("tail_number"),
        _pick(STATIONS, o).alias("origin"),
        _pick(STATIONS, d).alias("dest"),
        _clock(dep).alias("crsdeptime"),
        _clock(arr).alias("crsarrtime"),
        F.when(flown, _clock(dep + dep_delay)).alias("deptime"),
        F.when(flown, _clock(arr + arr_delay)).alias("arrtime"),
        block.cast("double").alias("crselapsedtime"),
        F.when(flown, (block + arr_delay - dep_delay).cast("double")).alias("actualelapsedtime"),
        (50 + 110 * apart).cast("double").alias("distance"),
        F.when(flown, dep_delay.cast("double")).alias("depdelay"),
        F.when(flown, arr_delay.cast("double")).alias("arrdelay"),
        F.when(flown, 0.0).otherwise(1.0).alias("cancelled"),
    )

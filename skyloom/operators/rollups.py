"""Counts and rankings over legs and connections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entity_counts(legs: DataFrame, route_table: DataFrame, connections: DataFrame) -> DataFrame:
    """Rows per entity and edge kind, one row each; every leg has one edge of each leg kind."""
    per_leg = legs.agg(
        F.count("*").alias("legs"),
        F.count("origin").alias("departs_from"),
        F.count("dest").alias("arrives_at"),
        F.count("reporting_airline").alias("operated_by"),
        F.count_distinct("reporting_airline").alias("carriers"),
    )
    ends = legs.select(F.explode(F.array("origin", "dest")).alias("a")).agg(F.count_distinct("a").alias("airports"))
    parts = [
        per_leg.unpivot([], list(per_leg.columns), "entity", "n"),
        ends.unpivot([], ["airports"], "entity", "n"),
        route_table.agg(F.count("*").alias("n")).select(F.lit("routes").alias("entity"), "n"),
        connections.agg(F.count("*").alias("n")).select(F.lit("connections").alias("entity"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def below_floors(counts: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Entities that hold fewer rows than the stated floor."""
    pairs = [F.lit(x) for item in floors.items() for x in item]
    floor = F.try_element_at(F.create_map(*pairs), F.col("entity"))
    return counts.withColumn("floor", floor).filter(F.col("n") < F.col("floor"))


def day_density(legs: DataFrame) -> DataFrame:
    return legs.agg(
        F.count("*").alias("legs"), F.count_distinct("flightdate").alias("days")
    ).withColumn("legs_per_day", F.try_divide("legs", "days"))


def flights_per_date(legs: DataFrame) -> DataFrame:
    return legs.groupBy("flightdate").agg(F.count("*").alias("flights"))


def busiest_date(legs: DataFrame) -> DataFrame:
    return flights_per_date(legs).orderBy(F.col("flights").desc(), "flightdate").limit(1)


def major_hubs(legs: DataFrame, above: int = 200) -> DataFrame:
    arrivals = legs.groupBy(F.col("dest").alias("airport")).agg(F.count("*").alias("arrivals"))
    return arrivals.filter(F.col("arrivals") > above)


def major_carriers(legs: DataFrame, above: int = 100) -> DataFrame:
    flights = legs.groupBy(F.col("reporting_airline").alias("carrier")).agg(F.count("*").alias("flights"))
    return flights.filter(F.col("flights") > above)


def carriers_on_route(legs: DataFrame, airports: list[str]) -> DataFrame:
    """Distinct carriers between the given airports, per date and direction."""
    both = F.col("origin").isin(*airports) & F.col("dest").isin(*airports) & (F.col("origin") != F.col("dest"))
    return (
        legs.filter(both)
        .groupBy("flightdate", "origin", "dest")
        .agg(F.count_distinct("reporting_airline").alias("carriers"))
    )


def _per_hub(connections: DataFrame) -> DataFrame:
    return connections.groupBy("hub").agg(F.count("*").alias("connections"))


def connecting_hubs(connections: DataFrame, top: int = 10) -> DataFrame:
    """The largest connecting airports and the share of all connections each carries."""
    per_hub = _per_hub(connections)
    total = per_hub.agg(F.sum("connections").alias("total"))
    return (
        per_hub.orderBy(F.col("connections").desc(), "hub")
        .limit(top)
        .join(F.broadcast(total))
        .select("hub", "connections", (F.col("connections") / F.col("total")).alias("share"))
    )


def unexpected_hubs(hubs: DataFrame, known: DataFrame) -> DataFrame:
    """Hubs that are not in the list of known ones."""
    return hubs.join(known.select(F.col("code").alias("hub")), "hub", "left_anti")


def carrier_hubs(connections: DataFrame, top: int = 4) -> DataFrame:
    """Each carrier's largest connecting airports, by the carrier of the first leg."""
    per = connections.groupBy(F.col("from_carrier").alias("carrier"), "hub").agg(F.count("*").alias("connections"))
    order = Window.partitionBy("carrier").orderBy(F.col("connections").desc(), "hub")
    return per.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def thin_hubs(connections: DataFrame, below: int = 100) -> DataFrame:
    """Airports that connect too few legs to matter, and their share of all connections."""
    thin = F.col("connections") < below
    return (
        _per_hub(connections)
        .agg(
            F.count("*").alias("hubs"),
            F.count_if(thin).alias("thin_hubs"),
            F.sum(F.when(thin, F.col("connections")).otherwise(0)).alias("thin_connections"),
            F.sum("connections").alias("connections"),
        )
        .withColumn("share", F.try_divide("thin_connections", "connections"))
    )


def carrier_frequency(legs: DataFrame) -> DataFrame:
    return legs.groupBy(F.col("reporting_airline").alias("carrier")).agg(F.count("*").alias("flights"))


def airport_frequency(legs: DataFrame) -> DataFrame:
    """Appearances of an airport at either end."""
    ends = legs.select(F.explode(F.array("origin", "dest")).alias("airport"))
    return ends.groupBy("airport").agg(F.count("*").alias("appearances"))


def carrier_distance(legs: DataFrame) -> DataFrame:
    miles = F.col("distance_miles").cast("double")
    return legs.groupBy(F.col("reporting_airline").alias("carrier")).agg(
        F.avg(miles).alias("mean_miles"),
        F.sum(miles).alias("total_miles"),
        F.count(miles).alias("with_distance"),
        F.count("*").alias("flights"),
    )


def route_distance(legs: DataFrame) -> DataFrame:
    return legs.groupBy("origin", "dest").agg(
        F.avg(F.col("distance_miles").cast("double")).alias("mean_miles"),
        F.count_distinct("reporting_airline").alias("carriers"),
    )


# Names of the five distance bands.
BANDS = ("short", "medium", "long", "very_long", "ultra_long")


def distance_bands(legs: DataFrame) -> DataFrame:
    """Legs per carrier in five equally wide distance bands; a band includes its upper end."""
    miles = F.col("distance_miles").cast("double")
    span = legs.agg(F.min(miles).alias("low"), F.max(miles).alias("high"))
    width = (F.col("high") - F.col("low")) / len(BANDS)
    band = F.least(
        F.greatest(F.ceil(F.try_divide(miles - F.col("low"), width)), F.lit(1)), F.lit(len(BANDS))
    )
    band = F.when(width == 0, len(BANDS) // 2 + 1).otherwise(band)
    name = F.try_element_at(F.array(*[F.lit(b) for b in BANDS]), band.cast("int"))
    return (
        legs.join(F.broadcast(span))
        .select(F.col("reporting_airline").alias("carrier"), name.alias("band"))
        .filter(F.col("band").isNotNull())
        .groupBy("carrier", "band")
        .agg(F.count("*").alias("flights"))
    )


def readiness_by_date(legs: DataFrame, connections: DataFrame) -> DataFrame:
    """Loaded dates and whether connecting searches can be answered on them."""
    built = connections.select("flightdate").distinct().withColumn("searchable", F.lit(True))
    return (
        legs.select("flightdate")
        .distinct()
        .join(built, "flightdate", "left")
        .withColumn("searchable", F.coalesce("searchable", F.lit(False)))
    )

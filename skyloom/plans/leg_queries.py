"""Legs, entities, filters and counts over legs."""

from pyspark.sql import functions as F

from skyloom.operators import legs as leg
from skyloom.operators import quality, rollups
from skyloom.plans.registry import query
from skyloom.plans.sql import EDGES, LEGS, RECORDS, day, fam, ts
from skyloom.functions import carrier_family
from skyloom.sources import scan, tables as sinks

HUBS = ["ATL", "DFW", "DEN", "ORD"]


@query(
    "dataset_summary",
    f"""WITH {RECORDS}
    SELECT count(*) AS total_flights, count(DISTINCT dd // 1000) AS months, count(DISTINCT car) AS airlines,
           (SELECT count(*) FROM (SELECT o FROM rec UNION SELECT d FROM rec)) AS airports FROM rec""",
)
def dataset_summary(t):
    return scan.dataset_summary(t.records)


@query("month_breakdown", f"WITH {RECORDS} SELECT '2025-07' AS month, count(*) AS flights FROM rec")
def month_breakdown(t):
    return scan.month_breakdown(t.records)


@query(
    "valid_legs",
    f"""WITH {RECORDS}
    SELECT {day()} AS flightdate, count(*) AS records, count(*) FILTER (cancelled = 0) AS valid,
           count(*) FILTER (cancelled = 0 AND o <> d) AS strictly_valid FROM rec GROUP BY dd""",
)
def valid_legs(t):
    return t.records.groupBy(F.col("flightdate").cast("date").alias("flightdate")).agg(
        F.count("*").alias("records"),
        F.count_if(leg.is_valid()).alias("valid"),
        F.count_if(leg.is_valid(strict=True)).alias("strictly_valid"),
    )


@query(
    "legs",
    f"""WITH {LEGS}
    SELECT {day()} AS flightdate, car AS reporting_airline, num AS flight_number_reporting_airline,
           o AS origin, d AS dest, {ts("t0 + dep")} AS scheduled_departure_time,
           {ts("t0 + arr")} AS scheduled_arrival_time, {ts("t0 + real_dep")} AS actual_departure_time,
           {ts("t0 + real_arr")} AS actual_arrival_time, CAST(blk AS BIGINT) AS scheduled_duration_minutes,
           CAST(blk0 + arr_delay - dep_delay AS BIGINT) AS actual_duration_minutes,
           CAST(miles AS DOUBLE) AS distance_miles, tail AS tail_number,
           CAST(dep_delay AS BIGINT) AS departure_delay_minutes,
           CAST(arr_delay AS BIGINT) AS arrival_delay_minutes FROM loaded""",
)
def legs(t):
    return sinks.one_per_key(leg.project_legs(leg.valid_legs(t.records, strict=True)))


@query(
    "date_filter",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, o AS origin, count(*) AS flights
    FROM loaded WHERE dd = 4 GROUP BY dd, o""",
)
def date_filter(t):
    same_day = leg.between_dates(t.loaded, "2025-07-18", "2025-07-19")
    return same_day.groupBy("flightdate", "origin").agg(F.count("*").alias("flights"))


@query(
    "date_equality",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, o AS origin, count(*) AS flights
    FROM loaded WHERE dd = 4 GROUP BY dd, o""",
)
def date_equality(t):
    return leg.on_date(t.loaded, "2025-07-18").groupBy("flightdate", "origin").agg(F.count("*").alias("flights"))


@query(
    "depart_after",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, o AS origin, count(*) AS flights FROM leg
    WHERE dep_l >= t0 + 480 GROUP BY dd, o""",
)
def depart_after(t):
    bound = F.timestamp_add("HOUR", F.lit(8), F.col("flightdate").cast("timestamp_ntz"))
    return leg.depart_after(t.legs, bound).groupBy("flightdate", "origin").agg(F.count("*").alias("flights"))


@query(
    "arrive_before",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, d AS dest, count(*) AS flights FROM leg
    WHERE arr_l < t0 + 900 GROUP BY dd, d""",
)
def arrive_before(t):
    bound = F.timestamp_add("HOUR", F.lit(15), F.col("flightdate").cast("timestamp_ntz"))
    return leg.arrive_before(t.legs, bound).groupBy("flightdate", "dest").agg(F.count("*").alias("flights"))


@query(
    "morning_departures",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, o AS origin, count(*) AS flights FROM loaded
    WHERE dep >= 360 AND dep < 540 AND o IN ('ATL', 'DFW', 'DEN', 'ORD') GROUP BY dd, o""",
)
def morning_departures(t):
    rows = leg.departures_by_hour(t.loaded, 6, 9, HUBS)
    return rows.groupBy("flightdate", "origin").agg(F.count("*").alias("flights"))


@query(
    "carriers_on_route",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, o AS origin, d AS dest, count(DISTINCT car) AS carriers
    FROM loaded WHERE o IN ('ATL', 'DFW') AND d IN ('ATL', 'DFW') GROUP BY dd, o, d""",
)
def carriers_on_route(t):
    return rollups.carriers_on_route(t.loaded, ["ATL", "DFW"])


@query(
    "direct_flights",
    f"""WITH {LEGS} SELECT flight, {ts("dep_l")} AS departs, {ts("arr_l")} AS arrives,
    CAST(blk AS BIGINT) AS minutes FROM leg WHERE dd = 4 AND o = 'LGA' AND d = 'DFW'""",
)
def direct_flights(t):
    return leg.direct_flights(t.legs, "LGA", "DFW", "2025-07-18")


@query("airports", f"WITH {LEGS} SELECT o AS code FROM loaded UNION SELECT d FROM loaded")
def airports(t):
    return t.airports


@query(
    "airports_unpivot",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, code FROM
    (SELECT dd, o AS code FROM loaded UNION SELECT dd, d FROM loaded)""",
)
def airports_unpivot(t):
    return leg.airports_per_date(t.loaded)


@query("carriers", f"WITH {LEGS} SELECT DISTINCT car AS code FROM loaded")
def carriers(t):
    return leg.carriers(t.loaded)


@query(
    "carrier_family",
    f"WITH {LEGS} SELECT car AS carrier, {fam('car')} AS family, count(*) AS flights FROM loaded GROUP BY car",
)
def family(t):
    return t.loaded.groupBy(
        F.col("reporting_airline").alias("carrier"), carrier_family("reporting_airline").alias("family")
    ).agg(F.count("*").alias("flights"))


@query(
    "leg_endpoints",
    f"""WITH {LEGS} SELECT 'departs_from' AS kind, o AS node, count(*) AS legs FROM loaded GROUP BY o
    UNION ALL SELECT 'arrives_at', d, count(*) FROM loaded GROUP BY d
    UNION ALL SELECT 'operated_by', car, count(*) FROM loaded GROUP BY car""",
)
def leg_endpoints(t):
    whole = leg.leg_endpoints(t.loaded, t.airports, leg.carriers(t.loaded))
    kinds = {
        "departs_from": sinks.departs_from(whole).withColumnRenamed("airport", "node"),
        "arrives_at": sinks.arrives_at(whole).withColumnRenamed("airport", "node"),
        "operated_by": sinks.operated_by(whole).withColumnRenamed("carrier", "node"),
    }
    parts = [
        df.groupBy("node").agg(F.count("*").alias("legs")).withColumn("kind", F.lit(kind))
        for kind, df in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "entity_counts",
    f"""WITH {EDGES},
    r AS (SELECT count(*) AS n FROM loaded)
    SELECT 'legs' AS entity, n FROM r UNION ALL SELECT 'departs_from', n FROM r
    UNION ALL SELECT 'arrives_at', n FROM r UNION ALL SELECT 'operated_by', n FROM r
    UNION ALL SELECT 'carriers', count(DISTINCT car) FROM loaded
    UNION ALL SELECT 'airports', count(*) FROM (SELECT o FROM loaded UNION SELECT d FROM loaded)
    UNION ALL SELECT 'routes', count(*) FROM (SELECT DISTINCT o, d FROM loaded)
    UNION ALL SELECT 'connections', count(*) FROM edge""",
)
def entity_counts(t):
    return rollups.entity_counts(t.loaded, t.routes, t.connections)


@query(
    "day_density",
    f"""WITH {LEGS} SELECT count(*) AS legs, count(DISTINCT dd) AS days,
    CAST(count(*) AS DOUBLE) / count(DISTINCT dd) AS legs_per_day FROM loaded""",
)
def day_density(t):
    return rollups.day_density(t.loaded)


@query(
    "busiest_date",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, count(*) AS flights FROM loaded GROUP BY dd
    ORDER BY flights DESC, dd LIMIT 1""",
)
def busiest_date(t):
    return rollups.busiest_date(t.loaded)


@query(
    "major_hubs",
    f"WITH {LEGS} SELECT d AS airport, count(*) AS arrivals FROM loaded GROUP BY d HAVING count(*) > 200",
)
def major_hubs(t):
    return rollups.major_hubs(t.loaded)


@query(
    "major_carriers",
    f"WITH {LEGS} SELECT car AS carrier, count(*) AS flights FROM loaded GROUP BY car HAVING count(*) > 100",
)
def major_carriers(t):
    return rollups.major_carriers(t.loaded)


@query("carrier_frequency", f"WITH {LEGS} SELECT car AS carrier, count(*) AS flights FROM loaded GROUP BY car")
def carrier_frequency(t):
    return rollups.carrier_frequency(t.loaded)


@query(
    "airport_frequency",
    f"""WITH {LEGS} SELECT airport, count(*) AS appearances FROM
    (SELECT o AS airport FROM loaded UNION ALL SELECT d FROM loaded) GROUP BY airport""",
)
def airport_frequency(t):
    return rollups.airport_frequency(t.loaded)


@query(
    "carrier_distance",
    f"""WITH {LEGS} SELECT car AS carrier, CAST(sum(miles) AS DOUBLE) / count(*) AS mean_miles,
    CAST(sum(miles) AS DOUBLE) AS total_miles, count(miles) AS with_distance, count(*) AS flights
    FROM loaded GROUP BY car""",
)
def carrier_distance(t):
    return rollups.carrier_distance(t.loaded)


@query(
    "route_distance",
    f"""WITH {LEGS} SELECT o AS origin, d AS dest, CAST(sum(miles) AS DOUBLE) / count(*) AS mean_miles,
    count(DISTINCT car) AS carriers FROM loaded GROUP BY o, d""",
)
def route_distance(t):
    return rollups.route_distance(t.loaded)


@query(
    "distance_bands",
    f"""WITH {LEGS}, span AS (SELECT min(miles) AS lo, max(miles) AS hi FROM loaded),
    banded AS (SELECT car, CAST(least(greatest(ceil((miles - lo) / ((hi - lo) / 5.0)), 1), 5) AS INTEGER) AS b
               FROM loaded, span)
    SELECT car AS carrier, CASE b WHEN 1 THEN 'short' WHEN 2 THEN 'medium' WHEN 3 THEN 'long'
           WHEN 4 THEN 'very_long' ELSE 'ultra_long' END AS band, count(*) AS flights
    FROM banded GROUP BY car, b""",
)
def distance_bands(t):
    return rollups.distance_bands(t.loaded)


@query(
    "completeness",
    f"""WITH {RECORDS}, c AS (
      SELECT count(*) AS n, count(tail) AS tail, count(blk) AS blk, count(real_dep) AS real_dep,
             count(dep_delay) AS delay, count(cancelled) AS cancelled FROM rec)
    SELECT u.col AS "column", n AS rows, u.filled, CAST(u.filled AS DOUBLE) / n AS ratio,
           CAST(u.filled AS DOUBLE) / n >= 0.95 AS complete
    FROM c, LATERAL (VALUES ('flightdate', n), ('tail_number', tail), ('crselapsedtime', blk),
      ('deptime', real_dep), ('depdelay', delay), ('cancelled', cancelled)) u(col, filled)""",
)
def completeness(t):
    return quality.completeness(
        t.records, ["flightdate", "tail_number", "crselapsedtime", "deptime", "depdelay", "cancelled"]
    )


def _rules_sql() -> str:
    gap = "(arr - dep)"
    wrapped = "((arr - dep + 1440) % 1440)"
    mph = "(miles / CAST(blk AS DOUBLE) * 60)"
    rules = {
        "carrier_code": "regexp_full_match(car, '[A-Z0-9]{2}')",
        "carrier_code_lenient": "regexp_full_match(car, '[A-Z0-9]{2}')",
        "origin_code": "true",
        "dest_code": "true",
        "airport_code_lenient": "true",
        "flight_number": "num BETWEEN 1 AND 9999",
        "required_fields": "true",
        "different_ends": "o <> d",
        "cancelled_flag": "cancelled IN (0, 1)",
        "cancelled_agrees": "CASE WHEN cancelled = 1 THEN real_dep IS NULL ELSE real_dep IS NOT NULL END",
        "distance_positive": "miles > 0",
        "distance_range": "miles BETWEEN 50 AND 10000",
        "departure_delay": "dep_delay IS NULL OR dep_delay BETWEEN -30 AND 720",
        "arrival_delay": "arr_delay IS NULL OR arr_delay BETWEEN -30 AND 720",
        "date_in_era": "true",
        "same_day_sequence": f"{gap} BETWEEN 30 AND 720",
        "overnight_sequence": f"{wrapped} BETWEEN 60 AND 480",
        "plausible_duration": f"{wrapped} BETWEEN 45 AND 480",
        "clock_order": f"{gap} > 0 OR ({gap} < 0 AND {gap} + 1440 < 1080)",
        "speed_range": f"{mph} BETWEEN CASE WHEN miles < 300 THEN 100 WHEN miles < 1000 THEN 150 ELSE 200 END "
        "AND 700 AND CASE WHEN miles > 2000 THEN blk >= 240 WHEN miles < 500 THEN blk >= 45 ELSE true END",
    }
    counts = ", ".join(
        f"count(*) FILTER (NOT coalesce({ok}, false)) AS {name}" for name, ok in rules.items()
    )
    rows = ", ".join(f"('{name}', {name})" for name in rules)
    return f"""WITH {RECORDS}, c AS (SELECT count(*) AS n, {counts} FROM rec)
    SELECT u.rule, n AS checked, u.failed, CAST(u.failed AS DOUBLE) / n AS ratio
    FROM c, LATERAL (VALUES {rows}) u(rule, failed)"""


@query("quality_report", _rules_sql())
def quality_report(t):
    return quality.quality_report(t.records)


@query(
    "quality_violations",
    f"""WITH {RECORDS}, v AS (
      SELECT dd, car, 'carrier_code' AS rule FROM rec WHERE NOT regexp_full_match(car, '[A-Z0-9]{{2}}')
      UNION ALL SELECT dd, car, 'different_ends' FROM rec WHERE o = d
      UNION ALL SELECT dd, car, 'cancelled_flag' FROM rec WHERE cancelled IS NULL)
    SELECT {day()} AS flightdate, car AS carrier, rule, count(*) AS records FROM v GROUP BY dd, car, rule""",
)
def quality_violations(t):
    rules = quality.record_rules()
    chosen = {name: rules[name] for name in ("carrier_code", "different_ends", "cancelled_flag")}
    rows = quality.violations(t.records, chosen)
    return rows.groupBy(
        F.col("flightdate").cast("date").alias("flightdate"), F.col("reporting_airline").alias("carrier"), "rule"
    ).agg(F.count("*").alias("records"))


@query(
    "duplicate_keys",
    f"""WITH {RECORDS} SELECT count(*) AS repeated_keys FROM
    (SELECT dd, car, num, o, d FROM rec GROUP BY ALL HAVING count(*) > 1)""",
)
def duplicate_keys(t):
    return quality.duplicate_keys(t.records).agg(F.count("*").alias("repeated_keys"))

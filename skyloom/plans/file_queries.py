"""Written month files and stored tables read back, and checks on tables with planted faults."""

from pyspark.sql import functions as F

from skyloom.operators import connections as conn
from skyloom.operators import legs as leg
from skyloom.operators import network, quality
from skyloom.operators import search as srch
from skyloom.plans.fleet_queries import FLEET, fday
from skyloom.plans.ingest_queries import _folder
from skyloom.plans.registry import query
from skyloom.plans.rule_queries import _report_sql
from skyloom.plans.search_queries import itineraries_sql
from skyloom.plans.sql import EDGES, LEGS, RECORDS, ROUTES, day
from skyloom.sources import scan
from skyloom.sources.tables import upsert_legs, verify_written

#: Rows of the files: what is of July lies in the first, the rest in the second, some in the wrong one.
FILES = f"""{FLEET}, file AS (SELECT *, DATE '2025-07-01' + CAST(dd AS INTEGER) AS day,
  CASE WHEN (dd < 31) = (num % 41 <> 0) THEN '2025_07' ELSE '2025_08' END AS named FROM frec)"""


def _month_files(t, name, july=lambda df: df, august=lambda df: df):
    """The fleet records in files that name a month, each changed in its own way."""
    path = _folder(t, name)
    rows = t.fleet.records.drop("year", "month")
    first = (F.month("flightdate") == 7) == (F.pmod("flight_number_reporting_airline", F.lit(41)) != 0)
    for change, part, month in ((july, rows.filter(first), "2025_07"), (august, rows.filter(~first), "2025_08")):
        writer = change(part).write.mode("append").option("mapreduce.output.basename", f"flights_{month}_")
        writer.parquet(path)
    return path


def _named(column="file"):
    return F.regexp_extract(column, "flights_([0-9]{4}_[0-9]{2})_", 1)


@query(
    "strict_scan",
    f"""WITH {FILES} SELECT strftime(day, '%Y-%m') AS month, count(*) AS flights, count(tail) AS tails FROM file GROUP BY 1""",
)
def strict_scan(t):
    """Files of one schema, read as one table."""
    found = scan.scan_strict(t.spark, _month_files(t, "alike"))
    return found.groupBy(F.date_format("flightdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("flights"), F.count("tail_number").alias("tails")
    )


@query(
    "merged_scan",
    f"""WITH {FILES} SELECT named, count(*) AS flights, count(CASE WHEN named = '2025_08' THEN tail END) AS tails,
    count(CASE WHEN named = '2025_07' THEN miles END) AS distances FROM file GROUP BY named""",
)
def merged_scan(t):
    """A column that only the later files have, and one that only the earlier have."""
    path = _month_files(t, "drift", lambda df: df.drop("tail_number"), lambda df: df.drop("distance"))
    found = scan.scan_merged(t.spark, path).withColumn("file", F.input_file_name())
    return found.groupBy(_named().alias("named")).agg(
        F.count(F.lit(1)).alias("flights"), F.count("tail_number").alias("tails"), F.count("distance").alias("distances")
    )


@query(
    "file_months",
    f"""WITH {FILES} SELECT named, count(*) AS "rows", count(*) FILTER (strftime(day, '%Y_%m') = named) AS rows_in_named_month
    FROM file GROUP BY named""",
)
def file_months(t):
    """How many rows of each file lie in the month that its name states."""
    found = scan.file_month_agreement(scan.scan_strict(t.spark, _month_files(t, "named")))
    return found.groupBy(_named().alias("named")).agg(
        F.sum("rows").alias("rows"), F.sum("rows_in_named_month").alias("rows_in_named_month")
    )


@query(
    "file_schemas",
    f"""WITH {FILES} SELECT named, 'flight_number_reporting_airline' AS "column",
      CASE WHEN named = '2025_07' THEN 'int64' ELSE 'string' END AS type, named = '2025_07' AS consistent,
      CAST(count(*) FILTER (named = '2025_08' AND num % 53 = 0) AS BIGINT) AS nulls FROM file GROUP BY named
    UNION ALL SELECT named, 'div2tailnum', 'string', true, count(*) FILTER (tail IS NULL) FROM file WHERE named = '2025_07' GROUP BY named""",
)
def file_schemas(t):
    """Stored types and nulls of the columns that files must agree on; the later files differ in one."""
    n = F.col("flight_number_reporting_airline")
    text = F.when(F.pmod(n, F.lit(53)) != 0, n.cast("string"))
    path = _month_files(
        t, "clash", lambda df: df.withColumn("div2tailnum", F.col("tail_number")),
        lambda df: df.withColumn("flight_number_reporting_airline", text),
    )
    found = scan.schema_report(t.spark, path)
    return found.groupBy(_named().alias("named"), "column").agg(
        F.min("type").alias("type"), F.min("consistent").alias("consistent"), F.sum("null_count").alias("nulls")
    )


@query("stored_rows", f"""WITH {FLEET} SELECT count(*) AS stored, least(count(*), 1000) AS head FROM frec""")
def stored_rows(t):
    """Rows read back after a write, and the rows of a head sample."""
    path = _month_files(t, "stored")
    head = scan.sample_head(t.spark.read.parquet(path), 1000).agg(F.count(F.lit(1)).alias("head"))
    return head.select(F.lit(verify_written(t.spark, path)).alias("stored"), "head")


@query(
    "keyed_upsert",
    f"""WITH {FLEET}, latest AS (SELECT *, abs(ad0) % 2 AS batch FROM frec WHERE flown
      QUALIFY row_number() OVER (PARTITION BY dd, lid ORDER BY batch DESC, real_dep, real_arr, blk + ad0 - dd0, tail NULLS FIRST, dep_delay, arr_delay) = 1)
    SELECT {fday()} AS flightdate, lid AS leg, tail, dep_delay, arr_delay FROM latest""",
)
def keyed_upsert(t):
    """Two loads into one table, dates in common: of the keys that both have, the second one's rows stay."""
    path = _folder(t, "upsert")
    rows = leg.project_legs(leg.valid_legs(t.fleet.records))
    second = F.pmod("arrival_delay_minutes", F.lit(2)) == 1
    for batch in (rows.filter(~second), rows.filter(second), rows.filter(second)):  # the last changes nothing
        upsert_legs(batch, path)
    stored = leg.with_leg_id(t.spark.read.schema(rows.schema).parquet(path))
    return stored.select(
        "flightdate", F.col("leg_id").alias("leg"), F.col("tail_number").alias("tail"),
        F.col("departure_delay_minutes").alias("dep_delay"), F.col("arrival_delay_minutes").alias("arr_delay"),
    )


@query("itineraries_as_text", itineraries_sql(0))
def itineraries_as_text(t):
    """Answers with their times as ISO text, as they go into JSON."""
    found = t.answers(max_stops=0).filter(F.col("rank").isNotNull()).drop("status", "error", "searchable")
    return srch.as_text(found)


@query(
    "unbuilt_dates",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, count(*) AS total, 'no_utc' AS reason FROM leg WHERE dd = 2 GROUP BY dd
    UNION ALL SELECT {day("d")}, 0, 'no_legs' FROM (SELECT unnest([3, 7]) AS d)""",
)
def unbuilt_dates(t):
    """Of the dates 14 to 21 July one has no UTC times, one has lost its legs, one never had any."""
    at = lambda weekday: F.date_add(F.lit("2025-07-14").cast("date"), weekday)
    third = F.col("flightdate") == at(2)
    legs = t.legs.filter(F.col("flightdate") != at(3))
    legs = legs.withColumns({c: F.when(~third, F.col(c)) for c in ("scheduled_departure_utc", "scheduled_arrival_utc")})
    dates = t.dates.unionByName(t.dates.agg(F.date_add(F.max("flightdate"), 1).alias("flightdate")))
    edges = t.connections.filter(~F.col("flightdate").isin(at(2), at(3)))
    return conn.unbuilt_dates(edges, legs, dates)


@query(
    "planted_chain_faults",
    f"""WITH {EDGES}, e AS (SELECT dd, f, CASE WHEN lay % 11 = 0 THEN f ELSE t END AS t, lay % 11 <> 0 AS ok FROM edge),
    c1 AS (SELECT dd, t, ok FROM e), c2 AS (SELECT e.dd, e.t, c.ok AND e.ok AS ok FROM c1 c JOIN e ON c.dd = e.dd AND c.t = e.f),
    c3 AS (SELECT e.dd, e.t, c.ok AND e.ok AS ok FROM c2 c JOIN e ON c.dd = e.dd AND c.t = e.f)
    SELECT 1 AS stops, count(*) AS chains, count(*) FILTER (NOT ok) AS broken FROM c1
    UNION ALL SELECT 2, count(*), count(*) FILTER (NOT ok) FROM c2 UNION ALL SELECT 3, count(*), count(*) FILTER (NOT ok) FROM c3""",
)
def planted_chain_faults(t):
    """Some connections lead back onto their own first leg: chains through them are broken."""
    onto = F.when(F.col("layover_minutes") % 11 == 0, F.col("from_leg")).otherwise(F.col("to_leg"))
    return srch.chain_check(t.legs, t.connections.withColumn("to_leg", onto), 3)


_KNOWN = "('GUM', 'HNL', 'SAN')"


@query(
    "routes_of_known_airports",
    f"""WITH {ROUTES} SELECT o AS origin, d AS dest, flights FROM route WHERE o NOT IN {_KNOWN} AND d NOT IN {_KNOWN}""",
)
def routes_of_known_airports(t):
    """Routes whose ends are both in an airport table that lacks three stations."""
    known = t.airports.filter(~F.col("code").isin("GUM", "HNL", "SAN"))
    return network.routes(t.loaded, known).select("origin", "dest", "flights")


@query(
    "planted_route_repeats",
    f"""WITH {ROUTES} SELECT count(*) + count(*) FILTER (flights % 3 = 0) AS edges, count(*) AS distinct_pairs FROM route""",
)
def planted_route_repeats(t):
    repeated = t.routes.unionByName(t.routes.filter(F.col("flights") % 3 == 0))
    return network.route_uniqueness(repeated)


@query(
    "planted_record_faults",
    _report_sql(
        f"{RECORDS}, ",
        "rec",
        {
            "origin_code": "num % 31 <> 0",
            "dest_code": "num % 37 <> 0",
            "airport_code_lenient": "num % 37 <> 0",
            "required_fields": "num % 37 <> 0 AND num % 47 <> 0",
            "date_in_era": "num % 43 <> 0",
        },
    ),
)
def planted_record_faults(t):
    """Records with a code in lower case, a blank code, a carrier left out, a date before the era."""
    n = F.col("flight_number_reporting_airline")
    hit = lambda every: F.pmod(n, F.lit(every)) == 0
    faulty = t.records.withColumns(
        {
            "origin": F.when(hit(31), F.lower("origin")).otherwise(F.col("origin")),
            "dest": F.when(hit(37), F.lit(" ")).otherwise(F.col("dest")),
            "reporting_airline": F.when(~hit(47), F.col("reporting_airline")),
            "flightdate": F.when(hit(43), F.lit("1979-05-05").cast("timestamp_ntz")).otherwise(F.col("flightdate")),
        }
    )
    names = ("origin_code", "dest_code", "airport_code_lenient", "required_fields", "date_in_era")
    return quality.quality_report(faulty, {n: r for n, r in quality.record_rules().items() if n in names})

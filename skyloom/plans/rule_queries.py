"""Rules on text cells, layovers and reference rows; request caps, floors, rebuilt dates, dates
whose offsets cannot be solved, and audits of tables with planted faults."""

import uuid

from pyspark.sql import functions as F

from skyloom.operators import connections as conn
from skyloom.operators import offsets, quality, rollups
from skyloom.operators import search as srch
from skyloom.operators.requests import normalise_requests
from skyloom.plans.ingest_queries import MONTHS
from skyloom.plans.registry import query
from skyloom.plans.search_queries import REQUESTS, itineraries_sql
from skyloom.plans.sql import EDGES, LEGS, day
from skyloom.sources import records, scan
from skyloom.sources.order_records import FIRST_DATE, STATIONS
from skyloom.sources.tables import replace_dates
from skyloom.storage import shared_root


def _report_sql(ctes: str, table: str, rules: dict[str, str]) -> str:
    """The report of ``rules`` (name -> SQL that holds where the rule is met)."""
    counts = ", ".join(f"count(*) FILTER (NOT coalesce({ok}, false)) AS {name}" for name, ok in rules.items())
    rows = ", ".join(f"('{name}', {name})" for name in rules)
    return f"""WITH {ctes}c AS (SELECT count(*) AS n, {counts} FROM {table})
    SELECT u.rule, n AS checked, u.failed, CAST(u.failed AS DOUBLE) / n AS ratio
    FROM c, LATERAL (VALUES {rows}) u(rule, failed)"""


def _date(weekday: int):
    return F.date_add(F.lit(FIRST_DATE).cast("date"), weekday)


@query(
    "text_rules",
    _report_sql(
        f"{MONTHS}, ",
        "file",
        {
            "hhmm_text": "num % 19 <> 0",
            "date_text": "num % 23 <> 0",
            "whole_number": "num % 17 <> 0 AND num % 13 <> 0",
            "decimal_number": "num % 11 <> 0",
        },
    ),
)
def text_rules(t):
    """Cells of the month files as they are written, before any is typed."""
    rules = {
        "hhmm_text": quality.hhmm_text("crsdeptime"),
        "date_text": quality.date_text_valid("flightdate"),
        "whole_number": quality.whole_number("flight_number_reporting_airline").isNotNull(),
        "decimal_number": quality.decimal_number("distance").isNotNull(),
    }
    return quality.quality_report(records.read_text_csv(t.spark, t.month_files), rules)


@query(
    "layover_rules",
    _report_sql(
        f"""{LEGS}, wide AS (SELECT b.dep_u - a.arr_u AS lay FROM leg a JOIN leg b ON a.dd = b.dd AND a.d = b.o
        AND a.fam = b.fam AND b.d <> a.o AND b.dep_u - a.arr_u BETWEEN 20 AND 700), """,
        "wide",
        {"layover_range": "lay >= 45 AND lay <= 300", "overnight_layover_range": "lay >= 120 AND lay <= 600"},
    ),
)
def layover_rules(t):
    """Both ranges on connections of a window wider than either."""
    edges = conn.build_connections(t.legs, min_layover=20, max_layover=700)
    rules = {
        "layover_range": quality.layover_range("layover_minutes"),
        "overnight_layover_range": quality.overnight_layover_range("layover_minutes"),
    }
    return quality.quality_report(edges, rules)


@query(
    "airport_reference_rows",
    _report_sql(
        "", "supplier", {"airport_row": "s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0"}
    ),
)
def airport_reference_rows(t):
    """Suppliers as airports: some codes too long, some names too short, some cities blank."""
    key = F.col("s_suppkey")
    codes = F.array(*[F.lit(c) for c in STATIONS])
    code = F.element_at(codes, F.col("s_nationkey") + 1)
    rows = t.spark.read.parquet(f"{t.sf_dir}/supplier.parquet").select(
        F.when(key % 5 == 0, F.concat(code, F.lit("X"))).otherwise(code).alias("code"),
        F.when(key % 7 == 0, F.lit(" Field ")).otherwise(F.col("s_name")).alias("name"),
        F.when(key % 11 == 0, F.lit("  ")).otherwise(F.col("s_name")).alias("city"),
        code.alias("state"),
        code.alias("country"),
    )
    return quality.quality_report(rows, {"airport_row": quality.airport_row()})


@query(
    "airline_reference_rows",
    _report_sql(
        "", "customer", {"airline_row": "c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0"}
    ),
)
def airline_reference_rows(t):
    """Customers as airlines: some codes in lower case, some names too short, some countries unknown."""
    key, code = F.col("c_custkey"), F.substring("c_mktsegment", 1, 2)
    rows = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet").select(
        F.when(key % 5 == 0, F.lower(code)).otherwise(F.upper(code)).alias("code"),
        F.when(key % 7 == 0, F.lit("Air")).otherwise(F.col("c_name")).alias("name"),
        F.when(key % 11 != 0, F.col("c_mktsegment")).alias("country"),
    )
    return quality.quality_report(rows, {"airline_row": quality.airline_row()})


@query(
    "served_requests",
    f"""WITH {REQUESTS} SELECT request_id, CASE
      WHEN error IN ('origin', 'dest', 'same_airport', 'date', 'depart_after', 'arrive_before') THEN error
      WHEN request_id * 3 % 130 < 1 THEN 'limit' WHEN request_id % 6 < min_stops THEN 'stops'
      WHEN request_id % 6 > 3 THEN 'max_stops_cap' WHEN request_id * 3 % 130 > 100 THEN 'limit_cap' END AS error FROM normal""",
)
def served_requests(t):
    """Requests that ask for more stops or answers than are served are refused."""
    e = F.col("request_id")
    asked = t.raw_requests.withColumns({"max_stops": F.pmod(e, F.lit(6)), "limit": F.pmod(e * 3, F.lit(130))})
    return normalise_requests(asked, served=True).select("request_id", "error")


FLOORS = {"legs": 100_000, "airports": 26, "routes": 500, "carriers": 3, "connections": 50_000}


@query(
    "below_floors",
    f"""WITH {EDGES}, n AS (
      SELECT 'legs' AS entity, count(*) AS n FROM loaded
      UNION ALL SELECT 'airports', count(*) FROM (SELECT o FROM loaded UNION SELECT d FROM loaded)
      UNION ALL SELECT 'routes', count(*) FROM (SELECT DISTINCT o, d FROM loaded)
      UNION ALL SELECT 'carriers', count(DISTINCT car) FROM loaded
      UNION ALL SELECT 'connections', count(*) FROM edge),
    wanted(entity, least) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in FLOORS.items())})
    SELECT entity, n, CAST(least AS BIGINT) AS floor FROM n JOIN wanted USING (entity) WHERE n < least""",
)
def below_floors(t):
    return rollups.below_floors(rollups.entity_counts(t.loaded, t.routes, t.connections), FLOORS)


@query(
    "rebuilt_dates",
    f"""WITH {EDGES} SELECT {day()} AS flightdate, count(*) AS connections FROM edge
    WHERE dd <> 2 AND (dd <> 1 OR fc = tc) GROUP BY dd""",
)
def rebuilt_dates(t):
    """The second date is built again under the strict rule, the third comes out empty."""
    path = f"{shared_root(t.spark)}/skyloom/{t.spark.sparkContext.applicationId}/rebuilt-{uuid.uuid4().hex[:12]}"
    replace_dates(t.connections, path)
    again = conn.build_connections(t.legs.filter(F.col("flightdate") == _date(1)), strict_carrier=True)
    replace_dates(again, path, ["2025-07-15", "2025-07-16"])
    return conn.connections_per_date(t.spark.read.parquet(path))


@query(
    "unsolvable_dates",
    f"""WITH {LEGS}, timed AS (SELECT dd, o, d FROM loaded WHERE blk IS NOT NULL),
    found AS (
      SELECT dd, 'conflict' AS issue, '' AS detail FROM timed WHERE dd = 1 AND o = 'SEA' AND d = 'MIA'
      UNION SELECT dd, 'not_whole_hour', 'MIA' FROM timed WHERE dd = 2 AND 'MIA' IN (o, d)
      UNION SELECT dd, 'disconnected', unnest([o, d]) FROM timed
        WHERE dd = 3 AND o IN ('HNL', 'GUM') AND d IN ('HNL', 'GUM')
      UNION SELECT dd, 'no_anchor', 'PHX' FROM timed WHERE dd = 5
      UNION SELECT dd, 'no_pairs', '' FROM loaded WHERE dd = 6)
    SELECT {day()} AS flightdate, issue, detail FROM found""",
)
def unsolvable_dates(t):
    """Legs with a fault of another kind on each of five dates; a conflict may be laid to any
    pair of its cycle, so its pair isn't shown."""
    on = lambda weekday: F.col("flightdate") == _date(weekday)
    far = lambda end: F.col(end).isin("HNL", "GUM")
    block = F.col("scheduled_duration_minutes")
    faulty = (
        F.when(on(1) & (F.col("origin") == "SEA") & (F.col("dest") == "MIA"), block - 60)
        .when(on(2) & (F.col("dest") == "MIA"), block - 30)
        .when(on(2) & (F.col("origin") == "MIA"), block + 30)
        .when(~on(6), block)
    )
    cut = (on(3) & (far("origin") != far("dest"))) | (on(5) & ((F.col("origin") == "PHX") | (F.col("dest") == "PHX")))
    legs = t.loaded.filter(~cut).withColumn("scheduled_duration_minutes", faulty)
    issues = offsets.solve_offsets(offsets.offset_deltas(legs), dates=t.dates).issues
    conflict = F.col("issue") == "conflict"
    return issues.withColumn("detail", F.when(conflict, "").otherwise(F.col("detail"))).distinct()


@query(
    "planted_edge_faults",
    f"""WITH {EDGES} SELECT count(*) AS edges, count(*) FILTER (lay % 11 = 0) AS hub_mismatch,
    count(*) FILTER (lay % 7 = 0) AS outside_window,
    count(*) FILTER (lay % 7 = 0 OR lay % 11 = 0) AS wrong_layover FROM edge""",
)
def planted_edge_faults(t):
    """Some connections get a layover outside the window, others name their first leg twice."""
    wait = F.col("layover_minutes")
    faulty = t.connections.withColumns(
        {
            "to_leg": F.when(wait % 11 == 0, F.col("from_leg")).otherwise(F.col("to_leg")),
            "layover_minutes": F.when(wait % 7 == 0, wait + 1000).otherwise(wait),
        }
    )
    return conn.connection_invariants(faulty, t.legs).drop("backtrack")


@query(
    "planted_itinerary_faults",
    f"""WITH x AS ({itineraries_sql(2, "p.stops >= 1 AND p.arr_l < a.dd * 1440 + 900")})
    SELECT count(*) AS itineraries, count(*) FILTER (total_minutes IS NOT NULL) AS wrong_total,
    count(*) FILTER (stops = 1 AND total_minutes IS NOT NULL) AS wrong_span,
    count(*) FILTER (stops = 2) AS cyclic, count(*) FILTER (stops = 1) AS mixed_family,
    count(*) FILTER (stops = 2) AS wrong_stops, count(*) FILTER (stops = 2) AS outside_window FROM x""",
)
def planted_itinerary_faults(t):
    """One-stop answers get a wrong total and a foreign carrier; two-stop answers lead back to
    their start, wait too long and miscount their stops."""
    one, two = F.col("stops") == 1, F.col("stops") == 2
    found = t.answers(min_stops=1, max_stops=2, arrive_before="15:00")
    faulty = found.withColumns(
        {
            "total_minutes": F.when(one, F.col("total_minutes") + 7).otherwise(F.col("total_minutes")),
            "carriers": F.when(one, F.array_append("carriers", F.lit("ZZ"))).otherwise(F.col("carriers")),
            "route": F.when(two, F.array_append("route", F.get("route", F.lit(0)))).otherwise(F.col("route")),
            "layover_minutes": F.when(two, F.array_append("layover_minutes", F.lit(400))).otherwise(
                F.col("layover_minutes")
            ),
            "stops": F.when(two, F.lit(3)).otherwise(F.col("stops")),
        }
    )
    return srch.itinerary_audit(faulty).drop("unsorted")


@query(
    "months_of_files",
    f"""WITH {MONTHS} SELECT substr(flightdate, 1, 7) AS month, count(*) AS flights FROM typed GROUP BY 1""",
)
def months_of_files(t):
    """Two months, and the rows whose date did not convert."""
    return scan.month_breakdown(records.read_records_csv(t.spark, t.month_files))

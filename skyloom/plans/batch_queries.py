"""Lookups over a whole table of requests, each the batch form of a lookup of one pair."""

from pyspark.sql import functions as F

from skyloom.operators import layovers, legs, network
from skyloom.plans.registry import query
from skyloom.plans.search_queries import POOL
from skyloom.plans.sql import EDGES, day, ts

ASKED = f"""{EDGES}, {POOL},
r AS (SELECT o || '-' || d || '-' || {day()} AS request_id, o, d, dd FROM ask)"""


def _requests(t):
    return t.workload().withColumn("flightdate", F.col("date").cast("date"))


@query(
    "direct_flights_of_requests",
    f"""WITH {ASKED} SELECT request_id, flight, {ts("dep_l")} AS departs, {ts("arr_l")} AS arrives,
    CAST(blk AS BIGINT) AS minutes FROM r JOIN leg USING (dd, o, d)""",
)
def direct_flights_of_requests(t):
    return legs.direct_flights_of(t.legs, _requests(t))


@query(
    "one_stop_of_requests",
    f"""WITH {ASKED}, met AS (
      SELECT request_id, a.flight || '>' || b.flight AS flights, a.d AS via, {ts("a.dep_l")} AS departs,
        {ts("b.arr_l")} AS arrives, CAST(b.dep_l - a.arr_l AS BIGINT) AS layover,
        CAST(a.blk + b.blk AS BIGINT) AS air_minutes,
        row_number() OVER (PARTITION BY request_id ORDER BY a.dep_l, a.flight, b.flight) AS rank
      FROM r JOIN leg a ON a.dd = r.dd AND a.o = r.o AND a.d <> r.d
      JOIN leg b ON b.o = a.d AND b.car = a.car AND b.d = r.d AND b.o <> r.o AND b.dd IN (r.dd, r.dd + 1)
      WHERE b.dep_l - a.arr_l BETWEEN 45 AND 300)
    SELECT * FROM met WHERE rank <= 10""",
)
def one_stop_of_requests(t):
    return layovers.one_stop_of(t.legs, _requests(t))


@query(
    "acyclic_routes_of_pairs",
    f"""WITH {ASKED}, e AS (SELECT DISTINCT o, d FROM loaded), pair AS (SELECT DISTINCT o, d FROM r),
    p1 AS (SELECT o, d AS at, [o, d] AS route FROM e),
    p2 AS (SELECT p.o, e.d AS at, list_append(route, e.d) AS route FROM p1 p JOIN e ON e.o = p.at
           WHERE NOT list_contains(route, e.d)),
    p3 AS (SELECT p.o, e.d AS at, list_append(route, e.d) AS route FROM p2 p JOIN e ON e.o = p.at
           WHERE NOT list_contains(route, e.d)),
    p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
    ranked AS (SELECT pair.o AS origin, pair.d AS dest, array_to_string(route, '>') AS route, len(route) - 1 AS legs,
      row_number() OVER (PARTITION BY pair.o, pair.d ORDER BY len(route), array_to_string(route, '>')) AS rank
      FROM pair JOIN p ON p.o = pair.o AND p.at = pair.d)
    SELECT * FROM ranked WHERE rank <= 10""",
)
def acyclic_routes_of_pairs(t):
    return network.acyclic_routes_of(t.routes, t.workload())

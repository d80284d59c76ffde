"""Itinerary search over whole request tables, and checks of its answers."""

from pyspark.sql import functions as F

from skyloom.operators import requests as req
from skyloom.operators import search as srch
from skyloom.plans.registry import query
from skyloom.plans.sql import EDGES, ITINERARY_COLUMNS, LEGS, day, path_ctes, ts
from skyloom.sources.order_records import STATIONS

POOL = f"""pool AS (SELECT o AS code FROM loaded GROUP BY o ORDER BY count(*) DESC, o LIMIT 60),
built AS (SELECT DISTINCT dd FROM edge),
ask AS (SELECT a.code AS o, b.code AS d, dd FROM pool a, pool b, built WHERE a.code <> b.code)"""

RANK = "row_number() OVER (PARTITION BY a.o, a.d, a.dd ORDER BY p.air + p.waits NULLS LAST, p.dep_u NULLS LAST, p.ids, p.route)"


def itineraries_sql(max_stops: int, where: str = "true", rank: str = RANK, limit: int = 20) -> str:
    return f"""WITH {path_ctes(max_stops)}, {POOL},
    hit AS (SELECT a.o || '-' || a.d || '-' || {day("a.dd")} AS request_id, p.*, {rank} AS rank
            FROM ask a JOIN path p ON p.dd = a.dd AND p.start = a.o AND p.at = a.d WHERE {where})
    SELECT request_id, rank, {ITINERARY_COLUMNS} FROM hit WHERE rank <= {limit}"""


def _answers(df):
    return df.filter(F.col("rank").isNotNull()).drop("status", "error", "searchable")


@query("itinerary_search", itineraries_sql(2))
def itinerary_search(t):
    """All pairs of the busiest origins on all dates, up to two stops, best twenty each."""
    return _answers(t.answers(max_stops=2))


@query(
    "itineraries_0_2",
    f"""WITH {path_ctes(2)} SELECT {day()} AS flightdate, path.start AS origin, path.at AS dest, stops,
    count(*) AS itineraries, CAST(min(air + waits) AS BIGINT) AS best_minutes
    FROM path GROUP BY dd, path.start, path.at, stops""",
)
def itineraries_0_2(t):
    """How many itineraries of each depth every pair has on every date."""
    return srch.itinerary_counts(t.legs, t.connections, 2)


@query("itineraries_0_1", itineraries_sql(1))
def itineraries_0_1(t):
    return _answers(t.answers(max_stops=1))


@query("itineraries_0_3", itineraries_sql(3))
def itineraries_0_3(t):
    return _answers(t.answers(max_stops=3))


@query("itineraries_nonstop", itineraries_sql(0))
def itineraries_nonstop(t):
    return _answers(t.answers(max_stops=0))


@query("itineraries_depart_after", itineraries_sql(2, "p.dep_l >= a.dd * 1440 + 480"))
def itineraries_depart_after(t):
    return _answers(t.answers(max_stops=2, depart_after="08:00"))


@query("itineraries_deadline", itineraries_sql(2, "p.stops >= 1 AND p.arr_l < a.dd * 1440 + 900"))
def itineraries_deadline(t):
    return _answers(t.answers(min_stops=1, max_stops=2, arrive_before="15:00"))


@query(
    "itineraries_by_arrival",
    f"""WITH x AS ({itineraries_sql(2, "p.stops >= 1 AND p.arr_l < a.dd * 1440 + 900")})
    SELECT * REPLACE (row_number() OVER (PARTITION BY request_id ORDER BY arrives_utc NULLS LAST, flights) AS rank)
    FROM x""",
)
def itineraries_by_arrival(t):
    return srch.by_arrival(_answers(t.answers(min_stops=1, max_stops=2, arrive_before="15:00")))


@query(
    "itineraries_by_stops",
    f"""WITH x AS ({itineraries_sql(2)})
    SELECT * REPLACE (row_number() OVER (PARTITION BY request_id ORDER BY stops, total_minutes NULLS LAST, flights)
      AS rank) FROM x""",
)
def itineraries_by_stops(t):
    return srch.by_stops(_answers(t.answers(max_stops=2)))


@query(
    "itinerary_audit",
    f"""WITH x AS ({itineraries_sql(2)}) SELECT count(*) AS itineraries, 0 AS unsorted, 0 AS wrong_total,
    0 AS wrong_span, 0 AS cyclic, 0 AS mixed_family, 0 AS wrong_stops, 0 AS outside_window FROM x""",
)
def itinerary_audit(t):
    return srch.itinerary_audit(t.answers(max_stops=2))


@query(
    "request_workload",
    f"""WITH {EDGES}, {POOL} SELECT o || '-' || d || '-' || {day()} AS request_id, o AS origin, d AS dest,
    {day()} AS date FROM ask""",
)
def request_workload(t):
    return t.workload()


@query(
    "request_sample",
    f"""WITH {EDGES}, {POOL}, r AS (
      SELECT o || '-' || d || '-' || {day()} AS request_id, o AS origin, d AS dest, {day()} AS date FROM ask)
    SELECT * FROM r ORDER BY md5(request_id || '#42'), request_id LIMIT 40""",
)
def request_sample(t):
    return t.workload(sample=40, seed=42)


@query(
    "busiest_origins",
    f"""WITH {LEGS} SELECT o AS code, count(*) AS flights FROM loaded WHERE dd = 0 GROUP BY o
    ORDER BY flights DESC, code LIMIT 60""",
)
def busiest_origins(t):
    return req.busiest_origins(t.loaded, "2025-07-14")


_stations = ", ".join(f"'{c}'" for c in STATIONS)
REQUESTS = f"""
raw AS (
  SELECT event_id AS request_id, event_id % 16 AS k, event_id AS e,
         ([{_stations}])[CAST(user_id % 25 + 1 AS INTEGER)] AS o0,
         ([{_stations}])[CAST((event_id * 7) % 25 + 1 AS INTEGER)] AS d0 FROM events),
typed AS (
  SELECT request_id, k,
    CASE WHEN k = 1 THEN ' ' || lower(o0) || '  ' WHEN k = 2 THEN 'LG1' WHEN k = 3 THEN '  ' ELSE o0 END AS o_text,
    CASE WHEN k = 4 THEN '12' WHEN k = 5 THEN NULL ELSE d0 END AS d_text,
    CASE WHEN k IN (6, 7) THEN NULL WHEN k = 8 THEN 4 ELSE e % 9 END AS dd,
    CAST(e % 3 AS INTEGER) AS max_stops, CASE WHEN e % 11 = 0 THEN 1 ELSE 0 END AS min_stops,
    CASE WHEN e % 29 = 0 THEN 0 ELSE 1 + e % 5 END AS lim FROM raw),
normal0 AS (
  SELECT *, CASE WHEN regexp_full_match(upper(trim(o_text)), '[A-Z]{{3}}') THEN upper(trim(o_text)) END AS o,
    CASE WHEN regexp_full_match(upper(trim(d_text)), '[A-Z]{{3}}') THEN upper(trim(d_text)) END AS d,
    CASE WHEN k = 11 THEN dd * 1440 + 545 WHEN k = 12 THEN 4 * 1440 + 480 END AS after,
    CASE WHEN k = 14 THEN dd * 1440 + 900 WHEN k = 15 THEN 5 * 1440 + 90 END AS before FROM typed),
normal AS (
  SELECT *, CASE WHEN o IS NULL THEN 'origin' WHEN d IS NULL THEN 'dest' WHEN o = d THEN 'same_airport'
    WHEN dd IS NULL THEN 'date' WHEN k IN (9, 10, 13) THEN 'depart_after' WHEN k = 8 THEN 'arrive_before'
    WHEN lim < 1 THEN 'limit' WHEN max_stops < min_stops THEN 'stops' END AS error FROM normal0)"""


@query(
    "request_normalisation",
    f"""WITH {REQUESTS} SELECT request_id, o AS origin, d AS dest, {day()} AS flightdate, {ts("after")} AS depart_after,
    {ts("before")} AS arrive_before, CAST(min_stops AS BIGINT) AS min_stops, CAST(max_stops AS BIGINT) AS max_stops,
    CAST(lim AS BIGINT) AS "limit", error FROM normal""",
)
def request_normalisation(t):
    return req.normalise_requests(t.raw_requests)


@query(
    "search_status",
    f"""WITH {path_ctes(2)}, {REQUESTS}, built AS (SELECT DISTINCT dd FROM edge),
    asked AS (SELECT n.*, b.dd IS NOT NULL AS searchable,
      CASE WHEN error IS NOT NULL THEN 'bad_request' WHEN max_stops > 0 AND b.dd IS NULL THEN 'not_built'
           ELSE 'ok' END AS st FROM normal n LEFT JOIN built b ON n.dd = b.dd),
    hit AS (SELECT a.request_id, p.air + p.waits AS total,
      row_number() OVER (PARTITION BY a.request_id ORDER BY p.air + p.waits NULLS LAST, p.dep_u NULLS LAST, p.ids, p.route)
        AS rank, a.lim
      FROM asked a JOIN path p ON a.st = 'ok' AND p.dd = a.dd AND p.start = a.o AND p.at = a.d
       AND p.stops BETWEEN a.min_stops AND a.max_stops AND (a.after IS NULL OR p.dep_l >= a.after)
       AND (a.before IS NULL OR p.arr_l < a.before)),
    best AS (SELECT request_id, count(*) AS n, CAST(sum(total) AS BIGINT) AS minutes FROM hit WHERE rank <= lim
             GROUP BY request_id)
    SELECT a.request_id, CASE WHEN st = 'ok' AND n IS NULL THEN 'empty' ELSE st END AS status, error, searchable,
           coalesce(n, 0) AS itineraries, minutes
    FROM asked a LEFT JOIN best b ON a.request_id = b.request_id""",
)
def search_status(t):
    """Badly formed, refused, empty and answered requests, one row each."""
    found = srch.search(t.raw_requests, t.legs, t.connections)
    return found.groupBy("request_id", "status", "error", "searchable").agg(
        F.count("rank").alias("itineraries"), F.sum("total_minutes").alias("minutes")
    )


def _chains_sql(max_stops: int) -> str:
    out = f"""{EDGES}, c0 AS (SELECT dd, o AS start, lid AS last, o || '>' || d AS route FROM leg)"""
    for k in range(1, max_stops + 1):
        out += f""", c{k} AS (SELECT c.dd, c.start, e.t AS last, c.route || '>' || e.td AS route
        FROM c{k - 1} c JOIN edge e ON c.dd = e.dd AND c.last = e.f)"""
    return out


def _census_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT {day()} AS flightdate, {k} AS stops, count(*) AS chains,
        count(*) FILTER (len(string_split(route, '>')) <> len(list_distinct(string_split(route, '>')))) AS cyclic,
        count(*) FILTER (position(start IN substr(route, 4)) > 0) AS back_to_origin FROM c{k} GROUP BY dd"""
        for k in range(4)
    )
    return f"WITH {_chains_sql(3)} {parts}"


@query("cyclic_paths", _census_sql())
def cyclic_paths(t):
    return srch.cyclic_census(t.legs, t.connections, 3)


@query(
    "chain_check",
    f"""WITH {_chains_sql(3)} SELECT 1 AS stops, count(*) AS chains, 0 AS broken FROM c1
    UNION ALL SELECT 2, count(*), 0 FROM c2 UNION ALL SELECT 3, count(*), 0 FROM c3""",
)
def chain_check(t):
    return srch.chain_check(t.legs, t.connections, 3)

"""The route network and the reports over request logs."""

from pyspark.sql import functions as F

from skyloom.operators import network, reports
from skyloom.plans.registry import query
from skyloom.plans.sql import EDGES, ROUTES, day

THICK = 100


@query(
    "routes",
    f"""WITH {ROUTES} SELECT o AS origin, d AS dest, flights, carriers, {day("d0")} AS first_date,
    {day("d1")} AS last_date FROM route""",
)
def routes(t):
    return network.routes(t.loaded, t.airports)


@query("route_uniqueness", f"WITH {ROUTES} SELECT count(*) AS edges, count(*) AS distinct_pairs FROM route")
def route_uniqueness(t):
    return network.route_uniqueness(t.routes)


def _reach_sql(where: str, k: int) -> str:
    within = ", ".join(f"count(*) FILTER (legs <= {i}) AS within_{i}" for i in range(1, k + 1))
    return f"""WITH RECURSIVE {ROUTES}, net AS (SELECT o, d FROM route WHERE {where}),
    walk(start, here, legs) AS (
      SELECT o, d, 1 FROM net UNION SELECT w.start, n.d, w.legs + 1 FROM walk w JOIN net n ON w.here = n.o
      WHERE w.legs < {k}),
    near AS (SELECT start, here, min(legs) AS legs FROM walk GROUP BY start, here)
    SELECT start AS origin, {within} FROM near GROUP BY start"""


@query("reach_k", _reach_sql("true", 3))
def reach_k(t):
    return network.reach_counts(t.routes, 3)


@query("reach_thick", _reach_sql(f"flights >= {THICK}", 3))
def reach_thick(t):
    return network.reach_counts(t.routes, 3, min_flights=THICK)


@query(
    "fewest_legs",
    f"""WITH RECURSIVE {ROUTES}, net AS (SELECT o, d FROM route WHERE flights >= {THICK}),
    walk(start, here, legs) AS (
      SELECT o, d, 1 FROM net UNION SELECT w.start, n.d, w.legs + 1 FROM walk w JOIN net n ON w.here = n.o
      WHERE w.legs < 24),
    near AS (SELECT start, here, min(legs) AS legs FROM walk WHERE start <> here GROUP BY start, here),
    step AS (SELECT a.start, a.here AS via, b.here, b.legs FROM near a JOIN near b ON a.start = b.start
             AND b.legs = a.legs + 1 JOIN net n ON n.o = a.here AND n.d = b.here),
    trace(start, here, legs, route) AS (
      SELECT start, here, legs, start || '>' || here FROM near WHERE legs = 1
      UNION ALL SELECT s.start, s.here, s.legs, t.route || '>' || s.here FROM trace t
      JOIN step s ON s.start = t.start AND s.via = t.here AND s.legs = t.legs + 1)
    SELECT start AS origin, here AS dest, legs, min(route) AS route FROM trace GROUP BY start, here, legs""",
)
def fewest_legs(t):
    return network.fewest_legs(t.routes, min_flights=THICK)


PATHS = f"""{ROUTES},
w1 AS (SELECT d AS here, [o, d] AS route, [o || '>' || d] AS used FROM route WHERE o = 'LGA'),
w2 AS (SELECT r.d AS here, list_append(w.route, r.d) AS route, list_append(w.used, r.o || '>' || r.d) AS used
       FROM w1 w JOIN route r ON w.here = r.o),
w3 AS (SELECT r.d AS here, list_append(w.route, r.d) AS route, list_append(w.used, r.o || '>' || r.d) AS used
       FROM w2 w JOIN route r ON w.here = r.o WHERE r.d = 'DFW'),
w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3),
hit AS (SELECT route, used, len(used) AS legs, len(used) = len(list_distinct(used)) AS trail,
               len(route) = len(list_distinct(route)) AS acyclic FROM w WHERE here = 'DFW')"""


@query(
    "acyclic_routes",
    f"""WITH {PATHS} SELECT array_to_string(route, '>') AS route, legs FROM hit WHERE acyclic
    ORDER BY legs, array_to_string(route, '>') LIMIT 10""",
)
def acyclic_routes(t):
    return network.acyclic_routes(t.routes, "LGA", "DFW", 3)


@query("trail_paths", f"WITH {PATHS} SELECT array_to_string(route, '>') AS route, legs FROM hit WHERE trail")
def trail_paths(t):
    return network.trail_paths(t.routes, "LGA", "DFW", 3)


@query(
    "path_modes",
    f"""WITH {PATHS} SELECT 'walk' AS mode, legs, count(*) AS paths FROM hit GROUP BY legs
    UNION ALL SELECT 'trail', legs, count(*) FROM hit WHERE trail GROUP BY legs
    UNION ALL SELECT 'acyclic', legs, count(*) FROM hit WHERE acyclic GROUP BY legs""",
)
def path_modes(t):
    return network.path_modes(t.routes, "LGA", "DFW", 3)


@query(
    "hub_overstatement",
    f"""WITH {EDGES}, r AS (SELECT DISTINCT o, d FROM loaded),
    claim AS (SELECT a.o, b.d, count(*) AS n FROM r a JOIN r b ON a.d = b.o AND a.o <> b.d GROUP BY a.o, b.d),
    timed AS (SELECT fo, td, count(DISTINCT hub) AS n FROM edge WHERE fc = tc GROUP BY fo, td)
    SELECT c.o AS origin, c.d AS dest, c.n AS claimed_hubs, coalesce(t.n, 0) AS timed_hubs
    FROM claim c LEFT JOIN timed t ON c.o = t.fo AND c.d = t.td""",
)
def hub_overstatement(t):
    return network.hub_overstatement(t.routes, t.connections)


LOG = """log AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'nonstop lookup' ELSE 'itinerary search {0,2}' END AS name,
  value, event_type = 'error' AS failed, ts, event_type AS kind FROM events WHERE event_id % 50 <> 0),
roll AS (
  SELECT name, count(*) AS requests, count(*) FILTER (failed) AS failures,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / count(value) AS mean_ms,
    quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99,
    CAST(count(*) AS DOUBLE) / (SELECT date_sub('second', min(ts), max(ts)) FROM log) AS rps
  FROM log GROUP BY name)"""


def _e4(column, name):
    """Ten-thousandths as a whole number: the exact digits of an interpolated percentile."""
    return F.round(F.col(column) * 10000).cast("bigint").alias(name)


@query(
    "request_rollup",
    f"""WITH {LOG} SELECT name, requests, failures, CAST(round(mean_ms * 10000) AS BIGINT) AS mean_e4,
    CAST(round(p95 * 10000) AS BIGINT) AS p95_e4, CAST(round(p99 * 10000) AS BIGINT) AS p99_e4,
    CAST(failures AS DOUBLE) / requests * 100 AS failure_pct, rps AS requests_per_s FROM roll""",
)
def request_rollup(t):
    rollup = reports.request_rollup(t.request_log)
    return rollup.select(
        "name",
        "requests",
        "failures",
        _e4("mean_ms", "mean_e4"),
        _e4("p95_ms", "p95_e4"),
        _e4("p99_ms", "p99_e4"),
        "failure_pct",
        "requests_per_s",
    )


@query(
    "run_summary",
    f"""WITH {LOG}, s AS (SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(failures) AS BIGINT) AS failures,
      avg(mean_ms) AS mean, arg_max(name, mean_ms) AS slowest FROM roll),
    g AS (SELECT *, CAST(failures AS DOUBLE) / requests * 100 AS pct FROM s)
    SELECT requests, failures, CAST(round(mean * 10000) AS BIGINT) AS mean_e4, slowest,
      CASE WHEN pct < 1 THEN 'EXCELLENT' WHEN pct < 5 THEN 'ACCEPTABLE' ELSE 'POOR' END AS failure_grade,
      CASE WHEN mean < 200 THEN 'EXCELLENT' WHEN mean < 500 THEN 'ACCEPTABLE' ELSE 'POOR' END AS response_grade,
      mean > 300 AS check_queries, pct > 2 AS check_errors FROM g""",
)
def run_summary(t):
    summary = reports.run_summary(reports.request_rollup(t.request_log))
    return summary.select(
        "requests",
        "failures",
        _e4("mean_ms", "mean_e4"),
        "slowest",
        "failure_grade",
        "response_grade",
        "check_queries",
        "check_errors",
    )


@query(
    "latency_percentiles",
    f"""WITH {LOG} SELECT name, kind, count(*) AS samples, count(*) FILTER (value > 200) AS over_budget,
    CAST(round(quantile_cont(value, 0.5) * 10000) AS BIGINT) AS p50_e4,
    CAST(round(quantile_cont(value, 0.95) * 10000) AS BIGINT) AS p95_e4 FROM log GROUP BY name, kind""",
)
def latency_percentiles(t):
    log = t.request_log.filter(~F.col("name").isin(*reports.SUMMARY_ROWS))
    found = reports.latency_percentiles(log, ["name", "kind"])
    return found.select(
        "name", "kind", "samples", "over_budget", _e4("p50_ms", "p50_e4"), _e4("p95_ms", "p95_e4")
    )

"""Connections, their audits, and two-leg questions on local clocks."""

from pyspark.sql import functions as F

from skyloom.operators import connections as conn
from skyloom.operators import layovers, network, rollups
from skyloom.plans.registry import query
from skyloom.plans.sql import EDGES, LEGS, day, fam, ts

EDGE_COLUMNS = f"""{day()} AS flightdate, f AS from_leg, t AS to_leg, hub, CAST(lay AS BIGINT) AS layover_minutes"""

PAIRS = f"""{LEGS},
met AS (
  SELECT a.dd, a.d AS hub, a.arr_l AS lands, b.dep_l AS leaves
  FROM leg a JOIN leg b ON a.dd = b.dd AND a.d = b.o AND b.d <> a.o)"""


@query("connections", f"WITH {EDGES} SELECT {EDGE_COLUMNS} FROM edge")
def connections(t):
    edges = conn.build_connections(t.legs)
    return edges.select("flightdate", "from_leg", "to_leg", "hub", "layover_minutes")


@query("connections_strict", f"WITH {EDGES} SELECT {EDGE_COLUMNS} FROM edge WHERE fc = tc")
def connections_strict(t):
    return t.strict_connections.select("flightdate", "from_leg", "to_leg", "hub", "layover_minutes")


@query(
    "connections_window",
    f"""WITH {LEGS} SELECT {day("a.dd")} AS flightdate, a.d AS hub, count(*) AS connections,
    CAST(sum(b.dep_u - a.arr_u) AS BIGINT) AS minutes
    FROM leg a JOIN leg b ON a.dd = b.dd AND a.d = b.o AND a.fam = b.fam AND b.d <> a.o
     AND b.dep_u - a.arr_u BETWEEN 30 AND 90 GROUP BY a.dd, a.d""",
)
def connections_window(t):
    edges = conn.build_connections(t.legs, min_layover=30, max_layover=90)
    return edges.groupBy("flightdate", "hub").agg(
        F.count("*").alias("connections"), F.sum("layover_minutes").alias("minutes")
    )


@query("connections_per_date", f"WITH {EDGES} SELECT {day()} AS flightdate, count(*) AS connections FROM edge GROUP BY dd")
def connections_per_date(t):
    return conn.connections_per_date(t.connections)


@query("searchable_dates", f"WITH {EDGES} SELECT DISTINCT {day()} AS flightdate FROM edge")
def searchable_dates(t):
    return conn.searchable_dates(t.built)


@query("readiness", f"WITH {EDGES} SELECT count(*) AS connections, count(*) > 0 AS ready FROM edge")
def readiness(t):
    return conn.readiness(t.connections)


@query(
    "connection_invariants",
    f"""WITH {EDGES} SELECT count(*) AS edges, 0 AS hub_mismatch, 0 AS backtrack, 0 AS outside_window,
    0 AS wrong_layover FROM edge""",
)
def connection_invariants(t):
    return conn.connection_invariants(t.connections, t.legs)


@query(
    "carrier_edge_audit",
    f"""WITH {EDGES} SELECT count(*) AS edges, count(*) FILTER (fc <> tc) AS cross_family,
    count(*) FILTER (({fam("fc")}) <> ({fam("tc")})) AS mismatched FROM edge""",
)
def carrier_edge_audit(t):
    return conn.carrier_edge_audit(t.connections)


@query(
    "ambiguous_carrier_share",
    f"""WITH {EDGES} SELECT fc AS carrier, count(*) AS edges, (SELECT count(*) FROM edge) AS all_edges,
    CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM edge) AS share
    FROM edge WHERE fc = tc AND fc IN ('OO', 'YX') GROUP BY fc""",
)
def ambiguous_carrier_share(t):
    return conn.ambiguous_carrier_share(t.connections)


@query(
    "connecting_hubs",
    f"""WITH {EDGES} SELECT hub, count(*) AS connections,
    CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM edge) AS share
    FROM edge GROUP BY hub ORDER BY connections DESC, hub LIMIT 10""",
)
def connecting_hubs(t):
    return rollups.connecting_hubs(t.connections)


@query(
    "unexpected_hubs",
    f"""WITH {EDGES}, top AS (SELECT hub, count(*) AS connections FROM edge GROUP BY hub
      ORDER BY connections DESC, hub LIMIT 10)
    SELECT hub, connections FROM top WHERE hub NOT IN
      (SELECT o FROM loaded GROUP BY o ORDER BY count(*) DESC, o LIMIT 10)""",
)
def unexpected_hubs(t):
    """Top connecting airports that are not among the ten busiest."""
    from skyloom.operators.requests import busiest_origins

    top = rollups.connecting_hubs(t.connections).select("hub", "connections")
    return rollups.unexpected_hubs(top, busiest_origins(t.loaded, top=10))


@query(
    "carrier_hubs",
    f"""WITH {EDGES}, c AS (SELECT fc AS carrier, hub, count(*) AS connections FROM edge GROUP BY fc, hub)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY connections DESC, hub) AS rank
    FROM c) WHERE rank <= 4""",
)
def carrier_hubs(t):
    return rollups.carrier_hubs(t.connections)


@query(
    "thin_hubs",
    f"""WITH {EDGES}, h AS (SELECT hub, count(*) AS n FROM edge GROUP BY hub)
    SELECT count(*) AS hubs, count(*) FILTER (n < 3000) AS thin_hubs,
    CAST(coalesce(sum(n) FILTER (n < 3000), 0) AS BIGINT) AS thin_connections, CAST(sum(n) AS BIGINT) AS connections,
    CAST(coalesce(sum(n) FILTER (n < 3000), 0) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS share FROM h""",
)
def thin_hubs(t):
    return rollups.thin_hubs(t.connections, below=3000)


@query(
    "one_stop",
    f"""WITH {LEGS} SELECT a.flight || '>' || b.flight AS flights, a.d AS via, {ts("a.dep_l")} AS departs,
    {ts("b.arr_l")} AS arrives, CAST(b.dep_l - a.arr_l AS BIGINT) AS layover,
    CAST(a.blk + b.blk AS BIGINT) AS air_minutes
    FROM leg a JOIN leg b ON a.d = b.o AND a.car = b.car AND b.dd IN (4, 5)
    WHERE a.dd = 4 AND a.o = 'LGA' AND b.d = 'DFW' AND a.d <> 'DFW' AND b.o <> 'LGA'
      AND b.dep_l - a.arr_l BETWEEN 45 AND 300
    ORDER BY a.dep_l, a.flight, b.flight LIMIT 10""",
)
def one_stop(t):
    return layovers.one_stop(t.legs, "LGA", "DFW", "2025-07-18")


@query(
    "hub_connections",
    f"""WITH {PAIRS} SELECT {day()} AS flightdate, hub, count(*) AS pairs FROM met
    WHERE leaves - lands BETWEEN 45 AND 300 GROUP BY dd, hub""",
)
def hub_connections(t):
    return layovers.hub_connections(t.legs)


@query(
    "negative_layovers",
    f"""WITH {PAIRS} SELECT {day()} AS flightdate, count(*) FILTER (leaves < lands) AS negative,
    count(*) AS total FROM met GROUP BY dd""",
)
def negative_layovers(t):
    return layovers.negative_layovers(t.legs)


@query(
    "hub_layover_stats",
    f"""WITH {PAIRS} SELECT {day()} AS flightdate, hub, CAST(min(leaves - lands) AS BIGINT) AS min_layover,
    CAST(max(leaves - lands) AS BIGINT) AS max_layover, count(*) AS pairs FROM met
    WHERE leaves - lands BETWEEN 45 AND 480 AND hub IN ('ATL', 'DFW', 'ORD') GROUP BY dd, hub""",
)
def hub_layover_stats(t):
    return layovers.hub_layover_stats(t.legs, ["ATL", "DFW", "ORD"])


@query(
    "connection_only_pairs",
    f"""WITH {EDGES} SELECT {day()} AS flightdate, fo AS origin, td AS dest, count(*) AS options FROM edge e
    WHERE NOT EXISTS (SELECT 1 FROM loaded x WHERE x.dd = e.dd AND x.o = e.fo AND x.d = e.td)
    GROUP BY dd, fo, td""",
)
def connection_only_pairs(t):
    return network.connection_only_pairs(t.loaded, t.connections)


@query(
    "connection_and_nonstop_pairs",
    f"""WITH {EDGES} SELECT {day()} AS flightdate, fo AS origin, td AS dest, count(*) AS options FROM edge e
    WHERE EXISTS (SELECT 1 FROM loaded x WHERE x.dd = e.dd AND x.o = e.fo AND x.d = e.td)
    GROUP BY dd, fo, td""",
)
def connection_and_nonstop_pairs(t):
    return network.connection_only_pairs(t.loaded, t.connections, nonstop=True)


@query(
    "two_stop_counts",
    f"""WITH {EDGES} SELECT {day("a.dd")} AS flightdate, a.fo AS origin, b.td AS dest, count(*) AS paths
    FROM edge a JOIN edge b ON a.dd = b.dd AND a.t = b.f WHERE a.fo <> b.td GROUP BY a.dd, a.fo, b.td""",
)
def two_stop_counts(t):
    return network.two_stop_counts(t.connections)


@query(
    "densest_pair",
    f"""WITH {EDGES} SELECT {day("a.dd")} AS flightdate, a.fo AS origin, b.td AS dest, count(*) AS paths
    FROM edge a JOIN edge b ON a.dd = b.dd AND a.t = b.f WHERE a.fo <> b.td GROUP BY a.dd, a.fo, b.td
    ORDER BY paths DESC, a.dd, origin, dest LIMIT 1""",
)
def densest_pair(t):
    return network.densest_pair(t.connections)


@query(
    "probe_pair",
    f"""WITH {EDGES}, x AS (
      SELECT *, t_arr_l >= (dd + 1) * 1440 AS overnight, abs(t_arr_l - f_dep_l - fb - tb) AS skew FROM edge e
      WHERE NOT EXISTS (SELECT 1 FROM loaded y WHERE y.dd = e.dd AND y.o = e.fo AND y.d = e.td)),
    g AS (SELECT dd, fo, td, count(*) AS options, max(skew) AS tz_skew, count(*) FILTER (overnight) AS overnights,
                 min(t_arr_l) FILTER (NOT overnight) AS earliest FROM x GROUP BY dd, fo, td)
    SELECT {day()} AS flightdate, fo AS origin, td AS dest, options, CAST(tz_skew AS BIGINT) AS tz_skew,
           overnights, {ts("earliest + 120")} AS deadline
    FROM g WHERE options >= 2 AND tz_skew >= 120 AND overnights > 0 AND earliest IS NOT NULL""",
)
def probe_pair(t):
    return network.probe_pairs(t.loaded, t.connections, min_options=2)

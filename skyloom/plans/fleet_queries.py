"""Aircraft rotations, delays handed on and cancellations, over the fleet records."""

from pyspark.sql import functions as F

from skyloom.operators import quality, rotations
from skyloom.operators import search as srch
from skyloom.plans.registry import query
from skyloom.plans.search_queries import RANK
from skyloom.plans.sql import EDGES, LEGS, fam, path_ctes
from skyloom.sources.order_records import CARRIERS, STATIONS


def _values(codes):
    return ", ".join(f"({i}, '{c}')" for i, c in enumerate(codes))


def fday(column: str = "dd") -> str:
    return f"strftime(DATE '2025-07-01' + CAST({column} AS INTEGER), '%Y-%m-%d')"


_LANDS = """CASE WHEN {k} = n AND n > 1 THEN base WHEN {k} % 2 = 1 THEN (base + 1 + (ok * 3 + ({k}) * 5) % 5) % 25
    WHEN {k} = n - 1 THEN ((base + 1 + (ok * 3 + ({k} - 1) * 5) % 5) % 25 + 1) % 25 ELSE base END"""

#: The records, and the legs with the true offsets. Minutes count from 2025-07-01.
FLEET = f"""
station(i, code) AS (VALUES {_values(STATIONS)}),
carrier_code(i, code) AS (VALUES {_values(CARRIERS)}),
fday AS (SELECT l_orderkey AS ok, list_sort(list(DISTINCT l_linenumber)) AS lns FROM lineitem GROUP BY l_orderkey),
fline AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS INTEGER) AS qty,
         len(x.lns) AS n, list_position(x.lns, l_linenumber) AS k, l_orderkey // 62 AS aircraft, 5 * ((l_orderkey // 62) % 5) AS base,
         coalesce(len(y.lns) = 1, false) AND l_orderkey % 62 > 0 AS away
  FROM lineitem JOIN fday x ON x.ok = l_orderkey LEFT JOIN fday y ON y.ok = l_orderkey - 1),
fend AS (
  SELECT *, CASE WHEN k = 1 THEN base ELSE {_LANDS.format(k="(k - 1)")} END AS oi, {_LANDS.format(k="k")} AS di FROM fline),
frec0 AS (
  SELECT f.*, a.code AS o, b.code AS d, -60 * (3 + oi % 7) AS off_o, -60 * (3 + di % 7) AS off_d,
         40 + 5 * least(abs(oi - di), 25 - abs(oi - di)) AS blk, 50 + 110 * least(abs(oi - di), 25 - abs(oi - di)) AS miles,
         (ok % 62) * 1440 + 300 + 60 * (3 + base % 7) + (k - 1) * 180 + (ok * 13 + ln * 7) % 60 AS dep_u,
         (pk + ln * 7) % 61 - 10 AS dd0, (pk + ln * 7) % 61 - 10 + sk % 21 - 10 AS ad0,
         NOT (qty = 50 OR (away AND k = 1 AND qty <= 20)) AS flown,
         coalesce(cc.code, 'X' || CAST(aircraft // 250 AS VARCHAR)) AS car, ok * 10 + ln AS num,
         CASE WHEN qty <> 3 THEN 'N' || CAST(aircraft AS VARCHAR) END AS tail
  FROM fend f JOIN station a ON a.i = oi JOIN station b ON b.i = di LEFT JOIN carrier_code cc ON cc.i = aircraft // 250),
frec AS (
  SELECT *, dep_u + blk AS arr_u, dep_u + off_o AS dep_l, dep_u + blk + off_d AS arr_l, (dep_u + off_o) // 1440 AS dd,
         car || '|' || CAST(num AS VARCHAR) || '|' || o || '|' || d AS lid, car || CAST(num AS VARCHAR) AS flight, {fam("car")} AS fam,
         CASE WHEN flown THEN dd0 END AS dep_delay, CASE WHEN flown THEN ad0 END AS arr_delay,
         CASE WHEN flown THEN (dep_u + off_o + dd0 + 1440) % 1440 END AS real_dep,
         CASE WHEN flown THEN (dep_u + blk + off_d + ad0 + 1440) % 1440 END AS real_arr
  FROM frec0),
leg AS (
  SELECT * FROM frec WHERE flown
  QUALIFY row_number() OVER (PARTITION BY dd, lid ORDER BY real_dep, real_arr, blk + ad0 - dd0, tail NULLS FIRST, dep_delay, arr_delay) = 1),
missed AS (
  SELECT * FROM frec WHERE NOT flown QUALIFY row_number() OVER (PARTITION BY dd, lid ORDER BY tail NULLS FIRST) = 1)"""

FLEET_EDGES = FLEET + EDGES[len(LEGS) :]


def fts(minutes: str) -> str:
    return f"strftime(TIMESTAMP '2025-07-01' + to_minutes(CAST({minutes} AS BIGINT)), '%Y-%m-%dT%H:%M:%S')"


def fleet_itineraries_sql(where: str = "true", max_stops: int = 2) -> str:
    return f"""WITH {path_ctes(max_stops).replace(EDGES, FLEET_EDGES)},
    pool AS (SELECT o AS code FROM leg GROUP BY o ORDER BY count(*) DESC, o LIMIT 60),
    ask AS (SELECT a.code AS o, b.code AS d, dd FROM pool a, pool b, (SELECT DISTINCT dd FROM edge) WHERE a.code <> b.code),
    hit AS (SELECT a.o || '-' || a.d || '-' || {fday("a.dd")} AS request_id, p.*, {RANK} AS rank
            FROM ask a JOIN path p ON p.dd = a.dd AND p.start = a.o AND p.at = a.d WHERE {where})
    SELECT request_id, rank, stops, flights, route, carriers, {fts("dep_l")} AS departs, {fts("arr_l")} AS arrives,
           {fts("dep_u")} AS departs_utc, {fts("arr_u")} AS arrives_utc, air AS air_minutes, lays AS layover_minutes,
           air + waits AS total_minutes FROM hit WHERE rank <= 20"""


ROTATIONS = f"""{FLEET},
turn AS (
  SELECT *, lag(lid) OVER w AS p_lid, lag(dd) OVER w AS p_dd, lag(car) OVER w AS p_car, lag(d) OVER w AS p_d, lag(arr_u) OVER w AS p_arr,
         lag(arr_delay) OVER w AS p_delay
  FROM leg WHERE tail IS NOT NULL WINDOW w AS (PARTITION BY tail ORDER BY dep_u, lid))"""


@query(
    "rotations",
    f"""WITH {ROTATIONS} SELECT tail, {fday()} AS flightdate, lid AS leg, {fday("p_dd")} AS previous_date, p_lid AS previous_leg,
    p_d = o AS whole, dep_u - p_arr AS ground_minutes FROM turn""",
)
def aircraft_rotations(t):
    """Every leg of an aircraft beside the one it flew before, across dates."""
    return t.fleet.rotations.select("tail", "flightdate", "leg", "previous_date", "previous_leg", "whole", "ground_minutes")


@query(
    "rotation_breaks",
    f"""WITH {ROTATIONS} SELECT p_car AS carrier, count(*) AS links, count(*) FILTER (p_d <> o) AS broken,
    count(*) FILTER (p_d <> o) / CAST(count(*) AS DOUBLE) AS rate FROM turn WHERE p_lid IS NOT NULL GROUP BY p_car""",
)
def rotation_breaks(t):
    return rotations.rotation_breaks(t.fleet.rotations)


@query(
    "rotation_untracked",
    f"""WITH {FLEET} SELECT car AS carrier, count(*) AS legs, count(*) FILTER (tail IS NULL) AS no_tail, 0 AS no_time
    FROM leg GROUP BY car""",
)
def rotation_untracked(t):
    return rotations.untracked(t.fleet.legs)


@query(
    "propagated_delay",
    f"""WITH RECURSIVE {ROTATIONS}, own AS (
      SELECT *, row_number() OVER (PARTITION BY tail ORDER BY dep_u, lid) AS i, coalesce(p_d = o, false) AS chained,
             greatest(dep_u - p_arr - 30, 0) AS slack FROM turn),
    seeds AS (SELECT *, greatest(dep_delay - CASE WHEN chained THEN greatest(p_delay - slack, 0) ELSE 0 END, 0) AS own FROM own),
    run AS (
      SELECT tail, i, dd, lid, own, CAST(0 AS BIGINT) AS handed, CAST(own AS BIGINT) AS total FROM seeds WHERE i = 1
      UNION ALL
      SELECT s.tail, s.i, s.dd, s.lid, s.own, CASE WHEN s.chained THEN greatest(r.total - s.slack, 0) ELSE 0 END,
             CASE WHEN s.chained THEN greatest(r.total - s.slack, 0) ELSE 0 END + s.own
      FROM run r JOIN seeds s ON s.tail = r.tail AND s.i = r.i + 1)
    SELECT tail, {fday()} AS flightdate, lid AS leg, own, handed AS handed_on, total FROM run""",
)
def propagated_delay(t):
    """What delays hand on to later legs of the aircraft, over chains of any length."""
    return rotations.propagated_delay(t.fleet.rotations)


@query(
    "cancellation_after_break",
    f"""WITH {FLEET}, plan AS (
      SELECT dd, lid, tail, o, d, dep_u, true AS up FROM leg UNION ALL
      SELECT dd, lid, tail, o, d, dep_u, false FROM missed m WHERE NOT EXISTS (SELECT 1 FROM leg l WHERE l.dd = m.dd AND l.lid = m.lid)),
    seen AS (SELECT *, last_value(CASE WHEN up THEN d END IGNORE NULLS) OVER (
        PARTITION BY tail ORDER BY dep_u, lid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_d FROM plan),
    state AS (SELECT *, CASE WHEN tail IS NULL THEN 'untracked' WHEN p_d IS NULL THEN 'first' WHEN p_d = o THEN 'whole' ELSE 'broken' END AS s FROM seen)
    SELECT s AS rotation, count(*) AS scheduled, count(*) FILTER (NOT up) AS cancelled,
           count(*) FILTER (NOT up) / CAST(count(*) AS DOUBLE) AS rate FROM state GROUP BY s""",
)
def cancellation_after_break(t):
    """How often a leg is cancelled where the aircraft stands elsewhere, and where it is in place."""
    return rotations.cancellation_after_break(t.fleet.legs, t.fleet.cancelled)


@query(
    "fleet_repeats",
    f"""WITH {FLEET}, x AS (SELECT count(*) AS n FROM frec WHERE flown GROUP BY dd, lid HAVING count(*) > 1)
    SELECT count(*) AS keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM x""",
)
def fleet_repeats(t):
    """Keys that records repeat, before they are merged to legs."""
    from skyloom.operators.legs import project_legs, valid_legs

    repeats = quality.duplicate_keys(project_legs(valid_legs(t.fleet.records)))
    return repeats.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_rows"))


def _answers(df):
    return df.filter(F.col("rank").isNotNull()).drop("status", "error", "searchable")


@query("fleet_itineraries", fleet_itineraries_sql())
def fleet_itineraries(t):
    """All pairs on all 62 dates, up to two stops: a connection is the best answer to most pairs."""
    return _answers(t.fleet.answers(max_stops=2))


@query("fleet_itineraries_deadline", fleet_itineraries_sql("p.stops >= 1 AND p.arr_l < a.dd * 1440 + 900"))
def fleet_itineraries_deadline(t):
    return _answers(t.fleet.answers(min_stops=1, max_stops=2, arrive_before="15:00"))


@query("fleet_itineraries_depart_after", fleet_itineraries_sql("p.dep_l >= a.dd * 1440 + 480"))
def fleet_itineraries_depart_after(t):
    return _answers(t.fleet.answers(max_stops=2, depart_after="08:00"))


_FEW = "a.d IN ('MIA', 'LGA') AND a.dd < 62"


@query("fleet_itineraries_to_few", fleet_itineraries_sql(_FEW))
def fleet_itineraries_to_few(t):
    """Requests to two airports only: hops away from them are not taken."""
    asked = t.fleet.workload(max_stops=2).filter(F.col("dest").isin("MIA", "LGA") & (F.col("date") < "2025-09-01"))
    return _answers(srch.search(asked, t.fleet.legs, t.fleet.connections, built=t.fleet.built))


@query(
    "fleet_connections",
    f"""WITH {FLEET_EDGES} SELECT {fday()} AS flightdate, count(*) AS connections FROM edge GROUP BY dd""",
)
def fleet_connections(t):
    return t.fleet.built

"""Shared SQL prefixes of the oracles: the legs restated from the order tables.

They use the true station offsets, which the Spark side has to recover from the clocks.
Times are whole minutes since 2025-07-14; ``ts`` renders them.
"""

from skyloom.sources.order_records import CARRIERS, STATIONS


def _values(codes):
    return ", ".join(f"({i}, '{c}')" for i, c in enumerate(codes))


def ts(minutes: str) -> str:
    return f"strftime(TIMESTAMP '2025-07-14' + to_minutes(CAST({minutes} AS BIGINT)), '%Y-%m-%dT%H:%M:%S')"


def day(column: str = "dd") -> str:
    return f"strftime(DATE '2025-07-14' + CAST({column} AS INTEGER), '%Y-%m-%d')"


def fam(column: str) -> str:
    return (
        f"CASE WHEN {column} IN ('MQ', 'OH', 'PT') THEN 'AA' WHEN {column} = '9E' THEN 'DL' "
        f"WHEN {column} = 'QX' THEN 'AS' ELSE {column} END"
    )


RECORDS = f"""
line AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk,
         min(o_custkey) AS ck, CAST(min(l_quantity) AS INTEGER) AS qty, min(l_returnflag) AS rf
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY l_orderkey, l_linenumber),
station(n, code) AS (VALUES {_values(STATIONS)}),
carrier_code(i, code) AS (VALUES {_values(CARRIERS)}),
ends AS (
  SELECT x.*, x.ok % 7 AS dd, so.code AS o, sd.code AS d,
         60 * ((so.n * 7) % 24) - 660 + CASE WHEN so.n % 3 = 0 AND x.ok % 7 >= 4 THEN 60 ELSE 0 END AS off_o,
         60 * ((sd.n * 7) % 24) - 660 + CASE WHEN sd.n % 3 = 0 AND x.ok % 7 >= 4 THEN 60 ELSE 0 END AS off_d,
         abs(so.n - sd.n) AS apart
  FROM line x JOIN supplier ON x.sk = s_suppkey JOIN customer ON x.ck = c_custkey
  JOIN station so ON so.n = s_nationkey JOIN station sd ON sd.n = c_nationkey),
rec0 AS (
  SELECT dd, dd * 1440 AS t0, o, d, off_o, off_d, qty,
         coalesce(cc.code, 'X' || CAST(pk // 100 AS VARCHAR)) AS car, ok * 10 + ln AS num,
         CASE WHEN qty <> 3 THEN 'N' || CAST(pk // 5 AS VARCHAR) END AS tail,
         ((pk * 37 + ln * 113) % 288) * 5 AS dep, 45 + 15 * apart AS blk0,
         (pk + ln * 7) % 61 - 10 AS dep_delay0, (pk + ln * 7) % 61 - 10 + sk % 21 - 10 AS arr_delay0,
         CASE WHEN qty = 50 THEN 1 WHEN qty = 1 AND rf = 'A' THEN NULL ELSE 0 END AS cancelled,
         CASE WHEN NOT (qty = 2 AND rf = 'R') THEN 45 + 15 * apart END AS blk,
         50 + 110 * apart AS miles
  FROM ends LEFT JOIN carrier_code cc ON cc.i = pk // 100),
rec AS (
  SELECT *, (dep - off_o + blk0 + off_d + 14400) % 1440 AS arr,
         CASE WHEN qty <> 50 THEN dep_delay0 END AS dep_delay,
         CASE WHEN qty <> 50 THEN arr_delay0 END AS arr_delay,
         CASE WHEN qty <> 50 THEN (dep + dep_delay0 + 14400) % 1440 END AS real_dep,
         CASE WHEN qty <> 50 THEN (dep - off_o + blk0 + off_d + arr_delay0 + 14400) % 1440 END AS real_arr
  FROM rec0)"""

LEGS = f"""{RECORDS},
loaded AS (
  SELECT *, car || '|' || CAST(num AS VARCHAR) || '|' || o || '|' || d AS lid,
         car || CAST(num AS VARCHAR) AS flight, {fam("car")} AS fam
  FROM rec WHERE cancelled = 0 AND o <> d),
leg0 AS (
  SELECT *, t0 + dep AS dep_l, CASE WHEN blk IS NOT NULL THEN t0 + dep - off_o END AS dep_u FROM loaded),
leg AS (
  SELECT *, dep_u + blk AS arr_u, coalesce(dep_u + blk + off_d, t0 + arr) AS arr_l FROM leg0)"""

EDGES = f"""{LEGS},
edge AS (
  SELECT a.dd, a.lid AS f, b.lid AS t, a.o AS fo, a.d AS hub, b.d AS td, a.car AS fc, b.car AS tc,
         b.dep_u - a.arr_u AS lay, b.flight AS tf, b.blk AS tb, b.arr_l AS t_arr_l, b.arr_u AS t_arr_u,
         b.dep_l AS t_dep_l, a.dep_l AS f_dep_l, a.blk AS fb
  FROM leg a JOIN leg b ON a.dd = b.dd AND a.d = b.o AND a.fam = b.fam AND b.d <> a.o
   AND b.dep_u - a.arr_u BETWEEN 45 AND 300)"""

ROUTES = f"""{LEGS},
route AS (
  SELECT o, d, count(*) AS flights, count(DISTINCT car) AS carriers, min(dd) AS d0, max(dd) AS d1
  FROM loaded GROUP BY o, d)"""


def path_ctes(max_stops: int) -> str:
    """Acyclic chains of 0..max_stops connections."""
    out = f"""{EDGES},
p0 AS (
  SELECT dd, o AS start, d AS at, lid AS last, car || '|' || num AS ids, flight AS flights, o || '>' || d AS route,
         car AS carriers, dep_l, dep_u, arr_l, arr_u, blk AS air, '' AS lays, 0 AS waits, 0 AS stops
  FROM leg)"""
    for k in range(1, max_stops + 1):
        sep = "" if k == 1 else "p.lays || '>' || "
        out += f""",
p{k} AS (
  SELECT p.dd, p.start, e.td AS at, e.t AS last, p.ids || '>' || split_part(e.t, '|', 1) || '|' || split_part(e.t, '|', 2) AS ids, p.flights || '>' || e.tf AS flights,
         p.route || '>' || e.td AS route, p.carriers || '>' || e.tc AS carriers, p.dep_l, p.dep_u,
         e.t_arr_l AS arr_l, e.t_arr_u AS arr_u, p.air + e.tb AS air, {sep}CAST(e.lay AS VARCHAR) AS lays,
         p.waits + e.lay AS waits, {k} AS stops
  FROM p{k - 1} p JOIN edge e ON p.dd = e.dd AND p.last = e.f
  WHERE position(e.td IN p.route) = 0)"""
    union = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(max_stops + 1))
    return f"{out},\npath AS ({union})"


ITINERARY_COLUMNS = f"""stops, flights, route, carriers, {ts("dep_l")} AS departs, {ts("arr_l")} AS arrives,
  {ts("dep_u")} AS departs_utc, {ts("arr_u")} AS arrives_utc, air AS air_minutes, lays AS layover_minutes,
  air + waits AS total_minutes"""

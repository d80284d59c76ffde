"""Offsets, UTC times and the audits of both time frames."""

from pyspark.sql import functions as F

from skyloom.operators import offsets
from skyloom.plans.registry import query
from skyloom.plans.sql import LEGS, day, ts

DELTAS = f"""{LEGS},
pair AS (
  SELECT dd, o, d, count(*) AS flights, min((arr - dep - blk + 2880) % 1440) AS lo,
         max((arr - dep - blk + 2880) % 1440) AS hi
  FROM loaded WHERE blk IS NOT NULL GROUP BY dd, o, d)"""


@query(
    "offset_deltas",
    f"""WITH {DELTAS} SELECT {day()} AS flightdate, o AS origin, d AS dest, flights, CAST(lo AS BIGINT) AS delta
    FROM pair WHERE lo = hi""",
)
def offset_deltas(t):
    return offsets.offset_deltas(t.loaded)


@query(
    "airport_offsets",
    f"""WITH RECURSIVE {DELTAS},
    hop AS (SELECT dd, o AS a, d AS b, lo AS delta FROM pair WHERE lo = hi
            UNION SELECT dd, d, o, -lo FROM pair WHERE lo = hi),
    walk(dd, a, v) AS (
      SELECT DISTINCT dd, a, 1020 FROM hop WHERE a = 'PHX'
      UNION SELECT w.dd, h.b, CAST((w.v + h.delta + 2880) % 1440 AS INTEGER)
      FROM walk w JOIN hop h ON w.dd = h.dd AND w.a = h.a)
    SELECT {day()} AS flightdate, a AS airport, CAST(CASE WHEN v > 720 THEN v - 1440 ELSE v END AS BIGINT)
    AS offset_minutes FROM walk""",
)
def airport_offsets(t):
    return offsets.solve_offsets(offsets.offset_deltas(t.loaded)).offsets


@query(
    "true_offsets",
    f"""WITH {LEGS} SELECT DISTINCT {day()} AS flightdate, o AS airport, CAST(off_o AS BIGINT) AS offset_minutes
    FROM loaded WHERE blk IS NOT NULL UNION SELECT DISTINCT {day()}, d, CAST(off_d AS BIGINT) FROM loaded
    WHERE blk IS NOT NULL""",
)
def true_offsets(t):
    """The recovered offsets against the ones the records were made with."""
    return t.offsets


@query(
    "offset_issues",
    f"""WITH {LEGS} SELECT DISTINCT {day()} AS flightdate, 'no_anchor' AS issue, 'XXX' AS detail
    FROM loaded WHERE blk IS NOT NULL
    UNION ALL SELECT {day("d")}, 'no_pairs', '' FROM (SELECT unnest([7, 8]) AS d)""",
)
def offset_issues(t):
    """An anchor that does not fly, and two requested dates that are not loaded."""
    deltas = offsets.offset_deltas(t.loaded)
    return offsets.solve_offsets(deltas, ("XXX", 0), _nine_dates(t)).issues


@query(
    "offset_issues_found",
    f"""WITH {LEGS} SELECT {day("d")} AS flightdate, 'no_pairs' AS issue, '' AS detail
    FROM (SELECT unnest([7, 8]) AS d)""",
)
def offset_issues_found(t):
    """Nothing but the two dates that are not loaded: no conflict, nothing disconnected."""
    return offsets.solve_offsets(offsets.offset_deltas(t.loaded), dates=_nine_dates(t)).issues


def _nine_dates(t):
    first = F.lit("2025-07-14").cast("date")
    return t.spark.range(0, 9).select(F.date_add(first, F.col("id").cast("int")).alias("flightdate"))


@query(
    "pair_support",
    f"""WITH {DELTAS}, good AS (SELECT *, flights >= 3 AS strong FROM pair WHERE lo = hi),
    st AS (SELECT dd, a, bool_or(strong) AS strong FROM
      (SELECT dd, o AS a, strong FROM good UNION ALL SELECT dd, d, strong FROM good) GROUP BY dd, a),
    sc AS (SELECT dd, count(*) AS stations, count(*) FILTER (NOT strong) AS thin_stations FROM st GROUP BY dd)
    SELECT {day("good.dd")} AS flightdate, count(*) FILTER (strong) AS strong_pairs,
           count(*) FILTER (NOT strong) AS thin_pairs, any_value(stations) AS stations,
           any_value(thin_stations) AS thin_stations
    FROM good JOIN sc ON good.dd = sc.dd GROUP BY good.dd""",
)
def pair_support(t):
    return offsets.pair_support(offsets.offset_deltas(t.loaded))


@query(
    "utc_times",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, lid AS leg_id, {ts("dep_l")} AS scheduled_departure_time,
    {ts("arr_l")} AS scheduled_arrival_time, {ts("dep_u")} AS scheduled_departure_utc,
    {ts("arr_u")} AS scheduled_arrival_utc FROM leg""",
)
def utc_times(t):
    from skyloom.functions import leg_id

    return offsets.utc_times(t.loaded, t.offsets).select(
        "flightdate",
        leg_id().alias("leg_id"),
        "scheduled_departure_time",
        "scheduled_arrival_time",
        "scheduled_departure_utc",
        "scheduled_arrival_utc",
    )


@query(
    "utc_roundtrip",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, count(*) AS legs,
    count(*) FILTER ((arr_u + off_d + 14400) % 1440 = arr) AS same_clock,
    count(*) FILTER (arr_u + off_d = arr_l) AS same_arrival,
    count(*) FILTER (arr_u - dep_u = blk) AS same_block, count(*) FILTER (arr_u <= dep_u) AS not_forward
    FROM leg WHERE arr_u IS NOT NULL GROUP BY dd""",
)
def utc_roundtrip(t):
    return offsets.utc_roundtrip(t.legs, t.loaded, t.offsets)


@query(
    "local_duration_audit",
    f"""WITH {LEGS} SELECT {day()} AS flightdate, count(*) AS legs, count(*) FILTER (arr - dep = blk) AS agrees,
    count(*) FILTER (arr < dep) AS negative FROM loaded GROUP BY dd""",
)
def local_duration_audit(t):
    return offsets.local_duration_audit(t.loaded)


@query(
    "overnight_audit",
    f"""WITH {LEGS}, x AS (SELECT *, floor(arr_l / 1440.0) AS land, floor(arr_u / 1440.0) AS land_u,
      floor(dep_u / 1440.0) AS left_u FROM leg WHERE arr_u IS NOT NULL)
    SELECT {day()} AS flightdate, count(*) AS legs, count(*) FILTER (land > dd) AS next_day,
    count(*) FILTER (land < dd) AS previous_day, count(*) FILTER (land_u > left_u) AS utc_next_day,
    count(*) FILTER (land > dd AND arr_l < t0 + 900) AS false_accepts FROM x GROUP BY dd""",
)
def overnight_audit(t):
    return offsets.overnight_audit(t.legs)


@query(
    "utc_coverage",
    f"""WITH {LEGS}, want AS (SELECT unnest(range(0, 9)) AS dd),
    got AS (SELECT dd, count(*) AS total, count(dep_u) AS dep_utc, count(arr_u) AS arr_utc,
            count(arr_l) AS arr_local FROM leg GROUP BY dd)
    SELECT {day("want.dd")} AS flightdate, coalesce(total, 0) AS total, coalesce(dep_utc, 0) AS dep_utc,
    coalesce(arr_utc, 0) AS arr_utc, coalesce(arr_local, 0) AS arr_local, coalesce(total, 0) > 0 AS loaded
    FROM want LEFT JOIN got ON want.dd = got.dd""",
)
def utc_coverage(t):
    return offsets.utc_coverage(t.legs, _nine_dates(t))


@query(
    "dst_contradictions",
    f"""WITH {DELTAS}, week AS (
      SELECT o, d, count(*) AS flights, min((arr - dep - blk + 2880) % 1440) AS lo,
             max((arr - dep - blk + 2880) % 1440) AS hi
      FROM loaded WHERE blk IS NOT NULL GROUP BY o, d)
    SELECT o AS origin, d AS dest, flights, CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high
    FROM week WHERE lo <> hi""",
)
def dst_contradictions(t):
    return offsets.contradictory_pairs(t.loaded, by_date=False)


@query(
    "offset_changes",
    f"""WITH {LEGS}, x AS (SELECT dd, o AS a, off_o AS v FROM loaded WHERE blk IS NOT NULL
                       UNION SELECT dd, d, off_d FROM loaded WHERE blk IS NOT NULL)
    SELECT p.a AS airport, CAST(p.v AS BIGINT) AS first_offset, CAST(q.v AS BIGINT) AS second_offset
    FROM x p JOIN x q ON p.a = q.a AND p.dd = 3 AND q.dd = 4 WHERE p.v <> q.v""",
)
def offset_changes(t):
    return offsets.offset_changes(t.offsets, "2025-07-17", "2025-07-18")


@query(
    "airports_without_offset",
    f"""WITH {LEGS}, a AS (SELECT dd, o AS code, blk, dd >= 3 AND 'HNL' IN (o, d) AS cut FROM loaded
      UNION ALL SELECT dd, d, blk, dd >= 3 AND 'HNL' IN (o, d) FROM loaded)
    SELECT {day()} AS flightdate, code FROM a GROUP BY dd, code HAVING count(blk) FILTER (NOT cut) = 0""",
)
def airports_without_offset(t):
    """From the fourth date on no leg of one station states its block time."""
    late = F.col("flightdate") >= F.lit("2025-07-17").cast("date")
    unknown = late & ((F.col("origin") == "HNL") | (F.col("dest") == "HNL"))
    block = "scheduled_duration_minutes"
    legs = t.loaded.withColumn(block, F.when(~unknown, F.col(block)))
    solution = offsets.solve_offsets(offsets.offset_deltas(legs), dates=t.dates)
    return offsets.airports_without_offset(t.loaded, offsets.require_solved(solution))

import datetime as dt

import pytest
from conftest import DAY, LEG_DDL, clock, loaded_leg
from pyspark.sql import functions as F

from skyloom.operators import offsets as off

PAIR = "flightdate date, origin string, dest string, flights bigint, delta int"


def pairs(spark, rows, day=DAY):
    return spark.createDataFrame([(day, *r) for r in rows], PAIR)


def solved(spark, rows, anchor=("PHX", -420)):
    return off.solve_offsets(pairs(spark, rows), anchor)


def as_map(solution):
    return {r.airport: r.offset_minutes for r in off.require_solved(solution).collect()}


def test_chain_both_directions_and_thin_pairs(spark):
    rows = [("PHX", "DFW", 9, 120), ("JFK", "DFW", 5, 1380), ("JFK", "BET", 1, 1200)]
    assert as_map(solved(spark, rows)) == {"PHX": -420, "DFW": -300, "JFK": -240, "BET": -480}


def test_contradiction_is_reported(spark):
    rows = [("PHX", "DFW", 9, 60), ("DFW", "JFK", 9, 120), ("PHX", "JFK", 9, 60)]
    with pytest.raises(off.OffsetError, match="conflict"):
        as_map(solved(spark, rows))


def test_contradiction_of_thin_pairs_off_the_frontier(spark):
    rows = [("PHX", "DFW", 9, 60), ("PHX", "JFK", 9, 60), ("DFW", "JFK", 1, 60)]
    with pytest.raises(off.OffsetError, match="conflict"):
        as_map(solved(spark, rows))


def test_two_components(spark):
    with pytest.raises(off.OffsetError, match="disconnected"):
        as_map(solved(spark, [("PHX", "DFW", 9, 60), ("GUM", "SPN", 9, 0)]))


def test_missing_anchor(spark):
    with pytest.raises(off.OffsetError, match="no_anchor"):
        as_map(solved(spark, [("ATL", "DFW", 9, 60)]))


def test_no_pairs_on_a_requested_date(spark):
    dates = spark.createDataFrame([(DAY,), (dt.date(2025, 7, 19),)], "flightdate date")
    solution = off.solve_offsets(pairs(spark, [("PHX", "DFW", 9, 60)]), dates=dates)
    assert [(str(r.flightdate), r.issue) for r in solution.issues.collect()] == [("2025-07-19", "no_pairs")]


def test_fractional_hour(spark):
    with pytest.raises(off.OffsetError, match="not_whole_hour"):
        as_map(solved(spark, [("PHX", "DFW", 9, 37)]))


def test_dateline_wraps_to_plus_ten(spark):
    assert as_map(solved(spark, [("PHX", "GUM", 9, 17 * 60)]))["GUM"] == 600


def test_long_thin_chain_needs_many_rounds(spark):
    names = ["PHX"] + [f"A{i:02d}" for i in range(12)]
    rows = [(a, b, 1, 60) for a, b in zip(names, names[1:])]
    got = as_map(solved(spark, rows))
    assert got["A11"] == ((-420 + 12 * 60 + 719) % 1440) - 719 and len(got) == 13


def test_known_summer_offsets_round_trip(spark):
    # Real July offsets in hours.
    true = {"PHX": -7, "JFK": -4, "ATL": -4, "ORD": -5, "DFW": -5, "DEN": -6, "LAX": -7, "SEA": -7,
            "ANC": -8, "HNL": -10, "GUM": 10, "SJU": -4}
    minutes = {k: v * 60 for k, v in true.items()}
    names = list(true)
    rows = [
        loaded_leg("AA", i, a, b, f"{(5 * i) % 24:02d}:{(7 * i) % 60:02d}", 60 + 31 * (i % 13), minutes)
        for i, (a, b) in enumerate(
            (a, b) for k, a in enumerate(names) for b in (names[(k + 1) % 12], names[(k + 5) % 12])
        )
    ]
    loaded = spark.createDataFrame(rows * 1, LEG_DDL)
    naive = off.local_duration_audit(loaded).first()
    assert naive.negative > 0 and naive.agrees < naive.legs  # the hazard is present
    solution = off.solve_offsets(off.offset_deltas(loaded))
    assert as_map(solution) == minutes

    legs = off.utc_times(loaded, solution.offsets)
    audit = off.utc_roundtrip(legs, loaded, solution.offsets).first()
    assert audit.legs == len(rows) == audit.same_clock == audit.same_arrival == audit.same_block
    assert audit.not_forward == 0
    night = off.overnight_audit(legs).first()
    assert night.next_day > 0 and night.previous_day > 0 and night.utc_next_day > 0 and night.false_accepts == 0
    assert off.airports_without_offset(loaded, solution.offsets).count() == 0


def test_red_eye_moves_to_its_own_date_and_westbound_minute(spark):
    offsets = {"MIA": -240, "RIC": -240, "ATL": -240, "HSV": -300}
    rows = [
        loaded_leg("AA", 983, "MIA", "RIC", "21:51", 147, offsets),
        loaded_leg("DL", 1, "ATL", "HSV", "22:55", 61, offsets),
    ]
    table = spark.createDataFrame([(DAY, a, o) for a, o in offsets.items()], "flightdate date, airport string, offset_minutes int")
    loaded = spark.createDataFrame(rows, LEG_DDL)
    legs = {r.reporting_airline: r for r in off.utc_times(loaded, table).collect()}
    assert rows[0][6] == clock("00:18")
    assert legs["AA"].scheduled_arrival_time == clock("00:18", plus=1)
    assert legs["DL"].scheduled_arrival_time == clock("22:56")


def test_legs_that_cannot_be_solved_keep_what_they_have(spark):
    offsets = {"PHX": -420, "DFW": -300}
    rows = [
        loaded_leg("AA", 1, "PHX", "DFW", "09:00", 140, offsets),
        loaded_leg("AA", 2, "PHX", "XXX", "09:00", 140, {**offsets, "XXX": 0}),
        (DAY, "AA", 3, "PHX", "DFW", clock("09:00"), clock("13:20"), None),
        (DAY, "AA", 4, "PHX", "DFW", None, clock("13:20"), 140),
        (DAY, "AA", 5, "PHX", "DFW", clock("09:00"), None, 140),
    ]
    table = spark.createDataFrame([(DAY, a, o) for a, o in offsets.items()], "flightdate date, airport string, offset_minutes int")
    legs = off.utc_times(spark.createDataFrame(rows, LEG_DDL), table)
    got = {r.flight_number_reporting_airline: r for r in legs.collect()}
    assert got[1].scheduled_departure_utc == clock("16:00")
    for n in (2, 3):
        assert got[n].scheduled_departure_utc is None and got[n].scheduled_arrival_time is not None
    assert got[4].scheduled_departure_utc is None and got[4].scheduled_arrival_time == clock("13:20")
    assert got[5].scheduled_arrival_time == clock("13:20")
    days = spark.createDataFrame([(DAY,), (dt.date(2025, 7, 20),)], "flightdate date")
    cover = {str(r.flightdate): (r.total, r.dep_utc, r.arr_local, r.loaded) for r in off.utc_coverage(legs, days).collect()}
    assert cover == {"2025-07-18": (5, 2, 5, True), "2025-07-20": (0, 0, 0, False)}
    from skyloom.operators.quality import temporal_types

    assert temporal_types(legs) == []
    assert temporal_types(legs.withColumn("scheduled_arrival_time", F.lit(930))) == [("scheduled_arrival_time", "int")]


def test_deltas_drop_contradictory_pairs_and_fold_the_overnight_day(spark):
    offsets = {"PHX": -420, "DFW": -300}
    rows = [
        loaded_leg("AA", 1, "PHX", "DFW", "09:00", 140, offsets),
        loaded_leg("AA", 2, "PHX", "DFW", "23:00", 140, offsets),
        loaded_leg("AA", 3, "DFW", "PHX", "09:00", 150, offsets),
        (DAY, "AA", 4, "DFW", "PHX", clock("10:00"), clock("10:31"), 150),
    ]
    legs = spark.createDataFrame(rows, LEG_DDL)
    assert [(r.origin, r.flights, r.delta) for r in off.offset_deltas(legs).collect()] == [("PHX", 2, 120)]
    bad = off.contradictory_pairs(legs).collect()
    assert [(r.origin, r.flights) for r in bad] == [("DFW", 2)]
    support = off.pair_support(off.offset_deltas(legs)).first()
    assert (support.strong_pairs, support.thin_pairs, support.thin_stations) == (0, 1, 2)


def test_offset_changes(spark):
    rows = [(dt.date(2025, 3, 8), "ORD", -360), (dt.date(2025, 3, 9), "ORD", -300), (dt.date(2025, 3, 8), "PHX", -420), (dt.date(2025, 3, 9), "PHX", -420)]
    table = spark.createDataFrame(rows, "flightdate date, airport string, offset_minutes int")
    got = off.offset_changes(table, "2025-03-08", "2025-03-09").collect()
    assert [(r.airport, r.first_offset, r.second_offset) for r in got] == [("ORD", -360, -300)]


def test_firm_pairs_are_used_before_thin_ones(spark):
    """The direct pair is nearer to the anchor, but hangs on one faulty flight."""
    pairs = [(DAY, "PHX", "DFW", 5, 120), (DAY, "DFW", "ORD", 4, 0), (DAY, "PHX", "ORD", 1, 60), (DAY, "ORD", "BRW", 1, -180), (DAY, "BRW", "SCC", 3, 0)]
    table = spark.createDataFrame(pairs, "flightdate date, origin string, dest string, flights bigint, delta int")
    solution = off.solve_offsets(table)
    assert {r.airport: r.offset_minutes for r in solution.offsets.collect()} == {"PHX": -420, "DFW": -300, "ORD": -300, "BRW": -480, "SCC": -480}
    assert [(r.issue, r.detail) for r in solution.issues.collect()] == [("conflict", "PHX->ORD")]
    # With every pair firm, the nearest wins and the blame moves.
    nearest = off.solve_offsets(table, min_flights=1)
    assert [(r.issue, r.detail) for r in nearest.issues.collect()] == [("conflict", "DFW->ORD")]

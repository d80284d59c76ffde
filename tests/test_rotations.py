"""Ordered scans, aircraft rotations, delays handed on and cancellations, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import rotations as rot
from skyloom.operators.ordered import with_previous

FIRST = dt.datetime(2025, 7, 14)


@pytest.mark.parametrize("hot_rows", [1, 3, 10_000])
@pytest.mark.parametrize("only", [False, True])
def test_previous_row(spark, hot_rows, only):
    rng = random.Random(hot_rows)
    rows = []
    for i in range(300):
        key = rng.choice(["a", "a", "a", "b", "c", None])
        at = None if rng.random() < 0.05 else FIRST + dt.timedelta(minutes=rng.choice([0, 1, 5, 700, 1440, 1441, 9000]))
        rows.append((i, key, at, rng.random() < 0.4))
    df = spark.createDataFrame(rows, "id int, key string, at timestamp_ntz, taken boolean")
    got = with_previous(df, "key", "at", ["id"], ["id"], F.col("taken") if only else None, hot_rows=hot_rows)
    assert got.columns == ["id", "key", "at", "taken", "previous"]
    want = {}
    for i, key, at, _ in rows:
        before = [
            (x[2], x[0]) for x in rows
            if None not in (key, at, x[2]) and x[1] == key and (x[2], x[0]) < (at, i) and (x[3] or not only)
        ]
        want[i] = max(before)[1] if before else None
    assert {r.id: r.previous and r.previous.id for r in got.collect()} == want


LEGS = (
    "flightdate date, reporting_airline string, flight_number_reporting_airline bigint, origin string, dest string, "
    "tail_number string, scheduled_departure_utc timestamp_ntz, scheduled_arrival_utc timestamp_ntz, "
    "departure_delay_minutes int, arrival_delay_minutes int"
)


def leg(number, tail, origin, dest, minute, block=60, late=0, arrives_late=0, carrier="AA"):
    at = None if minute is None else FIRST + dt.timedelta(minutes=minute)
    day = (at or FIRST).date()
    return (day, carrier, number, origin, dest, tail, at, at and at + dt.timedelta(minutes=block), late, arrives_late)


def random_legs(n):
    rng = random.Random(n)
    rows, place = [], {}
    for i in range(n):
        tail = rng.choice(["N1", "N1", "N1", "N2", "N3", None])
        origin = place.get(tail, "A") if rng.random() < 0.9 else rng.choice("ABC")
        dest = rng.choice([c for c in "ABC" if c != origin])
        place[tail] = dest
        minute = None if rng.random() < 0.02 else i * 47
        late = rng.choice([None, 0, -5, 20, 90])
        rows.append(leg(i, tail, origin, dest, minute, 20, late, None if late is None else late + rng.randrange(-9, 9), rng.choice(["AA", "DL"])))
    return rows


def brute_links(rows):
    """Rows beside the previous one of the aircraft, in order of departure."""
    out, last = [], {}
    for r in sorted((r for r in rows if r[5] and r[6]), key=lambda r: (r[6], f"{r[1]}|{r[2]}|{r[3]}|{r[4]}")):
        out.append((r, last.get(r[5])))
        last[r[5]] = r
    return out


def test_rotations_and_breaks(spark):
    rows = random_legs(200)
    linked = rot.rotations(spark.createDataFrame(rows, LEGS), hot_rows=4)
    want = {}
    for r, p in brute_links(rows):
        ground = p and int((r[6] - p[7]).total_seconds() // 60)
        want[r[2]] = (p and p[2], p and p[4] == r[3], ground)
    got = {
        int(r.leg.split("|")[1]): (r.previous_leg and int(r.previous_leg.split("|")[1]), r.whole, r.ground_minutes)
        for r in linked.collect()
    }
    assert got == want
    counts = {}
    for r, p in brute_links(rows):
        if p:
            links, broken = counts.get(p[1], (0, 0))
            counts[p[1]] = links + 1, broken + (p[4] != r[3])
    assert {r.carrier: (r.links, r.broken) for r in rot.rotation_breaks(linked).collect()} == counts
    seen = {r.carrier: (r.legs, r.no_tail, r.no_time) for r in rot.untracked(spark.createDataFrame(rows, LEGS)).collect()}
    assert sum(n for n, _, _ in seen.values()) == 200
    assert sum(a + b for _, a, b in seen.values()) == 200 - len(want)


def brute_delays(rows, turn):
    totals, out = {}, {}
    for r, p in brute_links(rows):
        handed = inherited = 0
        if p and p[4] == r[3]:
            slack = max(0, int((r[6] - p[7]).total_seconds() // 60) - turn)
            handed, inherited = max(0, totals[p[2]] - slack), max(0, (p[9] or 0) - slack)
        own = max(0, (r[8] or 0) - inherited)
        totals[r[2]] = handed + own
        out[r[2]] = (own, handed, handed + own)
    return out


@pytest.mark.parametrize("turn", [0, 30])
def test_delays_are_handed_on(spark, turn):
    rows = random_legs(300)
    got = rot.propagated_delay(rot.rotations(spark.createDataFrame(rows, LEGS)), turn)
    assert {int(r.leg.split("|")[1]): (r.own, r.handed_on, r.total) for r in got.collect()} == brute_delays(rows, turn)


def test_one_delay_runs_down_a_long_chain(spark):
    """200 legs with 35 minutes on the ground: five minutes of slack each time."""
    rows = [leg(i, "N1", "AB"[i % 2], "BA"[i % 2], 95 * i, late=500 if i == 0 else 0, arrives_late=0) for i in range(200)]
    got = {int(r.leg.split("|")[1]): r for r in rot.propagated_delay(rot.rotations(spark.createDataFrame(rows, LEGS))).collect()}
    assert [got[i].handed_on for i in range(102)] == [0, *[500 - 5 * i for i in range(1, 101)], 0]
    assert all(got[i].total == 0 for i in range(100, 200))


def test_cancellations(spark):
    flown = [leg(1, "N1", "A", "B", 0), leg(2, "N1", "C", "A", 200), leg(3, "N2", "A", "B", 0), leg(4, None, "A", "B", 0)]
    missed = [
        leg(5, "N1", "B", "C", 100), leg(6, "N1", "B", "C", 300), leg(7, "N2", "B", "A", 50), leg(8, "N3", "A", "B", 9),
        leg(1, "N1", "A", "B", 0), leg(5, "N1", "B", "C", 100), leg(9, "N2", "A", "C", None),
    ]
    got = rot.cancellation_after_break(spark.createDataFrame(flown, LEGS), spark.createDataFrame(missed, LEGS))
    assert {r.rotation: (r.scheduled, r.cancelled) for r in got.collect()} == {
        "first": (3, 1),  # 1, 3, 8
        "whole": (2, 2),  # 5, 7
        "broken": (2, 1),  # 2, 6
        "untracked": (2, 1),  # 4, 9
    }


def test_no_legs(spark):
    none = spark.createDataFrame([], LEGS)
    linked = rot.rotations(none)
    assert linked.count() == rot.propagated_delay(linked).count() == rot.cancellation_after_break(none, none).count() == 0

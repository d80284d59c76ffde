import datetime as dt
import random
from itertools import product

import pytest

from skyloom.operators import network as net

ROUTE = "origin string, dest string, flights bigint, carriers bigint, first_date date, last_date date"


def route_table(spark, pairs, flights=None):
    day = dt.date(2025, 7, 18)
    return spark.createDataFrame(
        [(a, b, (flights or {}).get((a, b), 10), 1, day, day) for a, b in pairs], ROUTE
    )


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    names = [a + b + "X" for a, b in product("ABC", "DEFG")]
    return sorted({tuple(rng.sample(names, 2)) for _ in range(26)})


def walks(pairs, origin, legs):
    level = {origin}
    for _ in range(legs):
        level = {b for a in level for x, b in pairs if x == a}
    return level


def paths(pairs, origin, dest, k):
    out = [[origin]]
    for _ in range(k):
        out = [p + [b] for p in out for a, b in pairs if a == p[-1]]
        yield from (p for p in out if p[-1] == dest)


def test_reach_counts_walks(spark, pairs):
    got = {r.origin: (r.within_1, r.within_2, r.within_3) for r in net.reach_counts(route_table(spark, pairs), 3).collect()}
    for origin in {a for a, _ in pairs}:
        steps = [walks(pairs, origin, k) for k in (1, 2, 3)]
        assert got[origin] == (len(steps[0]), len(steps[0] | steps[1]), len(set().union(*steps)))


def test_thick_routes_prune_each_step(spark, pairs):
    flights = {p: 1000 if i % 2 else 5 for i, p in enumerate(pairs)}
    thick = [p for p in pairs if flights[p] >= 500]
    table = route_table(spark, pairs, flights)
    origin = thick[0][0]
    row = net.reach_counts(table, 2, [origin], min_flights=500).first()
    assert row.within_2 == len(walks(thick, origin, 1) | walks(thick, origin, 2))


def test_fewest_legs(spark, pairs):
    rows = {(r.origin, r.dest): (r.legs, r.route) for r in net.fewest_legs(route_table(spark, pairs)).collect()}
    names = {x for p in pairs for x in p}
    for origin in {a for a, _ in pairs}:
        for dest in names - {origin}:
            best = next(
                ((k, min(">".join(p) for p in ps)) for k in range(1, 9) if (ps := [p for p in paths(pairs, origin, dest, k) if len(p) == k + 1])),
                None,
            )
            assert rows.get((origin, dest)) == best
    assert max(legs for legs, _ in rows.values()) >= 3


def test_fewest_legs_long_line_and_one_target(spark):
    names = [f"N{i:02d}" for i in range(9)]
    table = route_table(spark, list(zip(names, names[1:])))
    (row,) = net.fewest_legs(table, ["N00"], "N06").collect()
    assert (row.legs, row.route) == (6, ">".join(names[:7]))
    assert net.fewest_legs(table, ["N08"], "N00").count() == 0


def test_path_modes(spark, pairs):
    pairs = sorted({*pairs, *((b, a) for a, b in pairs[:8])})  # there and back again
    table = route_table(spark, pairs)
    names = sorted({x for p in pairs for x in p})
    origin, dest = max(
        ((a, b) for a in names for b in names if a != b), key=lambda ab: len(list(paths(pairs, *ab, 4)))
    )
    every = list(paths(pairs, origin, dest, 4))
    trail = [p for p in every if len(set(zip(p, p[1:]))) == len(p) - 1]
    acyclic = [p for p in every if len(set(p)) == len(p)]
    get = lambda df: sorted(">".join(r.route) for r in df.collect())
    text = lambda ps: sorted(">".join(p) for p in ps)
    assert get(net.walk_paths(table, origin, dest, 4)) == text(every)
    assert get(net.trail_paths(table, origin, dest, 4)) == text(trail)
    assert get(net.acyclic_routes(table, origin, dest, 4, limit=None)) == text(acyclic)
    assert len(every) > len(trail) >= len(acyclic)
    ranked = net.acyclic_routes(table, origin, dest, 4, limit=2).collect()
    assert [r.legs for r in ranked] == sorted(len(p) - 1 for p in acyclic)[:2]


def test_routes_cover_all_dates_and_known_ends(spark):
    days = [dt.date(2025, 7, d) for d in (14, 16, 15)]
    legs = spark.createDataFrame(
        [(days[0], "AA", "LGA", "DFW"), (days[1], "AA", "LGA", "DFW"), (days[2], "DL", "LGA", "DFW"), (days[0], "AA", "DFW", "LGA"), (days[0], "AA", "DFW", "XXX")],
        "flightdate date, reporting_airline string, origin string, dest string",
    )
    got = {(r.origin, r.dest): (r.flights, r.carriers, r.first_date, r.last_date) for r in net.routes(legs).collect()}
    assert got[("LGA", "DFW")] == (3, 2, days[0], days[1]) and len(got) == 3
    known = spark.createDataFrame([("LGA",), ("DFW",)], "code string")
    assert net.routes(legs, known).count() == 2
    row = net.route_uniqueness(net.routes(legs)).first()
    assert row.edges == row.distinct_pairs == 3


def test_route_network_overstates_hubs(spark, make_legs):
    from test_connections import OFFSETS

    from skyloom.operators.connections import build_connections

    rows = [
        ("AA", 1, "LGA", "ATL", "08:00", 120), ("AA", 2, "ATL", "DFW", "11:00", 120),  # bookable
        ("AA", 3, "LGA", "DEN", "08:00", 240), ("DL", 4, "DEN", "DFW", "12:00", 120),  # other carrier
    ]
    legs = make_legs(rows, OFFSETS)
    got = net.hub_overstatement(net.routes(legs), build_connections(legs)).collect()
    assert [(r.origin, r.dest, r.claimed_hubs, r.timed_hubs) for r in got] == [("LGA", "DFW", 2, 1)]

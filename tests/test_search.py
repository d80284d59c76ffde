import datetime as dt

import pytest
from conftest import DAY, clock
from test_connections import OFFSETS, brute, schedule, utc

from skyloom.operators import connections as conn
from skyloom.operators import requests as req
from skyloom.operators import search as srch
from skyloom.storage import stage

REQUEST = "request_id string, origin string, dest string, date string, depart_after string, arrive_before string, max_stops int, min_stops int, limit int"


def requests(spark, rows):
    full = [(*r, *(None,) * (9 - len(r))) for r in rows]
    return spark.createDataFrame(full, REQUEST)


@pytest.fixture(scope="module")
def rows():
    return schedule(330, seed=11, days=2)


@pytest.fixture
def world(make_legs, rows):
    legs = stage(make_legs(rows, OFFSETS), "legs")
    return legs, stage(conn.build_connections(legs), "connections")


def brute_paths(rows, max_stops):
    """Every acyclic chain, by plain recursion."""
    legs = {r[1]: r for r in rows}
    nexts = {}
    for _, a, b, lay in brute(rows):
        nexts.setdefault(a, []).append((b, lay))
    out = []

    def grow(path, route, lays):
        out.append((path, route, lays))
        if len(path) <= max_stops:
            for b, lay in nexts.get(path[-1], []):
                if legs[b][3] not in route:
                    grow([*path, b], [*route, legs[b][3]], [*lays, lay])

    for r in rows:
        grow([r[1]], [r[2], r[3]], [])
    return legs, out


def expected(rows, origin, dest, day, max_stops, min_stops=0, limit=20, after=None, before=None):
    legs, paths = brute_paths(rows, max_stops)
    hits = []
    for path, route, lays in paths:
        first, last = legs[path[0]], legs[path[-1]]
        if first[6] != day or route[0] != origin or route[-1] != dest or len(path) - 1 < min_stops:
            continue
        departs = utc(first)[0] + dt.timedelta(minutes=OFFSETS[origin])
        arrives = utc(last)[1] + dt.timedelta(minutes=OFFSETS[dest])
        if (after and departs < after) or (before and arrives >= before):
            continue
        total = sum(legs[n][5] for n in path) + sum(lays)
        text = ">".join(f"{legs[n][0]}|{n}" for n in path)
        flights = [f"{legs[n][0]}{n}" for n in path]
        hits.append((total, utc(first)[0], text, flights, route, lays, departs, arrives))
    return [(h[0], h[3], h[4], h[5], h[6], h[7]) for h in sorted(hits, key=lambda h: h[:3])[:limit]]


def answers(df, request_id):
    got = df.filter((df.request_id == request_id) & df["rank"].isNotNull()).orderBy("rank").collect()
    return [(r.total_minutes, r.flights, r.route, r.layover_minutes, r.departs, r.arrives) for r in got]


def test_batch_equals_brute_force(spark, world, rows):
    legs, edges = world
    asks = [
        ("a", "LGA", "DFW", str(DAY), None, None, 3, 0, 50),
        ("b", "LGA", "HNL", str(DAY), "08:00", None, 2, 0, 5),
        ("c", "GUM", "ATL", str(DAY), None, f"{DAY}T23:30", 3, 1, 40),
        ("d", "DEN", "LGA", "2025-07-19", "06:30", "21:00", 1, 0, 20),
        ("e", "ATL", "DEN", str(DAY), None, None, 0, 0, 20),
        ("f", "LGA", "DFW", str(DAY), None, None, 3, 0, 50),  # same as a
    ]
    found = stage(srch.search(requests(spark, asks), legs, edges), "found")
    for ask in asks:
        rid, o, d, day, after, before, top, low, limit = ask
        day = dt.date.fromisoformat(day)
        after = after and clock(after, day)
        before = before and (dt.datetime.fromisoformat(before) if "T" in before else clock(before, day))
        want = expected(rows, o, d, day, top, low, limit, after, before)
        assert answers(found, rid) == want, rid
        assert want or rid in "bd"
    audit = srch.itinerary_audit(found).first()
    assert audit.itineraries > 0 and sum(audit[1:]) == 0


def test_guard_removes_cycles_that_exist(world, rows):
    legs, edges = world
    census = {r.stops: r for r in srch.cyclic_census(legs, edges, 3).filter(f"flightdate = '{DAY}'").collect()}
    assert census[1].cyclic == 0  # the edge itself forbids turning back
    assert census[3].cyclic > 0 and census[3].back_to_origin > 0
    assert all(r.broken == 0 and r.chains > 0 for r in srch.chain_check(legs, edges, 3).collect())
    legs_by, paths = brute_paths(rows, 3)
    acyclic = sum(1 for p, r, _ in paths if len(p) == 4 and legs_by[p[0]][6] == DAY)
    assert census[3].chains - census[3].cyclic == acyclic


def test_three_leg_cycle_passes_pairwise_and_is_removed(spark, make_legs):
    offsets = {"LGA": -240, "MIA": -240, "CLT": -240, "DFW": -300}
    rows = [("AA", 1, "LGA", "MIA", "06:00", 180), ("AA", 2, "MIA", "CLT", "10:00", 120),
            ("AA", 3, "CLT", "LGA", "13:00", 120), ("AA", 4, "LGA", "DFW", "16:00", 240)]
    legs = make_legs(rows, offsets)
    edges = conn.build_connections(legs)
    assert edges.count() == 3
    found = srch.search(requests(spark, [("x", "LGA", "DFW", str(DAY), None, None, 3)]), legs, edges)
    assert [r.flights for r in found.collect()] == [["AA4"]]
    unguarded = {r.stops: r.back_to_origin for r in srch.cyclic_census(legs, edges, 3, "LGA", "DFW").collect()}
    assert unguarded[3] == 1


def test_statuses(spark, world):
    legs, edges = world
    other = edges.filter(edges.flightdate == str(DAY))
    rows = [
        ("ok", " lga ", "dfw", str(DAY)),
        ("late", "LGA", "DFW", "2025-07-19"),
        ("direct", "LGA", "DFW", "2025-07-19", None, None, 0),
        ("none", "LGA", "DFW", "2024-01-01", None, None, 0),
        ("gone", "LGA", "XXX", str(DAY)),
        ("bad", "LG", "DFW", str(DAY)),
        ("same", "LGA", "lga", str(DAY)),
    ]
    found = srch.search(requests(spark, rows), legs, other)
    got = {r.request_id: (r.status, r.error, r.searchable) for r in found.collect()}
    assert got == {
        "ok": ("ok", None, True),
        "late": ("not_built", None, False),
        "direct": ("ok", None, False),
        "none": ("empty", None, False),
        "gone": ("empty", None, True),
        "bad": ("bad_request", "origin", True),
        "same": ("bad_request", "same_airport", True),
    }


def test_only_refused_requests(spark, world):
    legs, edges = world
    found = srch.search(requests(spark, [("x", "LG", "DFW", str(DAY))]), legs, edges).collect()
    assert [(r.request_id, r.status) for r in found] == [("x", "bad_request")]


def test_deadline_and_overnight(spark, make_legs):
    rows = [("AA", 983, "LGA", "ATL", "21:51", 147), ("AA", 2, "LGA", "ATL", "10:00", 150)]
    legs = make_legs(rows, OFFSETS)
    edges = conn.build_connections(make_legs(rows + [("AA", 3, "ATL", "DFW", "14:00", 100)], OFFSETS))
    found = srch.search(requests(spark, [("x", "LGA", "ATL", str(DAY), None, "15:00", 2)]), legs, edges)
    assert [r.flights for r in found.collect()] == [["AA2"]]  # 00:18 lands the next day
    late = srch.search(requests(spark, [("x", "LGA", "ATL", str(DAY), None, "2025-07-19 01:00", 2)]), legs, edges)
    assert late.count() == 2


def test_null_block_ranks_last(spark, make_legs):
    rows = [("AA", 1, "LGA", "ATL", "08:00", 150), ("AA", 2, "LGA", "ATL", "07:00", None)]
    legs = make_legs(rows, OFFSETS)
    edges = conn.build_connections(legs)
    found = srch.search(requests(spark, [("x", "LGA", "ATL", str(DAY), None, None, 0)]), legs, edges)
    got = found.orderBy("rank").collect()
    assert [(r.flights, r.total_minutes) for r in got] == [(["AA1"], 150), (["AA2"], None)]


def test_counts_and_text(spark, world, rows):
    legs, edges = world
    got = {(r.flightdate, r.origin, r.dest, r.stops): r.itineraries for r in srch.itinerary_counts(legs, edges, 2).collect()}
    by_leg, paths = brute_paths(rows, 2)
    want = {}
    for path, route, _ in paths:
        key = (by_leg[path[0]][6], route[0], route[-1], len(path) - 1)
        want[key] = want.get(key, 0) + 1
    assert got == want
    found = srch.search(requests(spark, [("x", "LGA", "DFW", str(DAY), None, None, 1, 0, 1)]), legs, edges)
    row, text = found.first(), srch.as_text(found).first()
    assert text.departs == row.departs.isoformat() and text.arrives_utc == row.arrives_utc.isoformat()


def test_rankings(spark, world):
    legs, edges = world
    found = stage(srch.search(requests(spark, [("x", "LGA", "DFW", str(DAY), None, None, 2)]), legs, edges), "f")
    stops = [r.stops for r in srch.by_stops(found).orderBy("rank").collect()]
    assert stops == sorted(stops) and len(set(stops)) > 1
    arrivals = [r.arrives_utc for r in srch.by_arrival(found).orderBy("rank").collect()]
    assert arrivals == sorted(arrivals)


@pytest.mark.parametrize(
    "change, error",
    [
        ({"origin": ""}, "origin"), ({"origin": "  "}, "origin"), ({"origin": "L"}, "origin"),
        ({"origin": "LGAX"}, "origin"), ({"origin": "LG1"}, "origin"), ({"dest": "12"}, "dest"),
        ({"dest": None}, "dest"), ({"dest": "lga"}, "same_airport"), ({"date": "18/07/2025"}, "date"),
        ({"date": "2025-13-01"}, "date"), ({"date": "July 18"}, "date"), ({"date": "2025-02-30"}, "date"),
        ({"depart_after": "9am"}, "depart_after"), ({"depart_after": "25:00"}, "depart_after"),
        ({"depart_after": "noon"}, "depart_after"), ({"depart_after": "9"}, "depart_after"),
        ({"depart_after": ""}, "depart_after"), ({"arrive_before": "2025-07-18T24:00"}, "arrive_before"),
        ({"arrive_before": "2025-02-30T10:00"}, "arrive_before"), ({"limit": 0}, "limit"),
        ({"min_stops": 3, "max_stops": 2}, "stops"), ({"min_stops": -1}, "stops"),
        ({"max_stops": 4}, "max_stops_cap"), ({"limit": 101}, "limit_cap"), ({}, None),
        ({"date": " 2025-7-18 "}, None), ({"depart_after": "9:05"}, None),
    ],
)
def test_request_faults(spark, change, error):
    base = {"request_id": "x", "origin": "LGA", "dest": "DFW", "date": "2025-07-18", "depart_after": None,
            "arrive_before": None, "max_stops": 2, "min_stops": 0, "limit": 20}
    row = {**base, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in REQUEST.split(", "))], REQUEST)
    assert req.normalise_requests(df, served=True).first().error == error


def test_bounds_and_defaults(spark):
    df = requests(
        spark,
        [
            ("a", "lga", "dfw", "2025-07-18", "09:00", "2025-07-19T01:30:15"),
            ("b", "lga", "dfw", "2025-07-18", " 9:00:30 ", "2025-07-19 01:30"),
        ],
    )
    a, b = req.normalise_requests(df).orderBy("request_id").collect()
    assert (a.depart_after, a.arrive_before) == (clock("09:00"), dt.datetime(2025, 7, 19, 1, 30, 15))
    assert (b.depart_after, b.arrive_before) == (dt.datetime(2025, 7, 18, 9, 0, 30), dt.datetime(2025, 7, 19, 1, 30))
    assert (a.min_stops, a.max_stops, a.limit, a.origin) == (0, 2, 20, "LGA")
    four = spark.createDataFrame([("a", "LGA", "DFW", "2025-07-18")], "request_id string, origin string, dest string, date string")
    assert req.normalise_requests(four).first().error is None
    no_cap = requests(spark, [("a", "LGA", "DFW", "2025-07-18", None, None, 4, 0, 500)])
    assert req.normalise_requests(no_cap).first().error is None


def test_workload_repeats(spark, world):
    legs, edges = world
    dates = conn.searchable_dates(edges)
    full = req.request_workload(legs, dates, max_stops=1)
    assert full.count() == 6 * 5 * 2 and set(full.columns) >= {"request_id", "origin", "dest", "date", "max_stops"}
    one = [r.request_id for r in req.request_workload(legs, dates, sample=7, seed=1).collect()]
    two = [r.request_id for r in req.request_workload(legs, dates, sample=7, seed=1).collect()]
    three = [r.request_id for r in req.request_workload(legs, dates, sample=7, seed=2).collect()]
    assert sorted(one) == sorted(two) != sorted(three)
    assert req.busiest_origins(legs, DAY, top=2).count() == 2


@pytest.mark.parametrize("max_stops", [1, 2, 3])
def test_bounds_change_no_answer(spark, world, monkeypatch, max_stops):
    """Answers found with bounds equal those without; requests of other stops, limits and times share starts."""
    legs, connections = world
    pool = sorted(r[0] for r in legs.select("origin").distinct().collect())
    asked = [(f"{o}{d}", o, d, str(DAY)) for o in pool for d in pool if o != d]
    asked += [(f"late-{o}{d}", o, d, str(DAY), "09:00", "23:00", max_stops, 1, 2) for o in pool[:4] for d in pool if o != d]
    table = requests(spark, [(*r, *([None, None, max_stops, 0, 3] if len(r) == 4 else [])) for r in asked])
    plain = sorted(map(str, srch.search(table, legs, connections).collect()))
    monkeypatch.setattr(srch, "BOUNDED_FROM", 0)
    monkeypatch.setattr(srch, "BOUND_SHARE", 2)
    bounded = sorted(map(str, srch.search(table, legs, connections).collect()))
    assert bounded == plain and len(plain) > len(pool)


def test_bounds_cut_paths_before_they_are_ranked(spark, world):
    """With a bound on every pair fewer paths are grown, and those within it are all there."""
    legs, connections = world
    starts = legs.select("flightdate", "origin").distinct().selectExpr("*", "cast(null as timestamp_ntz) as earliest", "2 as deepest")
    wanted = legs.select("flightdate", "dest").distinct()
    whole = srch.chains(starts, wanted, legs, connections, 2, mixed=False)
    pairs = starts.join(wanted, "flightdate").selectExpr("flightdate", "origin as start", "dest", "400 as bound").filter("start <> dest")
    limits = srch.Limits(pairs, connections, 2)
    cut = srch.chains(starts, wanted, legs, connections, 2, False, limits)
    for stops in (1, 2):
        short = lambda level: sorted(r[0] for r in level.filter("air_minutes + waiting <= 400").select("legs").collect())
        assert short(cut[stops]) == short(whole[stops])
        assert cut[stops].count() < whole[stops].count()


@pytest.mark.parametrize("max_stops", [1, 2, 3])
def test_counted_itineraries_equal_listed_ones(world, max_stops):
    legs, connections = world
    starts = legs.select("flightdate", "origin").distinct().selectExpr("*", "cast(null as timestamp_ntz) as earliest", f"{max_stops} as deepest")
    wanted = legs.select("flightdate", "dest").distinct()
    found = {}
    for stops, level in enumerate(srch.chains(starts, wanted, legs, connections, max_stops, mixed=False)):
        for r in level.selectExpr("flightdate", "start", "at", "air_minutes + waiting as m").collect():
            n, best = found.get((r[0], r[1], r[2], stops), (0, None))
            found[r[0], r[1], r[2], stops] = n + 1, r[3] if best is None or (r[3] is not None and r[3] < best) else best
    rows = srch.itinerary_counts(legs, connections, max_stops).collect()
    assert {(r.flightdate, r.origin, r.dest, r.stops): (r.itineraries, r.best_minutes) for r in rows} == found

"""Plans and bounds that keep what is shuffled, spilled and written in step with the input."""

import datetime as dt
import random

import pytest
from conftest import DAY
from test_connections import OFFSETS
from test_plans import plan
from test_rotations import LEGS, brute_delays, random_legs
from test_search import answers, expected, requests, rows, world  # noqa: F401

from skyloom.operators import rotations as rot
from skyloom.operators import search as srch
from skyloom.sources.fleet_records import fleet_records
from skyloom.sources.order_records import order_records
from skyloom.sources.tables import one_per_key
from skyloom.storage import stage

LINES = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string"


@pytest.fixture
def orders(spark, tmp_path):
    """Lines that repeat, lack a number or belong to orders of one line; flags beside A and R."""
    rng = random.Random(3)
    lines = [
        (i // 3, rng.choice([1, 2, 2, 5, None]), 100 + i % 90, i % 8, float(rng.choice([1, 2, 3, 20, 50])), rng.choice(["", "A", "B", "N", "R", "Z", None]))
        for i in range(600)
    ]
    lines += [(None, 1, 1, 1, 5.0, "A"), (500, 4, 1, 1, 5.0, "R"), (500, 4, 2, 1, 7.0, "R"), (501, 1, 1, 1, 5.0, "R")]
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(600).selectExpr("id as o_orderkey", "id % 7 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(8).selectExpr("id as s_suppkey", "id as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(7).selectExpr("id as c_custkey", "id + 9 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path), lines


def test_records_are_made_without_sorting_every_line(spark, orders):
    """Minima and sets of text or lists are kept by sorting; those of numbers in a hash table."""
    for records in (order_records, fleet_records):
        text = plan(records(spark, orders[0]))
        assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_flags_keep_their_order(spark, orders):
    """A line is cancelled by its smallest flag, whatever other flags there are."""
    least = {}
    for ok, ln, _, _, qty, flag in orders[1]:
        if ok is not None:
            x = least.setdefault((ok * 10 + ln if ln else None, ok), [None, None])
            for i, v in enumerate((qty, flag)):
                x[i] = v if x[i] is None else x[i] if v is None else min(x[i], v)
    want = [(k[0] or -1, 1.0 if q == 50 else None if q == 1 and f == "A" else 0.0, q == 2 and f in ("R", None)) for k, (q, f) in least.items()]
    got = order_records(spark, orders[0]).collect()
    key = lambda x: (x[0], str(x[1:]))
    assert sorted(((r.flight_number_reporting_airline or -1, r.cancelled, r.crselapsedtime is None) for r in got), key=key) == sorted(want, key=key)


def test_fleet_lines_are_numbered_by_distinct_line(spark, orders):
    lines = {}
    for ok, ln, *_ in orders[1]:
        lines.setdefault(ok, set()).add(ln)
    got = fleet_records(spark, orders[0]).filter("flight_number_reporting_airline is not null").collect()
    assert len(got) == sum(ok is not None and ln is not None for ok, ln, *_ in orders[1])
    start = dt.datetime(2025, 7, 1)
    for r in got:
        ok, ln = divmod(r.flight_number_reporting_airline, 10)
        k = sorted(x for x in lines[ok] if x).index(ln)
        base = 5 * ((ok // 62) % 5)
        minute = (ok % 62) * 1440 + 300 + 60 * (3 + base % 7) + k * 180 + (ok * 13 + ln * 7) % 60
        clock = r.crsdeptime.hour * 60 + r.crsdeptime.minute
        days = (r.flightdate - start).days * 1440
        assert (days + clock - minute) % 60 == 0 and abs(days + clock - minute) <= 540
        away = len(lines.get(ok - 1, set()) - {None}) == 1 and ok % 62 > 0 and k == 0
        qty = {q for o, n, _, _, q, _ in orders[1] if (o, n) == (ok, ln)}
        assert r.cancelled in {1.0 if q == 50 or (away and q <= 20) else 0.0 for q in qty}


def test_one_per_key_sorts_after_the_shuffle_only(spark):
    df = spark.range(100).selectExpr("id % 7 as k", "cast(id as string) as v")
    lines = plan(one_per_key(df, ["k"])).splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(shuffles) == 1
    assert not any("Sort" in line for line in lines[shuffles[0] :])
    assert {(r.k, r.v) for r in one_per_key(df, ["k"]).collect()} == {(k, min(str(i) for i in range(k, 100, 7))) for k in range(7)}


def test_rotations_deal_out_each_leg_once(spark):
    """One window along an aircraft; neither the leg's text nor a copy of the row is shuffled."""
    from skyloom.operators.ordered import with_previous

    df = spark.range(50).selectExpr("id", "id % 3 as key", "timestamp_ntz'2025-07-14' as at")
    lines = plan(with_previous(df, "key", "at", ["id"], ["id", "at"])).splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(shuffles) == 1
    assert not any("struct" in line for line in lines[shuffles[0] : shuffles[0] + 3])


@pytest.mark.parametrize("hot_rows", [1, 60, 10_000])
def test_delays_of_hot_aircraft(spark, hot_rows):
    legs = random_legs(300)
    linked = rot.rotations(spark.createDataFrame(legs, LEGS), hot_rows=hot_rows)
    got = rot.propagated_delay(linked, hot_rows=hot_rows).collect()
    assert {int(r.leg.split("|")[1]): (r.own, r.handed_on, r.total) for r in got} == brute_delays(legs, rot.MIN_TURN)
    assert len(got) == len(brute_delays(legs, rot.MIN_TURN))


def test_delays_are_handed_on_without_rounds(spark, monkeypatch):
    """Rounds wrote every leg once for each doubling of the longest chain."""
    linked = rot.rotations(spark.createDataFrame(random_legs(100), LEGS))
    written = []
    monkeypatch.setattr(rot, "stage", lambda df, name, *a: written.append(name) or stage(df, name, *a))
    rot.propagated_delay(linked).count()
    assert written == []


def test_deadlines_bound_the_paths(spark, world, rows, monkeypatch):  # noqa: F811
    """Answers are those of all paths, and what lands too late is not written."""
    legs, edges = world
    asks = [
        (f"{o}{d}", o, d, str(DAY), None, before, top, low, 3)
        for o, d in (("LGA", "DFW"), ("GUM", "ATL"), ("DEN", "LGA"), ("HNL", "LGA"), ("LGA", "HNL"))
        for before, top, low in (("12:00", 2, 1),)
    ] + [("x", "ATL", "DEN", str(DAY), "06:00", f"{DAY}T15:00", 3, 0, 5)]
    monkeypatch.setattr(srch, "BOUNDED_FROM", 0)
    sizes = {}

    def staged(df, name, *a):
        sizes[name] = stage(df, name, *a)
        return sizes[name]

    monkeypatch.setattr(srch, "stage", staged)
    found = stage(srch.search(requests(spark, asks), legs, edges), "found")
    for rid, o, d, _, after, before, top, low, limit in asks:
        at = dt.datetime.combine(DAY, dt.time(15 if "T" in before else int(before[:2])))
        want = expected(rows, o, d, DAY, top, low, limit, after and dt.datetime.combine(DAY, dt.time(6)), at)
        assert answers(found, rid) == want, rid
    latest = dt.datetime.combine(DAY, dt.time(15)) - dt.timedelta(minutes=min(OFFSETS.values()))
    for k in (1, 2):
        assert sizes[f"paths-{k}"].filter(sizes[f"paths-{k}"].arrives_utc > latest).count() == 0


def test_a_spec_without_deadline_keeps_late_paths(spark, world, rows, monkeypatch):  # noqa: F811
    legs, edges = world
    monkeypatch.setattr(srch, "BOUNDED_FROM", 0)
    asks = [("early", "LGA", "DFW", str(DAY), None, "09:00", 2, 0, 9), ("any", "DEN", "DFW", str(DAY), None, None, 2, 0, 9)]
    found = stage(srch.search(requests(spark, asks), legs, edges), "found")
    nine = dt.datetime.combine(DAY, dt.time(9))
    assert answers(found, "early") == expected(rows, "LGA", "DFW", DAY, 2, 0, 9, None, nine)
    assert answers(found, "any") == expected(rows, "DEN", "DFW", DAY, 2, 0, 9)


def _all_pairs(spark, legs, day=DAY, **more):
    pool = sorted(r[0] for r in legs.select("origin").distinct().collect())
    return requests(spark, [(f"{o}{d}", o, d, str(day), more.get("after"), more.get("before"), 2, more.get("low", 0), 3) for o in pool for d in pool if o != d])


def _staged(monkeypatch):
    """Rows of each table that a search writes, the last of a name."""
    sizes = {}

    def staged(df, name, *a):
        table = stage(df, name, *a)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(srch, "stage", staged)
    return sizes


@pytest.mark.parametrize("more", [{}, {"after": "08:00"}, {"before": "15:00", "low": 1}])
def test_bounds_of_airports_and_times_leave_few_paths(spark, world, monkeypatch, more):  # noqa: F811
    """a pair that has no answer, or one at other times only, lets no path through."""
    legs, edges = world
    table = _all_pairs(spark, legs, **more)
    plain = sorted(map(str, srch.search(table, legs, edges).collect()))
    sizes = _staged(monkeypatch)
    for name, value in {"BOUNDED_FROM": 0, "BOUND_SHARE": 1, "FIRST_SHARE": 1}.items():
        monkeypatch.setattr(srch, name, value)
    assert sorted(map(str, srch.search(table, legs, edges).collect())) == plain
    day = edges.filter(edges.flightdate == str(DAY)).count()
    assert 0 < sizes["useful-connections"] < 0.5 * day
    assert sizes["paths-1"] < 0.4 * day


def test_ties_are_bounded_by_departure(spark, make_legs, monkeypatch):
    """Of legs that take equally long, only the earliest are ranked."""
    rows = [("AA", i, "LGA", "ATL", f"{6 + i // 60:02d}:{i % 60:02d}", 150) for i in range(300)]
    rows += [("AA", 900, "ATL", "DFW", "17:00", 100), ("AA", 901, "LGA", "ATL", "05:00", None)]
    legs = make_legs(rows, OFFSETS)
    levels = [srch.first_legs(legs, legs.selectExpr("flightdate", "origin", "cast(null as timestamp_ntz) as earliest", "0 as deepest").distinct())]
    ask = spark.sql(
        f"select 0L as spec, date'{DAY}' as flightdate, 'LGA' as start, 'ATL' as at, cast(null as timestamp_ntz) as depart_after,"
        " cast(null as timestamp_ntz) as arrive_before, 0 as min_stops, 0 as max_stops, 5 as limit"
    )
    bound = srch._bounds(srch._found(levels, ask))
    assert bound.count() == 1
    found = srch._found(levels, ask.join(bound, "spec"))
    assert sorted(r.legs for r in found.collect()) == [f"AA|{i}" for i in range(5)]


def test_slots_are_minutes_of_zone_less_times(spark):
    from skyloom.functions.times import epoch_minute

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        text = "timestamp_ntz'2025-03-09 02:30:59' as a, timestamp_ntz'1969-12-31 23:58:00' as b, cast(null as timestamp_ntz) as c"
        got = spark.sql(f"select {text}").select(epoch_minute("a"), epoch_minute("b"), epoch_minute("c")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == (29024790, -2, None)


def test_legs_whose_times_are_not_their_block_apart(spark, world, monkeypatch):  # noqa: F811
    """Bounds by time hold for legs with the block time between their UTC times; others are searched without."""
    legs, edges = world
    assert srch._block_apart(legs)
    odd = legs.withColumn("scheduled_duration_minutes", legs.scheduled_duration_minutes + 400)
    assert not srch._block_apart(odd)
    table = _all_pairs(spark, legs)
    plain = sorted(map(str, srch.search(table, odd, edges).collect()))
    monkeypatch.setattr(srch, "BOUNDED_FROM", 0)
    assert sorted(map(str, srch.search(table, odd, edges).collect())) == plain


def brute_census(edges, legs, origin=None, dest=None):
    """date, stops -> chains, cyclic, back to origin, listed one by one."""
    nexts, found = {}, {}
    for e in edges:
        nexts.setdefault((e.flightdate, e.from_leg), []).append(e)

    def count(day, route):
        if dest in (None, route[-1]):
            x = found.setdefault((day, len(route) - 2), [0, 0, 0])
            x[0] += 1
            x[1] += len(set(route)) < len(route)
            x[2] += route[0] in route[1:]

    def grow(day, last, route):
        if len(route) < 5:
            for e in nexts.get((day, last), []):
                count(day, [*route, e.to_dest])
                grow(day, e.to_leg, [*route, e.to_dest])

    for r in legs:
        if origin in (None, r.origin):
            count(r.flightdate, [r.origin, r.dest])
    for e in edges:
        if origin in (None, e.from_origin):
            count(e.flightdate, [e.from_origin, e.hub, e.to_dest])
            grow(e.flightdate, e.to_leg, [e.from_origin, e.hub, e.to_dest])
    return {k: tuple(v) for k, v in found.items()}


@pytest.mark.parametrize("ends", [(), ("LGA", "DFW"), ("ATL", None), (None, "LGA")])
@pytest.mark.parametrize("max_stops", [0, 1, 2, 3])
def test_census_equals_listed_chains(world, max_stops, ends):  # noqa: F811
    legs, edges = world
    got = srch.cyclic_census(legs, edges, max_stops, *ends)
    assert got.columns == ["flightdate", "stops", "chains", "cyclic", "back_to_origin"]
    want = {k: v for k, v in brute_census(edges.collect(), legs.collect(), *ends).items() if k[1] <= max_stops}
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == want


def test_census_deals_out_few_rows_and_writes_none(world, monkeypatch):  # noqa: F811
    """it wrote them, and two tables of chains, and dealt them out a dozen times."""
    legs, edges = world
    written = []
    monkeypatch.setattr(srch, "stage", lambda df, name, *a: written.append(name) or stage(df, name, *a))
    census = srch.cyclic_census(legs, edges, 3)
    assert written == []
    dealt = [line for line in plan(census).splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) <= 4 + 3  # connections by either leg, chains, what leads on; three sums per date

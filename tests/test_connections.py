import datetime as dt
import random

import pytest
from conftest import DAY

from skyloom.operators import connections as conn
from skyloom.operators import layovers, network
from skyloom.operators import rollups
from skyloom.schema import CARRIER_FAMILY

OFFSETS = {"LGA": -240, "ATL": -240, "DFW": -300, "DEN": -360, "HNL": -600, "GUM": 600}


def schedule(n=260, seed=7, hub_share=0.0, days=2):
    """Random legs; ``hub_share`` of them touch one airport, carrier and date."""
    rng = random.Random(seed)
    names, rows = list(OFFSETS), []
    for i in range(n):
        if rng.random() < hub_share:
            a, b = rng.choice([("LGA", "ATL"), ("ATL", "DFW"), ("DEN", "ATL")])
            carrier, day = "DL", DAY
        else:
            a, b = rng.sample(names, 2)
            carrier, day = rng.choice(["AA", "MQ", "DL", "OO"]), DAY + dt.timedelta(days=rng.randrange(days))
        dep = f"{rng.randrange(24):02d}:{rng.randrange(0, 60, 5):02d}"
        rows.append((carrier, i, a, b, dep, 60 + 15 * rng.randrange(12), day))
    return rows


def utc(row):
    carrier, number, a, b, dep, block, day = row
    hour, minute = map(int, dep.split(":"))
    start = dt.datetime.combine(day, dt.time(hour, minute)) - dt.timedelta(minutes=OFFSETS[a])
    return start, start + dt.timedelta(minutes=block)


def brute(rows, low=45, high=300, strict=False):
    fam = (lambda c: c) if strict else (lambda c: CARRIER_FAMILY.get(c, c))
    out = set()
    for x in rows:
        for y in rows:
            if x[6] != y[6] or x[3] != y[2] or fam(x[0]) != fam(y[0]) or y[3] == x[2]:
                continue
            lay = (utc(y)[0] - utc(x)[1]).total_seconds() // 60
            if low <= lay <= high:
                out.add((x[6], x[1], y[1], int(lay)))
    return out


def built(df):
    number = lambda leg: int(leg.split("|")[1])
    rows = df.collect()
    got = {(r.flightdate, number(r.from_leg), number(r.to_leg), r.layover_minutes) for r in rows}
    assert len(got) == len(rows)  # no pair twice
    return got


@pytest.mark.parametrize("low, high, strict", [(45, 300, False), (45, 300, True), (0, 10, False), (30, 1000, False)])
def test_matches_brute_force(make_legs, low, high, strict):
    rows = schedule()
    want = brute(rows, low, high, strict)
    got = built(conn.build_connections(make_legs(rows, OFFSETS), low, high, strict))
    assert want and got == want


@pytest.mark.parametrize("hot_rows", [3, 17])
def test_hot_group_is_split_and_stays_whole(make_legs, hot_rows):
    rows = schedule(400, seed=3, hub_share=0.5)
    legs = make_legs(rows, OFFSETS)
    want = brute(rows)
    df = conn.build_connections(legs, hot_rows=hot_rows)
    assert built(df) == want == built(conn.build_connections(legs))


def test_window_ends_backtrack_and_family(make_legs):
    rows = [("AA", 1, "LGA", "ATL", "06:00", 120)]  # lands 08:00
    rows += [("AA", 10 + m, "ATL", "DFW", dep, 120) for m, dep in enumerate(["08:44", "08:45", "13:00", "13:01"])]
    rows += [("AA", 20, "ATL", "LGA", "09:00", 120), ("MQ", 21, "ATL", "DFW", "09:00", 120), ("OO", 22, "ATL", "DFW", "09:00", 120)]
    edges = conn.build_connections(make_legs(rows, OFFSETS))
    assert sorted((r.to_flight, r.layover_minutes) for r in edges.collect()) == [("AA11", 45), ("AA12", 300), ("MQ21", 60)]
    audit = conn.carrier_edge_audit(edges).first()
    assert (audit.edges, audit.cross_family, audit.mismatched) == (3, 1, 0)
    strict = conn.build_connections(make_legs(rows, OFFSETS), strict_carrier=True)
    assert strict.count() == 2


def test_red_eye_does_not_meet_the_morning_before(make_legs):
    # DEN 23:15 and 200 minutes, two hours to the east: ATL at 04:35 of the next day. On the
    # clock alone, without its day, a leg that left ATL at 06:00 of the first day would follow.
    rows = [("DL", 61, "DEN", "ATL", "23:15", 200), ("DL", 62, "ATL", "LGA", "06:00", 130)]
    assert conn.build_connections(make_legs(rows, OFFSETS)).count() == 0


def test_equal_large_sides_are_cut_by_pairs(spark):
    """A group of as many arrivals as departures: no part may form more than hot_rows² pairs."""
    from skyloom.operators.connections import _hot_groups, _split

    side = spark.range(90).selectExpr("concat('leg', id) AS leg", "1 AS k").union(spark.createDataFrame([("x", 2)], "leg string, k int"))
    hot = _hot_groups(side, side, ["k"], 20)
    assert [(r.k, r.a_parts, r.d_parts) for r in hot.collect()] == [(1, 5, 5)]
    a = _split(side, hot, ["k"], "a", "d").groupBy("k", "a_part", "d_part").count()
    d = _split(side, hot, ["k"], "d", "a").groupBy("k", "a_part", "d_part").count()
    met = a.join(d.withColumnRenamed("count", "other"), ["k", "a_part", "d_part"]).collect()
    assert sum(r["count"] * r.other for r in met if r.k == 1) == 90 * 90
    assert max(r["count"] * r.other for r in met) <= 2 * 20 * 20 * 2


def test_invariants_catch_a_bad_edge(spark, make_legs):
    from pyspark.sql import functions as F

    legs = make_legs(schedule(), OFFSETS)
    edges = conn.build_connections(legs)
    row = conn.connection_invariants(edges, legs).first()
    assert row.edges > 0 and sum(row[1:]) == 0
    broken = edges.withColumn("layover_minutes", F.col("layover_minutes") + 400)
    row = conn.connection_invariants(broken, legs).first()
    assert row.outside_window > 0 and row.wrong_layover == row.edges and row.hub_mismatch == 0


def test_require_built_names_the_cause(spark, make_legs):
    from pyspark.sql import functions as F

    legs = make_legs(schedule(), OFFSETS)
    edges = conn.build_connections(legs)
    day = spark.createDataFrame([(DAY,)], "flightdate date")
    conn.require_built(edges, legs, day)
    missing = spark.createDataFrame([(dt.date(2024, 1, 1),)], "flightdate date")
    with pytest.raises(conn.BuildError, match="no legs"):
        conn.require_built(edges, legs, missing)
    raw = legs.withColumn("scheduled_departure_utc", F.lit(None).cast("timestamp_ntz"))
    with pytest.raises(conn.BuildError, match="no UTC times"):
        conn.require_built(conn.build_connections(raw), raw, day)
    assert conn.is_searchable(edges, DAY) and not conn.is_searchable(edges, "2024-01-01")
    assert conn.readiness(edges.limit(0)).first().ready is False
    with pytest.raises(ValueError):
        conn.build_connections(legs, 300, 45)


def local_pairs(rows, day, hub):
    for x in rows:
        for y in rows:
            if x[6] == y[6] == day and x[3] == y[2] == hub and y[3] != x[2]:
                lands = utc(x)[1] + dt.timedelta(minutes=OFFSETS[hub])
                leaves = utc(y)[0] + dt.timedelta(minutes=OFFSETS[hub])
                yield int((leaves - lands).total_seconds() // 60)


def test_pair_counts_without_forming_pairs(make_legs):
    rows = schedule(300, seed=5, days=1)
    legs = make_legs(rows, OFFSETS)
    got = {r.hub: r.pairs for r in layovers.hub_connections(legs).collect()}
    want = {h: sum(45 <= m <= 300 for m in local_pairs(rows, DAY, h)) for h in OFFSETS}
    assert got == {h: n for h, n in want.items() if n}
    row = layovers.negative_layovers(legs).first()
    every = [m for h in OFFSETS for m in local_pairs(rows, DAY, h)]
    assert (row.negative, row.total) == (sum(m < 0 for m in every), len(every)) and row.negative > 0


@pytest.mark.parametrize("seed", range(4))
def test_shortest_and_longest_layover(make_legs, seed):
    rows = schedule(40 + 60 * seed, seed=seed, days=1)
    got = {r.hub: (r.min_layover, r.max_layover, r.pairs) for r in layovers.hub_layover_stats(make_legs(rows, OFFSETS), ["ATL", "DFW", "DEN"]).collect()}
    want = {}
    for hub in ("ATL", "DFW", "DEN"):
        inside = [m for m in local_pairs(rows, DAY, hub) if 45 <= m <= 480]
        if inside:
            want[hub] = (min(inside), max(inside), len(inside))
    assert got == want


def test_one_stop_spills_into_the_next_day(make_legs):
    tomorrow = DAY + dt.timedelta(days=1)
    rows = [
        ("DL", 1, "LGA", "ATL", "20:00", 150, DAY),  # lands 22:30
        ("DL", 2, "ATL", "DFW", "00:30", 120, tomorrow),
        ("DL", 3, "ATL", "DFW", "23:45", 120, DAY),
        ("AA", 4, "ATL", "DFW", "23:50", 120, DAY),
        ("DL", 5, "LGA", "DFW", "08:00", 220, DAY),
    ]
    legs = make_legs(rows, OFFSETS)
    got = [(r.flights, r.via, r.layover, r.air_minutes) for r in layovers.one_stop(legs, "LGA", "DFW", DAY).collect()]
    assert got == [(["DL1", "DL2"], "ATL", 120, 270), (["DL1", "DL3"], "ATL", 75, 270)]
    assert layovers.one_stop(legs, "LGA", "DFW", DAY, interline=True).count() == 3
    assert layovers.one_stop(legs, "LGA", "DFW", DAY, limit=1).count() == 1


def test_rollups_over_connections(spark, make_legs):
    legs = make_legs(schedule(300, days=1), OFFSETS)
    edges = conn.build_connections(legs)
    total = edges.count()
    top = rollups.connecting_hubs(edges, top=10).collect()
    assert sum(r.connections for r in top) == total and abs(sum(r.share for r in top) - 1) < 1e-9
    assert rollups.thin_hubs(edges, below=10**9).first().share == 1.0
    assert all(r["rank"] <= 2 for r in rollups.carrier_hubs(edges, top=2).collect())
    known = spark.createDataFrame([(r.hub,) for r in top[1:]], "code string")
    assert [r.hub for r in rollups.unexpected_hubs(rollups.connecting_hubs(edges), known).collect()] == [top[0].hub]
    counts = rollups.entity_counts(legs, network.routes(legs), edges)
    got = {r.entity: r.n for r in counts.collect()}
    assert got["legs"] == got["departs_from"] == got["operated_by"] == 300 and got["connections"] == total
    low = rollups.below_floors(counts, {"legs": 301, "connections": total, "airports": 5}).collect()
    assert [r.entity for r in low] == ["legs"]
    pairs = network.two_stop_counts(edges).collect()
    by_leg = {}
    for r in edges.collect():
        by_leg.setdefault(r.from_leg, []).append(r)
    want = sum(1 for r in edges.collect() for q in by_leg.get(r.to_leg, []) if q.to_dest != r.from_origin)
    assert sum(r.paths for r in pairs) == want > 0
    only = network.connection_only_pairs(legs, edges).count()
    both = network.connection_only_pairs(legs, edges, nonstop=True).count()
    assert only + both == edges.select("flightdate", "from_origin", "to_dest").distinct().count()

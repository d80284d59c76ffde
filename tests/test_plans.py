"""The plans that make the jobs scale: pruning, pushdown, join kinds, bounded top-k."""

import re

import pytest
from conftest import DAY
from test_connections import OFFSETS, schedule

from skyloom.operators import connections as conn
from skyloom.operators import legs as leg
from skyloom.operators import network, requests, rollups
from skyloom.operators.search import solve_specs
from skyloom.storage import stage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(make_legs):
    legs = stage(make_legs(schedule(), OFFSETS), "legs", "flightdate")
    return legs, stage(conn.build_connections(legs), "connections", "flightdate")


def test_date_prunes_partitions_and_ends_are_pushed(stored):
    text = plan(leg.direct_flights(stored[0], "LGA", "DFW", DAY))
    assert re.search(r"PartitionFilters: \[[^\]]*flightdate#\d+ = 2025-07-18", text)
    assert "EqualTo(origin,LGA)" in text and "EqualTo(dest,DFW)" in text
    assert "tail_number" not in text


def test_half_open_range_prunes_partitions(stored):
    text = plan(leg.between_dates(stored[0], DAY, "2025-07-19"))
    assert re.search(r"PartitionFilters: \[[^\]]*flightdate#\d+ >= 2025-07-18", text)


def test_connection_join_is_an_equi_join(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(conn.build_connections(stored[0]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
    assert any("slot" in j and "a_part" in j and "d_part" in j for j in joins)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "TakeOrderedAndProject" not in text  # every hot group is cut, not the largest only


def test_only_needed_columns_are_read(stored):
    text = plan(rollups.connecting_hubs(stored[1]))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all(s == "hub:string" for s in schemas)


def test_top_k_is_a_bounded_heap(stored):
    assert "TakeOrderedAndProject" in plan(requests.busiest_origins(stored[0], DAY))
    assert "TakeOrderedAndProject" in plan(network.densest_pair(stored[1]))


def test_ranking_is_cut_before_the_shuffle(spark, stored):
    legs, edges = stored
    row = (0, DAY, "LGA", "DFW", None, None, 0, 2, 5)
    specs = spark.createDataFrame(
        [row],
        "spec bigint, flightdate date, origin string, dest string, depart_after timestamp_ntz, "
        "arrive_before timestamp_ntz, min_stops int, max_stops int, limit int",
    )
    text = plan(solve_specs(specs, legs, edges))
    assert re.search(r"WindowGroupLimit .*row_number\(\), 5, Partial", text)


def test_routes_aggregate_before_the_shuffle(stored):
    text = plan(network.routes(stored[0]))
    assert "partial_count" in text and text.count("Exchange hashpartitioning") <= 2


def test_stage_tables_live_in_the_shared_folder(spark, stored):
    from skyloom.storage import shared_root

    assert all(f.startswith(f"file://{shared_root(spark)}/skyloom/") for f in stored[1].inputFiles())


def test_search_reads_the_asked_dates_only(spark, stored, monkeypatch):
    """Legs and every hop are pruned to the date asked for; coverage is not counted edge by edge."""
    from skyloom.operators import search as srch

    legs, connections = stored
    seen = []
    solve = srch.solve_specs

    def spy(specs, some_legs, some_connections):
        seen.extend([plan(some_legs), plan(some_connections)])
        return solve(specs, some_legs, some_connections)

    monkeypatch.setattr(srch, "solve_specs", spy)
    ask = spark.createDataFrame(
        [("a", "LGA", "DFW", str(DAY))], "request_id string, origin string, dest string, date string"
    )
    assert srch.search(ask, legs, connections).count() > 0
    for text in seen:
        assert re.search(r"PartitionFilters: \[[^\]]*flightdate#\d+ = 2025-07-18", text), text
    small = stage(conn.connections_per_date(connections), "built")
    assert srch.search(ask, legs, connections, built=small).count() > 0

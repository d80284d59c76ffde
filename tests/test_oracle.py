"""Every registered query against its SQL, whole results, on the smallest data set."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from skyloom.operators import layovers, legs, network
from skyloom.plans.registry import ORACLES, QUERIES
from skyloom.plans.tables import tables
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_result(spark, con, name):
    state, _, _, _, note = compare(spark, con, name, SF)
    assert state == "ok", note


def test_hazards_are_present(spark):
    """The data can expose the faults that the queries are checked for."""
    run = lambda name: contract.queries()[name](spark, SF)
    audit = run("overnight_audit").agg({"next_day": "sum", "previous_day": "sum", "utc_next_day": "sum"}).first()
    assert all(v > 0 for v in audit)
    assert run("carrier_edge_audit").first().cross_family > 0
    assert run("dst_contradictions").count() > 0
    assert run("cyclic_paths").agg({"cyclic": "sum"}).first()[0] > 0
    assert run("negative_layovers").agg({"negative": "sum"}).first()[0] > 0
    assert {r.status for r in run("search_status").select("status").distinct().collect()} == {
        "ok", "empty", "not_built", "bad_request",
    }


def test_batch_forms_equal_single_lookups(spark):
    """Every pair's answer is that of the lookup of that pair alone, repeated requests included."""
    t = tables(spark, SF)
    asked = spark.createDataFrame(
        [(1, "LGA", "DFW", "2025-07-18"), (2, "LGA", "DFW", "2025-07-18"), (3, "DFW", "LGA", "2025-07-15")],
        "request_id int, origin string, dest string, date string",
    ).withColumn("flightdate", F.col("date").cast("date"))
    nonstops = legs.direct_flights_of(t.legs, asked).collect()
    stops = layovers.one_stop_of(t.legs, asked).collect()
    for request, origin, dest, day in asked.select("request_id", "origin", "dest", "date").collect():
        alone = {tuple(r) for r in legs.direct_flights(t.legs, origin, dest, day).collect()}
        assert {tuple(r)[1:] for r in nonstops if r.request_id == request} == alone
        alone = {tuple(r.flights) for r in layovers.one_stop(t.legs, origin, dest, day).collect()}
        assert {tuple(r.flights) for r in stops if r.request_id == request} == alone
    routes = network.acyclic_routes_of(t.routes, asked).collect()
    alone = [r.route for r in network.acyclic_routes(t.routes, "LGA", "DFW", 3).collect()]
    assert [r.route for r in sorted(routes, key=lambda r: r.rank) if r.origin == "LGA"] == alone
    assert legs.direct_flights_of(t.legs, asked.limit(0)).count() == 0
    assert layovers.one_stop_of(t.legs, asked.limit(0)).count() == 0
    assert network.acyclic_routes_of(t.routes, asked.limit(0)).count() == 0

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyloom.operators import legs as leg
from skyloom.operators import quality as q
from skyloom.operators import reports
from skyloom.sources import tables as sinks

KEY = "flightdate date, reporting_airline string, flight_number_reporting_airline string, origin string, dest string, cancelled double"
D = dt.date(2024, 3, 1)


def check(spark, values, ddl, rule):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], ddl)
    return [r[0] for r in df.select(F.coalesce(rule, F.lit(False))).collect()]


def test_carrier_and_airport_codes(spark):
    # Two places of A-Z and 0-9, at least one of them a letter: the corners of each class.
    kinds = {"letter": ["A", "Z"], "digit": ["0", "9"], "other": ["a", "z", " ", "-", "Ä"]}
    codes = [(x + y, p != "other" != r and "letter" in (p, r)) for p in kinds for r in kinds for x in kinds[p] for y in kinds[r]]
    codes += [(None, False), ("", False), ("Q", False), ("QQQ", False), ("Q7Q", False)]
    assert check(spark, [c for c, _ in codes], "c string", q.carrier_code("c")) == [ok for _, ok in codes]
    assert check(spark, ["aa", "b6"], "c string", q.carrier_code("c", lenient=True)) == [True, True]
    assert check(spark, ["LAX", "lax", "LA", "LAXX", "L1X", None], "c string", q.airport_code("c")) == [True] + [False] * 5
    assert check(spark, ["lax", "L1X", "L X"], "c string", q.airport_code("c", lenient=True)) == [True, True, False]


def test_flight_numbers(spark):
    # One to four digits that are not all zero.
    numbers = [str(10**k) for k in range(6)] + [str(10**k - 1) for k in range(1, 6)] + ["0" * k + "7" for k in range(5)]
    assert check(spark, numbers, "n string", q.flight_number("n")) == [len(n) <= 4 for n in numbers]
    assert check(spark, [None, "", "x7", "7x", "-7", "7.0", " "], "n string", q.flight_number("n")) == [False] * 7
    assert check(spark, ["0"], "n string", q.flight_number("n", allow_zero=True)) == [True]


def test_cancellation_agreement(spark):
    rows = [(flag, d, a) for flag in (0, 1) for d in (None, "x") for a in (None, "x")]
    want = [d is a is None if flag else None not in (d, a) for flag, d, a in rows]
    assert check(spark, rows, "c int, d string, a string", q.cancelled_agrees("c", "d", "a")) == want
    flags = {"0": True, "1": True, "0.0": True, "1.0": True, "-1": False, "7": False, "yes": False, "": False, None: False}
    assert check(spark, list(flags), "c string", q.cancelled_flag("c")) == list(flags.values())


def edges(low, high):
    """Both limits of a closed range, the values just outside, the middle and a null."""
    return {low - 1: False, low: True, (low + high) // 2: True, high: True, high + 1: False, None: False}


def test_ranges(spark):
    for rule, cases in (
        (q.distance_range("v"), edges(50, 10_000)),
        (q.distance_range("v", strict=False), {-1: False, 0: False, 1: True, None: False}),
        (q.delay_range("v"), edges(-30, 720) | {None: True}),
        (q.layover_range("v"), edges(45, 300)),
        (q.overnight_layover_range("v"), edges(120, 600)),
    ):
        assert check(spark, list(cases), "v int", rule) == list(cases.values())
    years = {f"{y}-{tail}": ok for y, ok in edges(1987, 2030).items() if y for tail in ("01-01", "12-31")}
    years |= {"2028-02-29": True, "2027-02-29": False, "2027-00-10": False, "2027-4-1": False, "": False}
    assert check(spark, list(years), "d string", q.date_text_valid("d")) == list(years.values())
    clocks = {f"{h:02}{m:02}": h < 24 and m < 60 for h in (0, 9, 23, 24) for m in (0, 59, 60)} | {"7": False, "07:5": False, "075x": False}
    assert check(spark, list(clocks), "d string", q.hhmm_text("d")) == list(clocks.values())


def test_time_sequences(spark):
    """Every quarter of an hour after 00:00, 07:50 and 23:40, judged by the minutes between."""
    starts, steps = (0, 470, 1420), range(0, 1440, 15)
    clock = lambda m: dt.datetime(2024, 3, 1) + dt.timedelta(minutes=m % 1440)
    pairs = [(s, (s + k) % 1440) for s in starts for k in steps]
    limits = [(s, (s + k) % 1440) for s in starts for k in (29, 30, 44, 45, 59, 60, 480, 481, 720, 721, 1079, 1080, 1081)]
    rules = {
        q.same_day_sequence: lambda d, a: 30 <= a - d <= 720,
        q.overnight_sequence: lambda d, a: 60 <= (a - d) % 1440 <= 480,
        q.plausible_duration: lambda d, a: 45 <= (a - d) % 1440 <= 480,
        q.clock_order: lambda d, a: a > d or a < d and a - d + 1440 < 1080,
    }
    rows = [(clock(d), clock(a)) for d, a in pairs + limits] + [(None, clock(9)), (clock(9), None)]
    for rule, ok in rules.items():
        want = [ok(d, a) for d, a in pairs + limits] + [False, False]
        assert check(spark, rows, "d timestamp_ntz, a timestamp_ntz", rule("d", "a")) == want


def test_speed_by_band(spark):
    """On both sides of each band's border: least and greatest speed, least minutes."""
    rows = {}
    for miles in (299, 300, 499, 500, 999, 1000, 2000, 2001):
        slowest = 100 if miles < 300 else 150 if miles < 1000 else 200
        least = 240 if miles > 2000 else 45 if miles < 500 else 0
        for minutes in (-1, 0, 44, 45, 239, 240, miles * 60 // 700, miles * 60 // 700 + 1, miles * 60 // slowest, miles * 60 // slowest + 1):
            fits = minutes > 0 and slowest * minutes <= 60 * miles <= 700 * minutes and minutes >= least
            rows[float(miles), float(minutes)] = fits
    assert check(spark, list(rows), "m double, t double", q.speed_range("m", "t")) == list(rows.values())
    assert {ok for ok in rows.values()} == {True, False}


def test_numeric_text(spark):
    cases = {"seven": (None, None), " ": (None, None), "nil": (None, None), "-": (None, None), "1e3": (None, 1000.0)}
    cases |= {"0.25": (None, 0.25), "+.5": (None, 0.5), "8.": (None, 8.0), " 42 ": (42, 42.0), "-907": (-907, -907.0)}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    rows = df.select("v", q.whole_number("v").alias("w"), q.decimal_number("v").alias("d")).collect()
    assert {r.v: (r.w, r.d) for r in rows} == cases


def test_reference_rows(spark):
    """A sound row, and each of its fields alone made unfit."""
    sound = ("QQQ", "Quay Quarry Field", "Quill", "QL", "Quo")
    rows = {sound: True} | {(code, *sound[1:]): False for code in ("QQ", "QQQQ", "qqq", "Q1Q", None)}
    rows |= {(*sound[:at], bad, *sound[at + 1 :]): False for at in (1, 2, 3, 4) for bad in ("", "  ", None)}
    ddl = "code string, name string, city string, state string, country string"
    assert check(spark, list(rows), ddl, q.airport_row()) == list(rows.values())
    sound = ("QQ", "Quay Airways", "Quo")
    rows = {sound: True} | {(code, *sound[1:]): False for code in ("Q", "QQQ", "qq", None)}
    rows |= {(*sound[:at], bad, *sound[at + 1 :]): False for at in (1, 2) for bad in ("", "  ", None)}
    assert check(spark, list(rows), "code string, name string, country string", q.airline_row()) == list(rows.values())


def validity_cases():
    """A sound row, and the row with one field at a time made null, blank or contradictory:
    (row, passes the loader's filter, passes the strict one)."""
    sound = (D, "ZZ", "77", "AAA", "BBB", 0.0)
    out = [(sound, True, True), ((*sound[:5], 1.0), False, False), ((*sound[:5], None), False, False)]
    for at in range(5):
        out.append(((*sound[:at], None, *sound[at + 1 :]), False, False))
    for at in range(1, 5):
        out.append(((*sound[:at], "", *sound[at + 1 :]), True, False))
    return [*out, ((*sound[:4], "AAA", 0.0), True, False), ((D, "YY", "78", "BBB", "AAA", 0.0), True, True)]


VALIDITY = validity_cases()


def test_loader_filter_and_strict_filter(spark):
    df = spark.createDataFrame([r for r, _, _ in VALIDITY], KEY)
    assert leg.valid_legs(df).count() == sum(loose for _, loose, _ in VALIDITY)
    assert leg.valid_legs(df, strict=True).count() == sum(strict for _, _, strict in VALIDITY)


def test_report_violations_and_duplicates(spark):
    df = spark.createDataFrame([r for r, _, _ in VALIDITY], KEY)
    rules = {"carrier": q.carrier_code("reporting_airline"), "ends": q.different_ends()}
    report = {r.rule: (r.checked, r.failed) for r in q.quality_report(df, rules).collect()}
    assert report == {"carrier": (14, 2), "ends": (14, 3)}
    rows = q.violations(df, rules).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in rows} == {"carrier": 2, "ends": 3}
    twice = df.union(df.limit(0)).unionAll(df.filter("reporting_airline = 'YY'"))
    assert [r.copies for r in q.duplicate_keys(twice.filter("cancelled is not null")).filter("reporting_airline = 'YY'").collect()] == [2]
    got = {r.column: (r.filled, r.complete) for r in q.completeness(df, ["origin", "flightdate", "cancelled"]).collect()}
    assert got["origin"] == (13, False)  # one null of fourteen


def test_one_row_per_key_is_the_same_row(spark):
    rows = [(D, "AA", 1, "LAX", "JFK", v) for v in (3, 1, 2)]
    df = spark.createDataFrame(rows, "flightdate date, reporting_airline string, flight_number_reporting_airline bigint, origin string, dest string, v int")
    for n in (1, 3, 7):
        assert [r.v for r in sinks.one_per_key(df.repartition(n)).collect()] == [1]


def test_upsert_is_repeatable_and_new_rows_win(spark, tmp_path):
    ddl = "flightdate date, reporting_airline string, flight_number_reporting_airline bigint, origin string, dest string, v int"
    d2 = dt.date(2024, 3, 2)
    path = str(tmp_path / "legs")
    first = spark.createDataFrame([(D, "AA", 1, "LAX", "JFK", 1), (D, "AA", 2, "LAX", "JFK", 1), (d2, "AA", 1, "LAX", "JFK", 1)], ddl)
    sinks.upsert_legs(first, path)
    sinks.upsert_legs(first, path)
    assert sinks.verify_written(spark, path) == 3
    sinks.upsert_legs(spark.createDataFrame([(D, "AA", 1, "LAX", "JFK", 9)], ddl), path)
    got = {(r.flightdate, r.flight_number_reporting_airline): r.v for r in spark.read.parquet(path).collect()}
    assert got == {(D, 1): 9, (D, 2): 1, (d2, 1): 1}
    sinks.replace_dates(first.filter("v = 0 or flightdate = '2024-03-02'"), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(RuntimeError):
        empty = str(tmp_path / "none")
        first.limit(0).write.parquet(empty)
        sinks.verify_written(spark, empty)


def test_exact_percentiles(spark):
    import random

    import numpy as np

    rng = random.Random(2)
    data = {
        "skewed": [round(rng.expovariate(0.01), 2) for _ in range(3000)],
        "ties": [5.0] * 700 + [7.0],
        "one": [3.25],
        "wide": [10.0 ** rng.randrange(-3, 9) for _ in range(500)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("one", None)], "name string, v double")
    got = {r.name: r for r in reports.exact_percentiles(df, ["name"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}).collect()}
    for name, values in data.items():
        for p, c in ((0, "p0"), (50, "p50"), (95, "p95"), (99, "p99"), (100, "p100")):
            assert got[name][c] == pytest.approx(np.percentile(values, p), rel=1e-12)


def test_request_rollup_drops_embedded_summaries(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("nonstop", float(i), i % 10 == 0, t0 + dt.timedelta(seconds=i)) for i in range(1, 101)]
    rows += [("search", 400.0, False, t0 + dt.timedelta(seconds=1)), ("Aggregated", 1e6, True, t0), ("Total", 1e6, True, t0)]
    log = spark.createDataFrame(rows, "name string, response_ms double, failed boolean, at timestamp_ntz")
    rollup = {r.name: r for r in reports.request_rollup(log).collect()}
    assert set(rollup) == {"nonstop", "search"}
    assert rollup["nonstop"].mean_ms == 50.5 and rollup["nonstop"].failure_pct == 10.0
    assert rollup["nonstop"].p95_ms == pytest.approx(95.05)
    summary = reports.run_summary(reports.request_rollup(log)).first()
    assert summary.mean_ms == pytest.approx((50.5 + 400) / 2) and summary.slowest == "search"
    assert (summary.failure_grade, summary.response_grade, summary.check_errors) == ("POOR", "ACCEPTABLE", True)

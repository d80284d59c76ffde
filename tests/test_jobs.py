import datetime as dt

import pytest
from conftest import DAY
from test_connections import OFFSETS, schedule

from skyloom import jobs
from skyloom.__main__ import main
from skyloom.operators.connections import BuildError
from skyloom.operators.offsets import OffsetError

RECORD = (
    "flightdate timestamp_ntz, reporting_airline string, flight_number_reporting_airline bigint, origin string, "
    "dest string, crsdeptime timestamp_ntz, crsarrtime timestamp_ntz, deptime timestamp_ntz, arrtime timestamp_ntz, "
    "crselapsedtime double, actualelapsedtime double, distance double, tail_number string, depdelay double, "
    "arrdelay double, cancelled double"
)
TRUE = {**OFFSETS, "PHX": -420}


def record(row):
    carrier, number, a, b, dep, block, day = row
    start = dt.datetime.combine(day, dt.time(*map(int, dep.split(":"))))
    real = start + dt.timedelta(minutes=block + TRUE[b] - TRUE[a])
    at = lambda t: dt.datetime.combine(dt.date(1900, 1, 1), t.time())
    midnight = dt.datetime.combine(day, dt.time())
    return (midnight, carrier, number, a, b, at(start), at(real), at(start), at(real), float(block), float(block), 500.0, "N1", 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    rows = schedule(300, seed=2, days=2)
    days = {r[6] for r in rows}
    rows += [("AA", 9000 + i, "PHX", b, "09:00", 120, d) for d in days for i, b in enumerate(OFFSETS)]
    spark.createDataFrame([record(r) for r in rows], RECORD).write.parquet(f"{base}/records")
    return base, rows


def test_load_solve_connect_search(spark, folder, capsys):
    base, rows = folder
    root, source = f"{base}/tables", f"{base}/records"
    counts = jobs.load(spark, source, root)
    assert counts["loaded"] == len(rows) and counts["airports"] == 7
    assert jobs.load(spark, source, root) == counts  # loading again changes nothing

    with pytest.raises(OffsetError, match="no_pairs"):
        jobs.solve_dates(spark, root, ["2024-01-01"])
    jobs.solve_dates(spark, root, [str(DAY)])
    solved = {r.airport: r.offset_minutes for r in jobs.table(spark, root, "offsets").collect()}
    assert solved == TRUE
    with pytest.raises(BuildError, match="no legs"):
        jobs.connect_dates(spark, root, ["2025-07-19"])
    jobs.connect_dates(spark, root, [str(DAY)])
    first = jobs.table(spark, root, "connections").count()
    assert first > 0

    ask = spark.createDataFrame(
        [("a", "LGA", "DFW", str(DAY)), ("b", "LGA", "DFW", "2025-07-19")],
        "request_id string, origin string, dest string, date string",
    )
    got = {r.request_id: r.status for r in jobs.search_table(spark, root, ask).collect()}
    assert got["a"] in ("ok", "empty") and got["b"] == "not_built"

    jobs.solve_dates(spark, root)
    jobs.connect_dates(spark, root)
    both = jobs.table(spark, root, "connections")
    assert both.filter(f"flightdate = '{DAY}'").count() == first < both.count()

    # A build that cannot be checked leaves the stored date as it was.
    with pytest.raises(ValueError):
        jobs.connect_dates(spark, root, [str(DAY)], min_layover=50, max_layover=40)
    spark.catalog.clearCache()
    assert jobs.table(spark, root, "connections").filter(f"flightdate = '{DAY}'").count() == first
    assert {str(r.flightdate) for r in jobs.built_dates(spark, root).collect()} == {str(DAY), "2025-07-19"}

    # A tighter rule rebuilds the date, down to no rows at all; the other date stays.
    jobs.connect_dates(spark, root, [str(DAY)], min_layover=45, max_layover=60)
    assert 0 < jobs.table(spark, root, "connections").filter(f"flightdate = '{DAY}'").count() < first
    jobs.connect_dates(spark, root, [str(DAY)], min_layover=46, max_layover=46)
    spark.catalog.clearCache()
    left = {str(r.flightdate) for r in jobs.table(spark, root, "connections").select("flightdate").distinct().collect()}
    assert left == {"2025-07-19"}

    main(["--root", root, "search", "LGA", "DFW", "2025-07-19", "--max-stops", "1", "--limit", "3"])
    main(["--root", root, "dates"])
    out = capsys.readouterr().out
    assert "2025-07-19" in out

    header = "Year,Month,FlightDate,Flight_Number_Reporting_Airline,DOT_ID_Reporting_Airline,Reporting_Airline,Origin,Dest"
    (base / "csv").mkdir()
    (base / "csv" / "m7.csv").write_text(f"{header}\n2025,7,2025-07-18,1,19805,AA,LGA,DFW\n")
    for _ in range(2):  # the second run finds the month stored
        main(["--root", root, "ingest", f"{base}/csv", f"{base}/typed"])
    main(["--root", root, "summary", f"{base}/typed"])
    assert spark.read.parquet(f"{base}/typed").count() == 1
    assert "2025-07" in capsys.readouterr().out


def test_reload_takes_the_date_out_of_service(spark, tmp_path):
    rows = [r for r in schedule(120, seed=4, days=1)]
    rows += [("AA", 9000 + i, "PHX", b, "09:00", 120, DAY) for i, b in enumerate(OFFSETS)]
    spark.createDataFrame([record(r) for r in rows], RECORD).write.parquet(f"{tmp_path}/records")
    root = f"{tmp_path}/tables"
    ask = spark.createDataFrame([("a", "LGA", "DFW", str(DAY))], "request_id string, origin string, dest string, date string")
    jobs.load(spark, f"{tmp_path}/records", root)
    jobs.solve_dates(spark, root)
    jobs.connect_dates(spark, root)
    assert {r.status for r in jobs.search_table(spark, root, ask).collect()} <= {"ok", "empty"}
    # One date that cannot be solved does not keep the other from being written.
    other = DAY + dt.timedelta(days=3)
    stray = [record(("AA", 1, "LGA", "ATL", "08:00", 100, other))]
    spark.createDataFrame(stray, RECORD).write.mode("append").parquet(f"{tmp_path}/records")
    jobs.load(spark, f"{tmp_path}/records", root)
    assert jobs.built_dates(spark, root).count() == 0
    with pytest.raises(OffsetError, match="no_anchor"):
        jobs.solve_dates(spark, root)
    jobs.connect_dates(spark, root, [str(DAY)])
    assert {r.status for r in jobs.search_table(spark, root, ask).collect()} <= {"ok", "empty"}
    assert [str(r.flightdate) for r in jobs.built_dates(spark, root).collect()] == [str(DAY)]


CSV = ("FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "DOT_ID_Reporting_Airline", "Origin", "Dest", "CRSDepTime",
       "CRSArrTime", "DepTime", "ArrTime", "CRSElapsedTime", "ActualElapsedTime", "Distance", "Tail_Number", "DepDelay", "ArrDelay", "Cancelled")


def text_row(row, tail="N1", cancelled=0):
    r = record(row)
    clock = lambda t: t.strftime("%H%M")
    cells = (str(r[0].date()), r[1], r[2], 19805, r[3], r[4], clock(r[5]), clock(r[6]), clock(r[7]), clock(r[8]), r[9], r[10], r[11], tail, 0, 0, cancelled)
    return ",".join(map(str, cells))


def test_streamed_dates_and_solved_dates_are_refused_until_connected(spark, tmp_path):
    from skyloom.streaming.monthly import keep_loaded

    root, source = f"{tmp_path}/tables", tmp_path / "csv"
    source.mkdir()
    other = DAY + dt.timedelta(days=1)
    base = [r for r in schedule(150, seed=7, days=2)]
    base += [("AA", 9000 + i, "PHX", b, "09:00", 120, d) for d in (DAY, other) for i, b in enumerate(OFFSETS)]

    def stream(name, rows):
        (source / name).write_text("\n".join([",".join(CSV), *rows]) + "\n")
        keep_loaded(spark, str(source), list(CSV), root, f"{tmp_path}/checkpoint")
        spark.catalog.clearCache()

    def states():
        ask = [(str(d), "LGA", "DFW", str(d)) for d in (DAY, other)]
        asked = spark.createDataFrame(ask, "request_id string, origin string, dest string, date string")
        return {r.request_id: r.status == "not_built" for r in jobs.search_table(spark, root, asked).collect()}

    stream("m1.csv", [text_row(r) for r in base] + [text_row(("AA", 5, "LGA", "ATL", "23:00", 90, DAY), cancelled=1)])
    jobs.solve_dates(spark, root)
    jobs.connect_dates(spark, root)
    assert states() == {str(DAY): False, str(other): False}
    assert jobs.table(spark, root, "cancelled").count() == 1
    assert {r.rotation: r.cancelled for r in jobs.cancellations(spark, root).collect()}.keys() >= {"first"}
    assert jobs.rotation_links(spark, root).count() == len(base)

    stations = jobs.table(spark, root, "airports").count()
    stream("m2.csv", [text_row(("AA", 7000, "PHX", "DEN", "10:00", 100, DAY)), text_row(("ZZ", 1, "PHX", "LGA", "11:00", 200, DAY))])
    assert states() == {str(DAY): True, str(other): False}
    assert jobs.table(spark, root, "airports").count() == stations
    assert "ZZ" in {r.code for r in jobs.table(spark, root, "carriers").collect()}
    jobs.solve_dates(spark, root, [str(DAY)])
    assert states() == {str(DAY): True, str(other): False}
    jobs.connect_dates(spark, root, [str(DAY)])
    assert states() == {str(DAY): False, str(other): False}
    jobs.solve_dates(spark, root, [str(other)])  # solved anew: what was built on its former times goes
    spark.catalog.clearCache()
    assert states() == {str(DAY): False, str(other): True}


def test_a_failing_write_leaves_the_dates_as_they_were(spark, tmp_path):
    from pyspark.sql import functions as F

    from skyloom.sources.tables import replace_dates

    path = f"{tmp_path}/t"
    ddl = "flightdate date, n int"
    days = [DAY, DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=2)]
    replace_dates(spark.createDataFrame([(d, i) for i, d in enumerate(days)], ddl), path)
    bad = spark.createDataFrame([(d, 10 + i) for i, d in enumerate(days)], ddl).repartition(3)
    with pytest.raises(Exception, match="no such row"):
        replace_dates(bad.withColumn("n", F.when(F.col("n") == 12, F.raise_error(F.lit("no such row"))).otherwise(F.col("n"))), path, [str(d) for d in days])
    read = lambda: {(str(r.flightdate), r.n) for r in spark.read.schema(ddl).parquet(path).collect()}
    assert read() == {(str(d), i) for i, d in enumerate(days)}
    # One date is new, one comes out empty, the third is not asked for.
    replace_dates(spark.createDataFrame([(days[0], 5), (days[0], 6)], ddl), path, [str(days[0]), str(days[1])])
    spark.catalog.clearCache()
    assert read() == {(str(days[0]), 5), (str(days[0]), 6), (str(days[2]), 2)}
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_load_counts_its_own_dates_only(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/tables"
    rows = schedule(120, seed=9, days=3)
    day = lambda r: r[6]
    days = sorted({day(r) for r in rows})
    frames = [spark.createDataFrame([record(r) for r in rows if day(r) == d], RECORD) for d in days]
    for frame in frames[:2]:
        jobs.add_records(spark, frame, root)
    seen = []
    whole = jobs.replace_dates
    monkeypatch.setattr(jobs, "replace_dates", lambda df, path, dates=None: (seen.append((path.rsplit("/", 1)[-1], dates)), whole(df, path, dates)))
    jobs.add_records(spark, frames[2], root)
    assert seen == [("daily", [str(days[2])])]
    spark.catalog.clearCache()
    from skyloom.operators import network

    stored = {tuple(r) for r in jobs.table(spark, root, "routes").collect()}
    assert stored == {tuple(r) for r in network.routes(jobs.table(spark, root, "loaded")).collect()}

import datetime as dt

import pytest

from skyloom.functions import hhmm_to_time, strict_date
from skyloom.schema import RECORD_TYPES, record_schema
from skyloom.sources import records as rec
from skyloom.sources import scan

HEADER = "FlightDate,Flight_Number_Reporting_Airline,DOT_ID_Reporting_Airline,Reporting_Airline,Origin,Dest,CRSDepTime,Distance,Cancelled,Year,Month,Extra Col"


def write_csv(path, rows):
    path.write_text("\n".join([HEADER, *rows]) + "\n")


def test_declared_map_size(spark):
    assert len(RECORD_TYPES) == 110
    assert record_schema(["flightdate"]).fields[0].dataType.simpleString() == "timestamp_ntz"


@pytest.mark.parametrize(
    "text, good",
    [("2500", 0), ("1260", 0), ("9999", 0), ("abc", 0), ("", 0), ("12", 0), ("123", 0), ("12345", 0),
     ("12:30", 0), ("2400", 0), (None, 0), ("1430", 1), ("0000", 1), ("2359", 1)],
)
def test_hhmm(spark, text, good):
    row = spark.createDataFrame([(text,)], "t string").select(hhmm_to_time("t").alias("v")).first()
    assert (row.v is not None) == bool(good)
    if good:
        assert row.v == dt.datetime(1900, 1, 1, int(text[:2]), int(text[2:]))


@pytest.mark.parametrize(
    "text, good",
    [("2024-03-01", 1), ("2024-02-29", 1), ("2024-13-01", 0), ("2024-02-30", 0), ("2024-04-31", 0),
     ("2023-02-29", 0), ("2024/03/01", 0), ("03-01-2024", 0), ("2024-3-1", 0), ("", 0), (None, 0)],
)
def test_strict_date(spark, text, good):
    row = spark.createDataFrame([(text,)], "t string").select(strict_date("t").alias("v")).first()
    assert (row.v is not None) == bool(good)


def test_csv_types_nulls_and_dropped_rows(spark, tmp_path):
    write_csv(
        tmp_path / "a.csv",
        [
            "2025-07-18,100,19805,AA,LGA,DFW,0930,1389.00,0.00,2025,7,x",
            "2025-07-18,101.0,19805,AA,LGA,DFW,2400,N/A,0.00,2025,7,x",
            "2025-07-18,,19805,AA,LGA,DFW,0930,1.0,0.00,2025,7,x",
            "2025-07-18,7,NULL,AA,LGA,DFW,0930,1.0,0.00,2025,7,x",
            "bad,12.5,19805,AA,LGA,DFW,0930,1.0,0.00,2025,7,x",
        ],
    )
    df = rec.read_records_csv(spark, str(tmp_path / "a.csv"))
    assert "extra_col" in df.columns
    rows = df.orderBy("flight_number_reporting_airline").collect()
    assert [r.flight_number_reporting_airline for r in rows] == [100, 101]
    assert rows[0].crsdeptime == dt.datetime(1900, 1, 1, 9, 30) and rows[0].distance == 1389.0
    assert rows[1].crsdeptime is None and rows[1].distance is None
    lost = rec.conversion_losses(spark.read.option("header", True).csv(str(tmp_path / "a.csv")))
    assert {r.column: r.lost_cells for r in lost.collect() if r.lost_cells} == {
        "flightdate": 1, "flight_number_reporting_airline": 1, "dot_id_reporting_airline": 1,
        "crsdeptime": 1, "distance": 1,
    }


def test_typed_sink_keeps_declared_columns_only(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["2025-07-18,100,19805,AA,LGA,DFW,0930,1389.00,0.00,2025,7,x"])
    out = str(tmp_path / "out")
    rec.write_records(rec.read_records_csv(spark, str(tmp_path / "a.csv")), out)
    back = spark.read.parquet(out)
    assert "extra_col" not in back.columns and "arrtime" not in back.columns
    assert back.schema["flightdate"].dataType.simpleString() == "timestamp_ntz"
    assert back.schema["crsdeptime"].dataType.simpleString() == "timestamp_ntz"


def test_widened_sink(spark, tmp_path):
    df = spark.sql("select cast(1 as int) a, cast(1.5 as float) b, date'2025-01-01' c, true d, 'x' e")
    rec.write_records(df, str(tmp_path / "o"), declared=False)
    types = dict(spark.read.parquet(str(tmp_path / "o")).dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "string", "e": "string"}


def test_months_are_loaded_once(spark, tmp_path):
    path = str(tmp_path / "months")
    july = spark.createDataFrame([(2025, 7, "a")], "year int, month int, origin string")
    both = july.union(spark.createDataFrame([(2025, 8, "b")], july.schema))
    rec.append_new_months(july, path)
    rec.append_new_months(both, path)
    rec.append_new_months(both, path)
    assert sorted(r.origin for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_months_with_another_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Origin,Dest,Distance\nLGA,DFW,1\nLGA,ATL,2\n")
    (tmp_path / "b.csv").write_text("Distance,Dest,Origin,Tail_Number\r\n3,ORD,DEN,N1\r\n")
    (tmp_path / "c.csv").write_text("Origin,Dest,Distance\nJFK,BOS,4\n")
    rows = rec.read_records_csv(spark, str(tmp_path)).collect()
    got = sorted((r.origin, r.dest, r.distance, r.tail_number) for r in rows)
    assert got == [("DEN", "ORD", 3.0, "N1"), ("JFK", "BOS", 4.0, None), ("LGA", "ATL", 2.0, None), ("LGA", "DFW", 1.0, None)]


def month_file(spark, path, name, df):
    import os
    import shutil

    tmp = f"{path}/_tmp_{name}"
    df.coalesce(1).write.parquet(tmp)
    part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
    shutil.copy(f"{tmp}/{part}", f"{path}/{name}")


@pytest.fixture
def month_folder(spark, tmp_path):
    base = "flightdate timestamp_ntz, flight_number_reporting_airline bigint, reporting_airline string, origin string, dest string"
    d7, d8 = dt.datetime(2025, 7, 18), dt.datetime(2025, 8, 1)
    folder = tmp_path / "files"
    folder.mkdir()
    month_file(spark, str(folder), "flights_2025_07.parquet", spark.createDataFrame([(d7, 1, "AA", "LGA", "DFW"), (d8, 2, "AA", "LGA", "DFW")], base))
    month_file(
        spark, str(folder), "flights_2025_08.parquet",
        spark.createDataFrame([(d8, 3, "DL", "ATL", None, "N1")], base + ", div2tailnum string"),
    )
    return folder


def test_merged_scan_and_summary(spark, month_folder):
    df = scan.scan_records(spark, str(month_folder))
    assert df.count() == 3 and "div2tailnum" in df.columns
    row = scan.dataset_summary(df).first()
    assert (row.total_flights, row.months, row.airlines, row.airports) == (3, 2, 2, 3)
    assert {r.month: r.flights for r in scan.month_breakdown(df).collect()} == {"2025-07": 1, "2025-08": 2}
    one = scan.scan_strict(spark, str(month_folder), "flights_2025_07.parquet")
    assert one.count() == 2
    assert scan.sample_head(df, 2).count() == 2


def test_file_name_month(spark, month_folder):
    df = scan.scan_records(spark, str(month_folder))
    got = {r.file: (r.rows, r.rows_in_named_month) for r in scan.file_month_agreement(df).collect()}
    assert got == {"flights_2025_07.parquet": (2, 1), "flights_2025_08.parquet": (1, 1)}


def test_clashing_and_broken_files(spark, month_folder):
    clash = spark.createDataFrame([(dt.datetime(2025, 9, 1), "7", "UA", "DEN", "ORD")],
        "flightdate timestamp_ntz, flight_number_reporting_airline string, reporting_airline string, origin string, dest string")
    month_file(spark, str(month_folder), "flights_2025_09.parquet", clash)
    df = scan.scan_records(spark, str(month_folder))
    assert df.schema["flight_number_reporting_airline"].dataType.simpleString() == "bigint"
    assert sorted(r[0] for r in df.select("flight_number_reporting_airline").collect()) == [1, 2, 3, 7]
    (month_folder / "flights_2025_10.parquet").write_text("not parquet")
    df, skipped = scan.scan_each(spark, str(month_folder))
    assert df.count() == 4 and [s.rsplit("/", 1)[-1] for s in skipped] == ["flights_2025_10.parquet"]

    report = scan.schema_report(spark, str(month_folder)).collect()
    wrong = {(r.file, r.column) for r in report if not r.consistent}
    assert ("flights_2025_09.parquet", "flight_number_reporting_airline") in wrong
    assert ("flights_2025_10.parquet", None) in wrong
    assert ("flights_2025_08.parquet", "flight_number_reporting_airline") not in wrong


def test_no_readable_file(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("nope")
    with pytest.raises(scan.NoReadableFile):
        scan.scan_each(spark, str(tmp_path))


def test_missing_folder_is_not_a_schema_clash(spark, tmp_path):
    with pytest.raises(Exception):
        scan.scan_records(spark, str(tmp_path / "absent"))


def test_csv_month_load(spark, tmp_path):
    from skyloom.streaming.monthly import load_new_files

    source, target, mark = tmp_path / "in", str(tmp_path / "legs"), str(tmp_path / "mark")
    source.mkdir()
    header = "FlightDate,Reporting_Airline,Flight_Number_Reporting_Airline,DOT_ID_Reporting_Airline,Origin,Dest,CRSDepTime,CRSArrTime,DepTime,ArrTime,CRSElapsedTime,ActualElapsedTime,Distance,Tail_Number,DepDelay,ArrDelay,Cancelled"
    line = "2025-07-{d},AA,{n},19805,LGA,DFW,0930,1210,0931,1215,220.00,224.00,1389.00,N1,{delay},5.00,{c}"
    columns = header.split(",")

    def put(name, *rows):
        (source / name).write_text("\n".join([header, *rows]) + "\n")

    put("a.csv", line.format(d=18, n=1, delay=1, c="0.00"), line.format(d=18, n=2, delay=1, c="1.00"), line.format(d=19, n=3, delay=1, c="0.00"))
    load_new_files(spark, str(source), columns, target, mark)
    legs = spark.read.parquet(target)
    assert sorted((str(r.flightdate), r.flight_number_reporting_airline) for r in legs.collect()) == [("2025-07-18", 1), ("2025-07-19", 3)]
    load_new_files(spark, str(source), columns, target, mark)
    assert spark.read.parquet(target).count() == 2
    # A later file adds a leg to a stored date and corrects one that is stored.
    put("b.csv", line.format(d=18, n=4, delay=1, c="0.00"), line.format(d=18, n=1, delay=9, c="0.00"))
    load_new_files(spark, str(source), columns, target, mark)
    rows = {(str(r.flightdate), r.flight_number_reporting_airline): r.departure_delay_minutes for r in spark.read.parquet(target).collect()}
    assert rows == {("2025-07-18", 1): 9, ("2025-07-18", 4): 1, ("2025-07-19", 3): 1}


def test_new_months_are_not_dealt_out_by_month(spark, tmp_path):
    """All records of a month would meet in one task; only the list of months may move."""
    path = str(tmp_path / "stored")
    rows = spark.range(1000).selectExpr("2025 as year", "cast(id % 2 + 7 as int) as month", "id as flight_number_reporting_airline")
    rows.filter("month = 7").write.partitionBy("year", "month").parquet(path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = rec.new_months(rows, spark.read.parquet(path))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.month for r in fresh.collect()} == {8}

"""python -m skyloom <job> --root FOLDER ...; meant for spark-submit as well."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skyloom import jobs
from skyloom.operators import connections as conn
from skyloom.schema import DEFAULT_LIMIT, DEFAULT_MAX_STOPS, MAX_LAYOVER, MIN_LAYOVER
from skyloom.session import get_session
from skyloom.sources import records, scan
from skyloom.storage import clear_stages


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skyloom")
    top.add_argument("--root", required=True, help="folder of the tables")
    top.add_argument("--master")
    job = top.add_subparsers(dest="job", required=True)

    ingest = job.add_parser("ingest", help="CSV month files to typed Parquet; stored months are skipped")
    ingest.add_argument("source")
    ingest.add_argument("target")
    ingest.add_argument("--overwrite", action="store_true", help="write all months anew")

    load = job.add_parser("load", help="Parquet records to legs, airports, carriers, routes")
    load.add_argument("source")
    load.add_argument("--file")
    load.add_argument("--strict", action="store_true")
    load.add_argument("--allow-unreadable", action="store_true", help="load what is left when files cannot be read")

    solve = job.add_parser("solve-offsets")
    solve.add_argument("dates", nargs="*")

    connect = job.add_parser("build-connections")
    connect.add_argument("dates", nargs="*")
    connect.add_argument("--min-layover", type=int, default=MIN_LAYOVER)
    connect.add_argument("--max-layover", type=int, default=MAX_LAYOVER)
    connect.add_argument("--strict-carrier", action="store_true")

    job.add_parser("dates", help="dates a connecting search can be answered on")
    summary = job.add_parser("summary")
    summary.add_argument("source")

    find = job.add_parser("search")
    find.add_argument("origin")
    find.add_argument("dest")
    find.add_argument("date")
    find.add_argument("--depart-after")
    find.add_argument("--arrive-before")
    find.add_argument("--max-stops", type=int, default=DEFAULT_MAX_STOPS)
    find.add_argument("--min-stops", type=int, default=0)
    find.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
    return top


def print_rows(df) -> None:
    """Every row, tab-separated; one partition at a time reaches the driver."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    shared = SparkSession.getActiveSession() is not None
    spark = get_session("skyloom", args.master)
    try:
        run(spark, args)
    finally:
        if not shared:
            clear_stages(spark)


def run(spark, args) -> None:
    root = args.root
    if args.job == "ingest":
        df = records.read_records_csv(spark, args.source)
        if args.overwrite:
            records.write_records(df, args.target)
        else:
            records.append_new_months(df, args.target)
    elif args.job == "load":
        done = jobs.load(spark, args.source, root, args.file, args.strict, args.allow_unreadable)
        for name, rows in done.items():
            print(f"{name}: {rows}")
    elif args.job == "solve-offsets":
        jobs.solve_dates(spark, root, args.dates or None)
    elif args.job == "build-connections":
        jobs.connect_dates(
            spark, root, args.dates or None, args.min_layover, args.max_layover, args.strict_carrier
        )
        print_rows(conn.connections_per_date(jobs.table(spark, root, "connections")).orderBy("flightdate"))
    elif args.job == "dates":
        print_rows(jobs.built_dates(spark, root).orderBy("flightdate"))
    elif args.job == "summary":
        df = scan.scan_records(spark, args.source)
        print_rows(scan.dataset_summary(df))
        print_rows(scan.month_breakdown(df).orderBy("month"))
    elif args.job == "search":
        bounds = "depart_after string, arrive_before string, max_stops int, min_stops int, limit int"
        row = (
            "1", args.origin, args.dest, args.date, args.depart_after, args.arrive_before,
            args.max_stops, args.min_stops, args.limit,
        )
        asked = spark.createDataFrame([row], f"request_id string, origin string, dest string, date string, {bounds}")
        found = jobs.search_table(spark, root, asked).orderBy(F.col("rank").asc_nulls_last())
        found.select("status", "error", "stops", "flights", "route", "departs", "arrives", "total_minutes").show(
            args.limit, truncate=False
        )


if __name__ == "__main__":
    main()

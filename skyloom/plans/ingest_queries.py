"""Ingest of monthly text files with drifting headers and cells that don't convert."""

import uuid

from pyspark.sql import functions as F

from skyloom.plans.registry import query
from skyloom.plans.sql import RECORDS
from skyloom.sources import records, scan
from skyloom.storage import shared_root

#: The files' rows as they are typed; two months, the later with an agency id that may be missing.
MONTHS = f"""{RECORDS},
file AS (SELECT *, dd >= 4 AS later, DATE '2025-07-14' + CAST(dd + CASE WHEN dd >= 4 THEN 31 ELSE 0 END AS INTEGER) AS day FROM rec),
typed AS (
  SELECT CAST(year(day) AS BIGINT) AS year, CAST(month(day) AS BIGINT) AS month,
         CASE WHEN num % 23 <> 0 THEN strftime(day, '%Y-%m-%d') END AS flightdate, car AS carrier,
         CAST(num AS BIGINT) AS number, o AS origin, d AS dest,
         CASE WHEN num % 19 <> 0 THEN lpad(CAST(dep // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(dep % 60 AS VARCHAR), 2, '0') END AS departs,
         CASE WHEN num % 11 <> 0 THEN CAST(miles AS DOUBLE) END AS distance,
         CAST(CASE WHEN later THEN 19805 END AS BIGINT) AS agency
  FROM file WHERE num % 17 <> 0 AND NOT (later AND num % 29 = 0))"""


def _typed(t):
    return records.read_records_csv(t.spark, t.month_files)


def _folder(t, name):
    return f"{shared_root(t.spark)}/skyloom/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@query("ingest_typed", f"WITH {MONTHS} SELECT * FROM typed")
def ingest_typed(t):
    return _typed(t).select(
        "year",
        "month",
        F.date_format("flightdate", "yyyy-MM-dd").alias("flightdate"),
        F.col("reporting_airline").alias("carrier"),
        F.col("flight_number_reporting_airline").alias("number"),
        "origin",
        "dest",
        F.date_format("crsdeptime", "HH:mm").alias("departs"),
        "distance",
        F.col("dot_id_reporting_airline").alias("agency"),
    )


@query(
    "ingest_losses",
    f"""WITH {MONTHS}, lost AS (SELECT count(*) FILTER (num % 23 = 0) AS flightdate, count(*) FILTER (num % 17 = 0) AS flight_number_reporting_airline,
      count(*) FILTER (num % 19 = 0) AS crsdeptime, count(*) FILTER (num % 11 = 0) AS distance, 0::BIGINT AS year, 0::BIGINT AS month,
      0::BIGINT AS dot_id_reporting_airline FROM file)
    SELECT "column", lost_cells FROM (UNPIVOT lost ON COLUMNS(*) INTO NAME "column" VALUE lost_cells) WHERE lost_cells > 0""",
)
def ingest_losses(t):
    return records.conversion_losses(records.read_text_csv(t.spark, t.month_files)).filter("lost_cells > 0")


@query("ingest_new_months", f"WITH {MONTHS} SELECT year, month, count(*) AS flights FROM typed GROUP BY year, month")
def ingest_new_months(t):
    """July first, then both months, then both again: each month is stored once."""
    path, typed = _folder(t, "stored-months"), _typed(t)
    records.append_new_months(typed.filter("month = 7"), path)
    records.append_new_months(typed, path)
    records.append_new_months(typed, path)
    return t.spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("flights"))


@query(
    "ingest_clashing_files",
    f"""WITH {MONTHS} SELECT origin, month, count(*) AS flights, sum(number % 1000) AS numbers, sum(distance) AS miles
    FROM typed GROUP BY origin, month""",
)
def ingest_clashing_files(t):
    """Files of one folder whose flight numbers are text in one month and numbers in the other."""
    path, typed = _folder(t, "clashing"), _typed(t)
    number = F.col("flight_number_reporting_airline").cast("string")
    records.write_records(typed.filter("month = 7"), path)
    later = typed.filter("month = 8").withColumn("flight_number_reporting_airline", number)
    records.write_records(later, path, declared=False, mode="append")
    return scan.scan_records(t.spark, path).groupBy("origin", "month").agg(
        F.count(F.lit(1)).alias("flights"),
        F.sum(F.col("flight_number_reporting_airline") % 1000).alias("numbers"),
        F.sum("distance").alias("miles"),
    )

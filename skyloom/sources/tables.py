"""Keyed, repeatable writes of legs and of the tables derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.schema import LEG_KEY
from skyloom.storage import drop_path, folders, move_path, path_exists, stage


def one_per_key(df: DataFrame, key=LEG_KEY) -> DataFrame:
    """Exactly one row per key, always the same one, whatever the task order.

    The smallest row is found by sorting, so rows are dealt out first: merging them before the
    shuffle too would sort every task's share of the input once more, and spill where it is large.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    picked = df.repartition(*key).groupBy(*key).agg(F.min(F.struct(*rest)).alias("row"))
    return picked.select(*[F.col(c) if c in key else F.col(f"row.{c}").alias(c) for c in df.columns])


def upsert_legs(df: DataFrame, path: str, key=LEG_KEY, before=None) -> list[str]:
    """Merge rows into the stored dates by key: a new row replaces the stored one, stored
    rows of the same dates stay, other dates are not touched.

    Dates are replaced whole, so a repeated load, or a retried task, changes nothing.
    Returns the dates touched. The incoming rows are computed once. ``before`` is called with the
    dates when all is computed and nothing is written yet.
    """
    df = stage(one_per_key(df, key), "incoming")
    spark = df.sparkSession
    days = sorted(str(r.flightdate) for r in df.select("flightdate").distinct().collect())
    if path_exists(spark, path):
        stored = spark.read.schema(df.schema).parquet(path)
        touched = df.select("flightdate").distinct()
        kept = stored.join(touched, "flightdate", "left_semi")
        kept = kept.join(df.select(*key), list(key), "left_anti")
        df = stage(df.unionByName(kept), "merge")  # the target is read, so write elsewhere first
    if before is not None:
        before(days)
    if days:
        replace_dates(df, path)
    return days


def drop_dates(spark: SparkSession, path: str, days: list[str]) -> None:
    for day in days:
        drop_path(spark, f"{path}/flightdate={day}")


def replace_dates(df: DataFrame, path: str, dates: list[str] | None = None) -> None:
    """Write a table so that its dates are rebuilt whole.

    ``dates`` names what is being rebuilt; those that come out empty lose their old rows. ``df``
    must not read from ``path``. The new rows are written beside the table and moved in date by
    date when all are there: a write that fails leaves every date as it was.
    """
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}__{uuid.uuid4().hex[:12]}"
    try:
        df.hint("rebalance", "flightdate").write.partitionBy("flightdate").parquet(beside)
        made = folders(spark, beside)
        drop_dates(spark, path, [d for d in dates or [] if f"flightdate={d}" not in made])
        for folder in made:
            move_path(spark, f"{beside}/{folder}", f"{path}/{folder}")
    finally:
        drop_path(spark, beside)


def verify_written(spark: SparkSession, path: str) -> int:
    """Rows read back; zero is an error, not a quiet success."""
    rows = spark.read.parquet(path).count()
    if rows == 0:
        raise RuntimeError(f"nothing was written to {path}")
    return rows


def departs_from(legs: DataFrame) -> DataFrame:
    return legs.select(*LEG_KEY, F.col("origin").alias("airport")).distinct()


def arrives_at(legs: DataFrame) -> DataFrame:
    return legs.select(*LEG_KEY, F.col("dest").alias("airport")).distinct()


def operated_by(legs: DataFrame) -> DataFrame:
    return legs.select(*LEG_KEY, F.col("reporting_airline").alias("carrier")).distinct()

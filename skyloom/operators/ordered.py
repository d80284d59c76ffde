"""The row before, along a sequence that may be long: previous leg of an aircraft, as-of joins.

Rows are dealt out once, by key, and a window runs along each key's sequence. Where a key holds
too many rows for that, they fall into days, or minutes where one day holds too many; windows run
within these, and what a day inherits comes from a row for each earlier day of its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.times import epoch_minute
from skyloom.storage import stage

#: Rows of a key beyond which it is cut into days, and of a key and day beyond which into minutes.
HOT_ROWS = 10_000
DAY = 1440


def with_previous(
    rows: DataFrame, key: str, time: str, tie: list[str | Column], take: list[str], only: Column | None = None,
    name: str = "previous", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``rows`` with a struct ``name`` of the ``take`` columns of the last row before, by ``time``
    and ``tie``, of the same ``key``: of any such row, or of the last for which ``only`` holds.

    That is an ordered scan if every row may be taken, and an as-of join of some rows to others
    if not. Rows without a key or a time have no previous row and are none; the struct is null
    where there is none. ``rows`` should be quick to read, as a stored table is: it is read twice.
    """
    placed = F.col(key).isNotNull() & F.col(time).isNotNull()
    usual = rows.filter(placed)
    hot = hot_keys(usual, key, hot_rows)
    parts = []
    if hot is not None:
        # Stored, so that both readings below see the same rows.
        parts.append(_by_days(stage(usual.join(hot, key, "left_semi"), "hot-rows"), key, time, tie, take, only, name, hot_rows))
        usual = usual.join(hot, key, "left_anti")
    value = F.struct(*take) if only is None else F.when(only, F.struct(*take))
    before = Window.partitionBy(key).orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, -1)
    # Dealt out by name, or Spark would make the structs before and send each row twice over.
    found = usual.repartition(key).withColumn(name, F.last(value, ignorenulls=True).over(before)).select(*rows.columns, name)
    none = rows.filter(~placed).withColumn(name, F.lit(None).cast(found.schema[name].dataType))
    return reduce(DataFrame.unionByName, [found, *parts, none])


def hot_keys(rows: DataFrame, key: str, hot_rows: int) -> DataFrame | None:
    """Keys of more than ``hot_rows`` rows, stored; None if there are none."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = stage(counts.select(key), "hot-keys")
    return None if hot.isEmpty() else hot


def _by_days(
    rows: DataFrame, key: str, time: str, tie: list[str | Column], take: list[str], only: Column | None, name: str, hot_rows: int
) -> DataFrame:
    """``with_previous`` of keys that hold many rows."""
    minute = epoch_minute(time)
    kept = rows.withColumn("_day", F.floor(minute / DAY))
    counts = kept.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = stage(counts.select(key, "_day", F.lit(True).alias("_hot")), "hot-days")
    kept = kept.join(hot, [key, "_day"], "left").withColumn("_slot", F.when(F.col("_hot"), minute).otherwise(F.col("_day") * DAY))
    taken = F.struct(*take)
    value = taken if only is None else F.when(only, taken)
    order = F.struct(time, *tie)
    within = Window.partitionBy(key, "_slot").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct(order.alias("at"), taken.alias("row")) if only is None else F.when(only, F.struct(order.alias("at"), taken.alias("row"))))
    days = kept.groupBy(key, "_slot").agg(latest["row"].alias("_latest"))
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "_slot", F.last("_latest", ignorenulls=True).over(earlier).alias("_carried"))
    found = kept.withColumn("_before", F.last(value, ignorenulls=True).over(within)).join(days, [key, "_slot"])
    return found.withColumn(name, F.coalesce("_before", "_carried")).select(*rows.columns, name)
